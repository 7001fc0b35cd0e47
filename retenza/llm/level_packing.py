"""Online packing of documents by the sum of squares of a level array.

Method: a window is a sequence of ``capacity`` tokens that fills up; its level
is the number of tokens in it. The level array holds how many windows stand at
each level. The next document goes to the level (or to a new window) for which
the sum of the squared counts over all levels that would need padding is least
afterwards; of equal ones, to the fullest window. Level ``capacity`` closes a
window. A sequence whose length is a power of two isn't padded, so such
levels, too, are left out of the sum.

Whole pieces of ``capacity`` tokens are cut off a longer document first; what
is left of it is placed. Windows still open when a task ends, or when
``most_open`` are open, are closed like this: those at a power of two stay as
they are; the others are joined, fullest first, and cut anew every
``capacity`` tokens, and the end of the last one is cut into powers of two. So
nothing is padded, and only the last windows of a task have documents cut.

Scale. Every task packs its own documents in one pass over the texts: no
shuffle, no table in between, and no state but the open windows (at most
``most_open`` times ``capacity`` ids). Sequence ids carry the task's number.

Defined cases. A null or empty text is the end id alone; a null id and
repeated rows are documents like any other; no documents, no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import table
from .packing import tokenizer_path
from .tokens import with_end

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NEVER = 1 << 60


class LevelArray:
    """How many windows stand at each level, and which ones."""

    def __init__(self, capacity: int):
        self.capacity, self.open = capacity, 0
        level = np.arange(capacity + 1)
        self.padded = (level & (level - 1)) != 0
        self.padded[capacity] = False
        self.windows: list[list[int]] = [[] for _ in level]
        self.leave = np.full(capacity + 1, _NEVER)          # change of the sum if a window leaves a level
        self.leave[0] = 0
        self.enter = self.padded.astype(np.int64)           # ... or comes to it

    def _count(self, level: int) -> None:
        n = len(self.windows[level])
        if self.padded[level]:
            self.leave[level], self.enter[level] = (1 - 2 * n if n else _NEVER), 2 * n + 1
        else:
            self.leave[level] = 0 if n else _NEVER

    def best(self, size: int) -> int:
        """The level that takes ``size`` tokens with the least sum of squares; 0 is a new window."""
        cost = self.leave[:self.capacity - size + 1] + self.enter[size:]
        return len(cost) - 1 - int(cost[::-1].argmin())

    def take(self, level: int) -> int:
        """A window of ``level``, no longer there."""
        window = self.windows[level].pop()
        self._count(level)
        self.open -= 1
        return window

    def put(self, level: int, window: int) -> None:
        self.windows[level].append(window)
        self._count(level)
        self.open += 1


class Packer:
    """Packs one task's documents; ``rows`` are finished pieces."""

    def __init__(self, capacity: int, most_open: int, first_id: int):
        self.capacity, self.most_open, self.next = capacity, most_open, first_id
        self.levels = LevelArray(capacity)
        self.content: dict[int, list[tuple]] = {}           # open window -> (doc_id, start, ids, doc_tokens)
        self.rows: list[tuple] = []

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _close(self, pieces: list[tuple], window: int) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids), total, window, at))
            at += len(ids)

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self._close([(doc_id, start, ids[start:start + self.capacity], total)], self._new())
            start += self.capacity
        if start == total:
            return
        level = self.levels.best(total - start)
        window = self.levels.take(level) if level else self._new()
        own = self.content.pop(window, [])
        own.append((doc_id, start, ids[start:].copy(), total))
        level += total - start
        if level == self.capacity:
            self._close(own, window)
        else:
            self.content[window] = own
            self.levels.put(level, window)
            if self.levels.open >= self.most_open:
                self.drain()

    def drain(self) -> None:
        """Close all open windows without padding."""
        rest: list[tuple] = []
        for level in range(self.capacity - 1, 0, -1):
            for window in self.levels.windows[level]:
                if self.levels.padded[level]:
                    rest += self.content[window]
                else:
                    self._close(self.content[window], window)
        self.content, self.levels = {}, LevelArray(self.capacity)
        left = sum(len(p[2]) for p in rest)
        rest.reverse()
        while left:
            size = min(self.capacity, 1 << (left.bit_length() - 1))
            own, room = [], size
            while room:
                doc_id, start, ids, total = rest.pop()
                if len(ids) > room:
                    rest.append((doc_id, start + room, ids[room:], total))
                    ids = ids[:room]
                own.append((doc_id, start, ids, total))
                room -= len(ids)
            self._close(own, self._new())
            left -= size


def pack_levels(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 2048,
                most_open: int = 2048) -> DataFrame:
    """One row per piece: doc_id and ``PIECE``. ``capacity`` is a power of two."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity is a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, most_open, TaskContext.get().partitionId() << 40)
        kind = None

        def finished() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            columns = list(zip(*rows)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for rows, ids, n in with_end(batches, path, end_id):
            kind, ids, at = rows.schema.field(0).type, ids.astype("<u4"), 0
            for doc_id, size in zip(rows.column(0).to_pylist(), n.tolist()):
                packer.add(doc_id, ids[at:at + size])
                at += size
            yield finished()
        if kind is not None:
            packer.drain()
            yield finished()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {PIECE}")


def op12_level_packing(spark, sf_dir: str) -> DataFrame:
    return pack_levels(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
