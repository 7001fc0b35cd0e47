"""Range asymmetric numeral system (rANS) for blocks of token ids, in numpy.

One static frequency table, summing to ``2**SCALE``, serves all blocks. A
block's ids are dealt over ``lanes`` interleaved coder states: lane j takes
ids j, j + lanes, ... and all lanes step together as one vector operation.
The lanes share one stream of 32-bit words; in every step the lanes that
need a word take the next ones in lane order.

Block layout, little-endian: magic, lanes, checkpoint distance in steps,
number of ids, number of words, number of checkpoints, crc32 of the table;
the lane states (u64); for each checkpoint its word position (u64) and
lane states; the words (u32). Decoding may start at any checkpoint.
"""

from __future__ import annotations

import struct
import zlib
from functools import cached_property

import numpy as np

MAGIC = b"rANS0001"
SCALE = 20
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<8sIIQQII")


class Table:
    """Frequencies of the ids 0, 1, ...; ids that never occur get 0 and can't be coded."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype("<u4")
        self.f = freq.astype(np.uint64)
        self.start = np.cumsum(self.f) - self.f
        self.crc = zlib.crc32(self.freq.tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Counts scaled to sum ``2**SCALE``, at least 1 for each id that occurs."""
        total, goal = int(counts.sum()), 1 << SCALE
        if np.count_nonzero(counts) > goal:
            raise ValueError(f"more than {goal} different ids")
        if total == 0:
            return cls(np.zeros(len(counts), np.int64))
        f = np.where(counts > 0, np.maximum(1, np.floor(counts / total * goal)), 0).astype(np.int64)
        excess = int(f.sum()) - goal
        if excess < 0:
            f[f.argmax()] -= excess
        for i in np.argsort(-f, kind="stable"):          # the frequent ids give back what is over
            if excess <= 0:
                break
            give = min(excess, int(f[i]) // 2)
            f[i] -= give
            excess -= give
        return cls(f)

    @cached_property
    def symbols(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)


def encode(ids: np.ndarray, table: Table, lanes: int = 2048, every: int = 64) -> bytes:
    n = len(ids)
    steps = -(-n // lanes)
    x = np.full(lanes, LOW)
    words, total, marks = [], 0, []
    for t in range(steps - 1, -1, -1):
        own = ids[t * lanes:(t + 1) * lanes]
        f, state = table.f[own], x[:len(own)]
        full = state >= f << np.uint64(31 - SCALE + 32)
        out = state[full]
        words.append(out.astype("<u4"))
        total += len(out)
        state[full] = out >> np.uint64(32)
        q, r = np.divmod(state, f)
        x[:len(own)] = (q << np.uint64(SCALE)) + r + table.start[own]
        if t and t % every == 0:
            marks.append((total, x.copy()))
    marks.reverse()
    body = [x.astype("<u8").tobytes()]
    for after, states in marks:
        body += [struct.pack("<Q", total - after), states.astype("<u8").tobytes()]
    body += [w.tobytes() for w in reversed(words)]
    return HEAD.pack(MAGIC, lanes, every, n, total, len(marks), table.crc) + b"".join(body)


def checkpoints(block: bytes) -> int:
    """How many places besides the first a block can be decoded from."""
    return HEAD.unpack_from(block)[5]


def decode(block: bytes, table: Table, mark: int = 0, until: int | None = None) -> np.ndarray:
    """The ids from checkpoint ``mark`` (0: the block's start) to checkpoint ``until`` (None: its end)."""
    magic, lanes, every, n, total, marks, crc = HEAD.unpack_from(block)
    if magic != MAGIC or crc != table.crc or not 0 <= mark <= marks:
        raise ValueError("not a block of this table")
    at, one = HEAD.size, 8 + 8 * lanes
    words = np.frombuffer(block, "<u4", total, at + 8 * lanes + marks * one)
    pos = struct.unpack_from("<Q", block, at + 8 * lanes + (mark - 1) * one)[0] if mark else 0
    x = np.frombuffer(block, "<u8", lanes, at if not mark else at + 16 + 8 * lanes + (mark - 1) * one - 8) \
        .astype(np.uint64)
    steps = -(-n // lanes)
    last = steps if until is None or until > marks else until * every
    out, low = [], np.uint64((1 << SCALE) - 1)
    for t in range(mark * every, last):
        state = x[:min(lanes, n - t * lanes)]
        slot = state & low
        own = table.symbols[slot]
        state = table.f[own] * (state >> np.uint64(SCALE)) + slot - table.start[own]
        empty = state < LOW
        need = int(np.count_nonzero(empty))
        state[empty] = state[empty] << np.uint64(32) | words[pos:pos + need].astype(np.uint64)
        pos += need
        x[:len(state)] = state
        out.append(own)
    if last == steps and (pos != total or (x != LOW).any()):
        raise ValueError("the block is damaged")
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
