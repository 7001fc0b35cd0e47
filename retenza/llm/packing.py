"""Packing documents into sequences by non-negative least squares.

Method: enumerate the patterns of up to three piece lengths that fill a
sequence exactly, fit how often each is used to the histogram of piece
lengths (non-negative least squares), round, and pack what is left by
filling each sequence with the longest pieces that still fit.

Only the histogram (one number for each length up to ``capacity``) reaches
the driver, and the plan it makes has as many rows at every corpus size. A
piece finds its sequence by its length and its rank among pieces of that
length: ranks count inside each task, and the tasks' counts are summed up
by length in Spark. Texts are read once and never shuffled, and a length
that a third of all pieces share is no hot group.

A document longer than ``capacity`` is cut into full pieces, the first one
takes the rest. Defined cases: a null or empty text is the end id alone; a
null id and repeated rows are documents like any other; no documents, no
rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import stored, table
from .tokens import with_end

PIECE = "piece int, start long, length long, ids_crc32 long, part int, local_rank long"


def cut_pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id and ``PIECE``: part and local_rank number the pieces of one length in a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows, ids, n in with_end(batches, path, end_id):
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            short = ((n - 1) % capacity + 1)[doc]
            start = np.where(piece == 0, 0, short + (piece - 1) * capacity)
            length = np.where(piece == 0, short, capacity)
            raw, at = memoryview(ids.astype("<u4").tobytes()), 4 * ((np.cumsum(n) - n)[doc] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            order = np.argsort(length, kind="stable")
            by = length[order]
            rank = np.empty(len(doc), np.int64)
            rank[order] = seen[by] + np.arange(len(by)) - np.searchsorted(by, by)
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([
                rows.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)),
                pa.array(rank)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, {PIECE}")


def exact_patterns(capacity: int) -> np.ndarray:
    """Rows of three lengths, descending, 0 for none, that add up to ``capacity``."""
    a = np.arange(1, capacity + 1)
    first, second = np.meshgrid(a, np.arange(capacity + 1), indexing="ij")
    third = capacity - first - second
    fits = (first >= second) & (second >= third) & (third >= 0)
    return np.stack([first[fits], second[fits], third[fits]], 1)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 that bring the patterns' pieces nearest
    to ``counts``, long pieces weighing more; accelerated projected gradient."""
    used, size = patterns > 0, len(counts)
    weight = 0.1 + np.arange(size) / (size - 1 or 1)
    scale = max(1.0, counts.max())
    goal = counts / scale

    def pieces(x):
        return np.bincount(patterns[used], np.repeat(x[:, None], 3, 1)[used], size)

    def gradient(x):
        return (np.where(used, (weight * (pieces(x) - goal))[patterns], 0)).sum(1)

    v = np.random.default_rng(0).random(len(patterns))
    for _ in range(20):                     # the largest curvature, by power iteration
        v = (np.where(used, (weight * pieces(v))[patterns], 0)).sum(1)
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - gradient(y) / (1.05 * top))
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / nt * (new - x)
        x, t = new, nt
    return x * scale


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """(piece lengths, how many sequences) that use up ``counts`` (by length, [0] unused)."""
    capacity, left, out = len(counts) - 1, counts.astype(np.int64).copy(), []
    patterns = exact_patterns(capacity)
    patterns = patterns[(left[patterns] > 0)[:, 0] & ((patterns == 0) | (left[patterns] > 0)).all(1)]
    if len(patterns):
        x = fit_repeats(patterns, counts.astype(float) * (np.arange(capacity + 1) > 0))
        for k in np.argsort(-x, kind="stable"):
            if round(x[k]) < 1:
                break
            lengths, need = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
            times = int(min(round(x[k]), (left[lengths] // need).min()))
            if times:
                left[lengths] -= times * need
                out.append((patterns[k][patterns[k] > 0].tolist(), times))
    while left.any():                       # each turn uses up one length at least
        own, room, free = [], capacity, left.copy()
        while True:
            fit = np.flatnonzero(free[:room + 1])
            if not len(fit):
                break
            size = int(fit[-1])
            take = int(min(free[size], room // size))
            own += [size] * take
            free[size] -= take
            room -= take * size
        lengths, need = np.unique(own, return_counts=True)
        times = int((left[lengths] // need).min())
        left[lengths] -= times * need
        out.append((own, times))
    return out


def places(packs: list[tuple[list[int], int]]):
    """Arrays by (length, rank): first rank, length, sequence of that rank, offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in packs:
        at = 0
        for n in lengths:
            first = used.get(n, 0)
            rows.append((n, first, sequence, at))
            used[n] = first + times
            at += n
        sequence += times
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else (np.zeros(0, np.int64),) * 4


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(cut_pieces(docs, path, end_id, capacity), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")
                             .rowsBetween(Window.unboundedPreceding, -1))
    counts = stored(counts.select("part", "length", "n", F.coalesce(before, F.lit(0)).alias("before")),
                    "piece-counts")
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():    # capacity rows at most
        hist[r["length"]] = r["n"]
    length, first, sequence, offset = places(plan(hist))
    shared = docs.sparkSession.sparkContext.broadcast((length << 44 | first, first, sequence, offset))

    @pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, lo, seq, off = shared.value
        at = np.searchsorted(keys, size.to_numpy() << 44 | rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": seq[at] + rank.to_numpy() - lo[at], "offset": off[at]})

    out = pieces.join(counts.drop("n"), ["part", "length"]).withColumn(
        "p", place("length", F.col("local_rank") + F.col("before")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_pack(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
