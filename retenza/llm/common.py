"""Helpers shared by the corpus operators.

Row identity. Operators that bring a per-document result back to its row
join on (id, 64-bit hash of the text), null-safe, so null ids, repeated
ids and repeated rows keep one output row per input row.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retenza.session import ensure_checkpoint_dir

#: White space of the word and line contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[ \\t-\\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: For bytes.translate on lower-cased UTF-8: all but 0-9, a-z and bytes over 0x7F become spaces.
WORD_BYTES = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


_FACTOR = np.random.default_rng(31).integers(1, 1 << 63, 1 << 10, np.uint64) * np.uint64(2) + np.uint64(1)


def text_groups(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch in groups of about ``most`` bytes, each with the place of its first,
    so that a large batch is never held as Python strings as a whole."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(column):
        before = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
        yield i, column.slice(i, j - i).to_pylist()
        i = j


def word_bytes(text: str | None) -> bytes:
    """The text in UTF-8, A-Z lower-cased, a blank for every byte that is in no word."""
    return text.encode().lower().translate(WORD_BYTES) if text else b""


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``raw`` (apart by blanks) begin, and a 64-bit hash of each: the sum of
    its bytes times fixed random odd factors by place."""
    data = np.frombuffer(raw, np.uint8)
    word = data != 32
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    at = np.arange(len(data))
    place = at - np.maximum.accumulate(np.where(first, at, 0))
    value = (data + np.uint64(1)) * _FACTOR[place & (len(_FACTOR) - 1)]
    if place.max() >= len(_FACTOR):
        value *= (place >> 10).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    value[~word] = 0
    h = np.add.reduceat(value, starts)
    return starts, h ^ (h >> np.uint64(32))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder for a written intermediate, in the shared folder of
    ``spark.checkpoint.dir``; it goes when the application ends."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"corpus-{uuid.uuid4().hex}", name)
    jvm = spark._jvm
    parent = jvm.org.apache.hadoop.fs.Path(os.path.dirname(path))
    parent.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(parent)
    return path


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    survives lost executors, and gives the planner the true size."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table of ``stored`` that nothing lazy reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_col(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return let(F.btrim(text, F.lit(BLANKS)),
               lambda t: F.when(t.isNull() | (t == ""), F.array().cast("array<string>"))
               .otherwise(F.split(t, BLANK_RUN, -1)))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    """A line without blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality on ``names``."""
    cond = left[names[0]].eqNullSafe(right[names[0]])
    for n in names[1:]:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond
