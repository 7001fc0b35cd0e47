"""Sharding along a Hilbert curve over document metadata.

Method: several metadata dimensions are quantised to ``bits`` bits each,
the cells are numbered along the Hilbert curve, rows are sorted by that
number, and the sorted run is cut into shards. Neighbours on the curve are
neighbours in every dimension, so a shard covers a small box, and a
reader that filters on a dimension can skip the shards whose min and max leave it out.

Cells go by rank: their limits are quantiles of the dimension over all rows (approximate, to
one in ``ACCURACY``), for a size of the number itself, for a category of a hash. So rows
spread evenly over a dimension's cells whatever its values are, and every bit of the curve
parts rows; a common category takes the place of many cells. How many
shards a filter opens is measured in tests/llm.

Law ``rows``: shard sizes in rows differ by at most one.

Scale. The sort is one range exchange of the metadata (no texts); ties on
the curve go on by document, so a cell with a third of the rows still
spreads over many partitions. Ranks are the partition's row count before a
row plus its place inside the partition; only one row per partition is
summed up in order.

Defined cases. Null metadata falls in cell 0 of its dimension.
A null text has no bytes and crc32 0. Repeated rows get a place each.
With fewer rows than shards the last shards are empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import stored, table

ACCURACY = 10_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, dims), each coordinate
    under ``2**bits``: coordinates become the curve's transposed index by
    undoing rotations from the top bit down, then a Gray code (Skilling 2004)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            flip = (x[i] >> b & 1).astype(bool)
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out


def rank_cells(rows: DataFrame, dims: dict[str, Column], bits: dict[str, int]) -> dict[str, Column]:
    """A cell under ``2**bits[name]`` for each dimension, by quantiles over ``rows``: the number of limits
    up to the value (for a value of many limits the middle one of them), 0 for null. Only the limits reach the driver."""
    # 48 bits of a hash: quantiles are computed in doubles
    values = {n: c if dict(rows.select(c.alias(n)).dtypes)[n] in ("int", "bigint") else
              F.when(c.isNotNull(), F.shiftright(F.xxhash64(c), 16)) for n, c in dims.items()}
    got = rows.agg(*[F.percentile_approx(v.cast("long"), [i / (1 << bits[n]) for i in range(1, 1 << bits[n])], ACCURACY)
                     .alias(n) for n, v in values.items()]).first()

    def cell(name: str, value: Column) -> Column:
        limits = F.array(*[F.lit(int(x)).cast("long") for x in got[name] or []]).cast("array<long>")
        upto = F.size(F.filter(limits, lambda x: x < value)) + F.size(F.filter(limits, lambda x: x <= value))
        return F.when(value.isNull(), F.lit(0)).otherwise(F.floor(upto / 2).cast("int"))
    return {n: cell(n, v) for n, v in values.items()}


def hilbert_shards(rows: DataFrame, dims: dict[str, Column], shards: int = 24, bits: int = 6,
                   ties: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All columns of ``rows`` with ``curve``, ``shard`` and ``slot`` (from 0 in each
    shard). ``dims``: name to an int column under ``2**bits``."""
    if len(dims) * bits > 62:
        raise ValueError("dims * bits must stay under 63")

    @pandas_udf("long")
    def place(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy(), bits))

    whole = F.struct(*[rows[c] for c in rows.columns])
    keyed = rows.select(place(F.struct(*[c.alias(n) for n, c in dims.items()])).alias("curve"),
                        *[rows[t].alias(f"t{i}") for i, t in enumerate(ties)], whole.alias("row"))
    order = ["curve", *[f"t{i}" for i in range(len(ties))]]
    run = keyed.repartitionByRange(*order).sortWithinPartitions(*order) \
        .select("curve", "row", F.monotonically_increasing_id().alias("at"))
    run = stored(run, "curve-run")
    part = F.shiftright("at", 33)
    sizes = run.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding,
                                                               Window.unboundedFollowing))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"), total.alias("total"))
    ranked = run.join(sizes, part == sizes["part"]).select(
        "curve", "row", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"), "total")
    least = F.floor(F.col("total") / shards)
    large = F.col("total") % shards
    edge = large * (least + 1)
    shard = F.when(F.col("rank") < edge, F.floor(F.col("rank") / (least + 1))) \
        .otherwise(large + F.floor((F.col("rank") - edge) / F.greatest(least, F.lit(1))))
    first = shard * least + F.least(shard, large)
    return ranked.select("row.*", "curve", shard.cast("int").alias("shard"),
                         (F.col("rank") - first).cast("long").alias("slot"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (k, ...) with ``nth``, from 1 among the rows of equal k: counted inside each part
    and added up over the parts, so a hot k is not numbered in one task."""
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()), "to-number") \
        .withColumn("p", F.shiftright("at", 33))
    sizes = rows.groupBy("k", "p").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("k", "p", F.coalesce(before, F.lit(0)).alias("before"))
    inside = rows.withColumn("inside", F.row_number().over(Window.partitionBy("k", "p").orderBy("at")))
    return inside.join(sizes, ["k", "p"]).withColumn("nth", F.col("before") + F.col("inside")) \
        .drop("p", "at", "before", "inside")


def write_shards(placed: DataFrame, docs: DataFrame, path: str) -> None:
    """The documents as one folder per shard, in slot order; ``placed`` is what
    ``document_shards`` gives for them. A shard is written by as many tasks as its share of the
    rows asks for, each with a run of slots. Rows with equal metadata, which lie on one
    place of the curve, take their slots by number, so each row is written once."""
    def key(rows: DataFrame) -> Column:
        # fields of a struct that is never null, so that null ids meet as equal
        return F.struct(*[rows[c] for c in ("doc_id", "lang", "source", "size", "text_crc32")]).alias("k")
    spots = stored(placed.select(key(placed), "shard", "slot"), "spots")
    repeated = stored(spots.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("k"), "repeated")
    metadata = F.struct(docs["doc_id"], docs["lang"], docs["source"], *_text_columns(docs["text"])).alias("k")
    rows = docs.select(metadata, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = rows.join(spots.join(repeated, "k", "left_anti"), "k").select("row.*", "shard", "slot")
    if not repeated.isEmpty():                               # only these are numbered
        own = _numbered(rows.join(repeated, "k", "left_semi"))
        out = out.unionByName(own.join(_numbered(spots.join(repeated, "k", "left_semi")), ["k", "nth"])
                              .select("row.*", "shard", "slot"))
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").parquet(path)


def _text_columns(text: Column) -> tuple[Column, Column]:
    return ((F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))


def document_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", "source", *_text_columns(docs["text"]))


def document_shards(docs: DataFrame, shards: int = 24, bits: int = 6) -> DataFrame:
    """Shards along the curve of language, source and size; equal cells go on by id. The
    language has two bits more than the others, so the curve parts it first: it has few values,
    and is what readers ask for most."""
    rows = document_rows(docs)
    cells = rank_cells(rows, {n: F.col(n) for n in ("lang", "source", "size")},
                       {"lang": bits, "source": bits - 2, "size": bits - 2})
    return hilbert_shards(rows, cells, shards, bits, ("doc_id", "text_crc32", "size"))


def op5_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    return document_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")
