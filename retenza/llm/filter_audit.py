"""Audit of how document filters interact, by additive mask counts.

Method. Each document gets a mask of the filters A to E that it fails. A to D
are read off the text in its own task. E (the text of a smaller id) needs the
corpus, and starts with a counting-Bloom prepass: tasks count text hashes in
sketches of 64 counters a block, the sketches are merged, and a text with a
counter below two is guaranteed unique. Only the other texts are shuffled, for
the exact smallest id of each full text. The flags then join into counts per
(part, mask), and as counts are additive, everything the report says about all
120 filter orders follows from at most 32 counts a part.

Filters. A: under 50 words; B: 100 * distinct words < 65 * words; C:
100 * capitals A-Z > 5 * code points; D: holds any of ``#$%&*|``; E: the text
of a smaller id. Words are ``[^\\x20\\x09-\\x0D]+``, a null text is empty.

Scale. The sketch has a block for every ``DOCS_PER_BLOCK`` documents, so it
grows with the corpus and its error does not; hashes, not texts, are shuffled for
it, and copies of a text are summed up in each task. Up to
``broadcast_blocks`` blocks (about 48 bytes each in a hash table) it is
broadcast to pick the texts; beyond, a plain join picks them by hash. A text
that a third of all rows share is combined in each task before the shuffle.
Hashes only choose what is compared: if two different texts share a 64-bit
hash, their documents are judged by the texts themselves.

Defined cases. A null id comes after all ids: it fails E if the text also has
an id, and never makes another row fail. Rows equal in id and text don't make
each other fail. A null part is the empty string. A document is good or toxic if
any label row of its id says 1; null ids have no labels. No documents, no rows;
extra columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import UPPER, stored, table, text_groups

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
DOCS_PER_BLOCK = 4
_UPPER = UPPER.encode()
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_mask(text: str | None) -> int:
    """Bits 1, 2, 4 and 8 for the filters A to D that a text fails."""
    text = text or ""
    raw = text.encode()
    words = raw.split()                     # at blank and 0x09 to 0x0D, as these are bytes
    n = len(words)
    return (n < 50) | (100 * len(set(words)) < 65 * n) << 1 \
        | (100 * (len(raw) - len(raw.translate(None, _UPPER))) > 5 * len(text)) << 2 \
        | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3


def _hash(body: Column) -> Column:
    return F.xxhash64(body)


def facts(docs: DataFrame, part: str, hashed: Callable[[Column], Column] = _hash) -> DataFrame:
    """(id, part, th, mask): the filters A to D of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = pa.array([text_mask(t) for _, g in text_groups(b.column(3)) for t in g], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], masks], ["id", "part", "th", "mask"])

    rows = docs.select(docs["doc_id"].alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
                       hashed(F.coalesce(docs["text"], F.lit(""))).alias("th"), docs["text"].alias("body"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, part string, th long, mask int")


def _block(th: Column, blocks: int) -> Column:
    return F.pmod(th, F.lit(blocks))


def _counters(th: Column) -> Column:
    """Three counter numbers of a block, six bits each."""
    return F.xxhash64(th).bitwiseAND(F.lit((1 << 18) - 1))


def _pattern(counters: Column) -> Column:
    out = F.lit(0).cast("long")
    for i in (0, 6, 12):
        one = F.shiftright(counters, i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), one))
    return out


def counting_sketch(hashes: DataFrame, blocks: int, most: int = 1 << 20) -> DataFrame:
    """(block, twice): of each block with one, the counters that reach two, a bit each."""

    def sketch(places: np.ndarray, counters: np.ndarray) -> pa.RecordBatch:
        a, b, c = (counters >> s & 63 for s in (0, 6, 12))
        base = places << 6
        cell, n = np.unique(np.concatenate((base + a, (base + b)[b != a], (base + c)[(c != a) & (c != b)])),
                            return_counts=True)
        own, at = np.unique(cell >> 6, return_inverse=True)
        out = np.zeros((len(own), 64), np.uint8)
        out[at, cell & 63] = np.minimum(n, 255)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array([r.tobytes() for r in out], pa.binary())],
                                          ["block", "counters"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            size += b.num_rows
            if size >= most:
                yield sketch(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield sketch(*map(np.concatenate, zip(*held)))

    def merged(block: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        bits = np.packbits(sums >= 2, axis=1, bitorder="little").view(np.int64)[:, 0]
        some = bits != 0
        return pa.RecordBatch.from_arrays([pa.array(block[some]), pa.array(bits[some])], ["block", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rest = np.zeros(0, np.int64), np.zeros((0, 64), np.int64)     # the block that may go on
        for b in batches:
            if not b.num_rows:
                continue
            block = np.concatenate((last, b.column(0).to_numpy()))
            counters = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, 64)
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            sums = np.add.reduceat(np.concatenate((rest, counters)), starts, axis=0)
            block = block[starts]
            yield merged(block[:-1], sums[:-1])
            last, rest = block[-1:], np.minimum(sums[-1:], 255)
        if len(last):
            yield merged(last, rest)

    places = hashes.select(_block(F.col("th"), blocks).alias("block"), _counters(F.col("th")).alias("counters"))
    parts = places.mapInArrow(count, "block long, counters binary")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, twice long")


def possible_repeats(docs: DataFrame, sketch: DataFrame, blocks: int, broadcast_blocks: int,
                     hashed: Callable[[Column], Column] = _hash) -> DataFrame:
    """(id, th, body) of the documents that the sketch doesn't clear."""
    body = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].alias("id"), hashed(body).alias("th"), body.alias("body"))
    pattern = _pattern(_counters(F.col("th")))
    sketch = F.broadcast(sketch) if blocks <= broadcast_blocks else sketch
    return rows.withColumn("block", _block(F.col("th"), blocks)).join(sketch, "block") \
        .filter(F.col("twice").bitwiseAND(pattern) == pattern).select("id", "th", "body")


def _later(least: Column) -> Column:
    """Whether a row's id comes after the smallest one of its text."""
    return F.coalesce(F.col("id") > least, F.col("id").isNull() & least.isNotNull(), F.lit(False))


def masks(docs: DataFrame, part: str = "source", broadcast_blocks: int = 1 << 20,
          hashed: Callable[[Column], Column] = _hash) -> DataFrame:
    """(id, part, mask): one row per document, the filters A to E that it fails as bits."""
    rows = stored(facts(docs, part, hashed), "filter-facts")
    blocks = max(1, -(-rows.count() // DOCS_PER_BLOCK))
    sketch = stored(counting_sketch(rows.select("th"), blocks), "filter-sketch")
    repeats = possible_repeats(docs, sketch, blocks, broadcast_blocks, hashed)
    exact = repeats.groupBy("th", "body").agg(F.min("id").alias("least"))
    least = stored(exact.groupBy("th").agg(F.count(F.lit(1)).alias("texts"), F.min("least").alias("least")),
                   "filter-repeats")
    out = rows.join(least.filter("texts = 1").select("th", "least"), "th", "left") \
        .select("id", "part", "th", F.col("mask").bitwiseOR(F.when(_later(F.col("least")), 16).otherwise(0))
                .alias("mask"))
    clash = least.filter("texts > 1").select("th")
    if not clash.isEmpty():                 # different texts of one hash: by the texts themselves
        out = out.join(clash, "th", "left_anti")
        keyed = docs.withColumn("_clash", hashed(F.coalesce(docs["text"], F.lit(""))))
        own = keyed.join(clash, keyed["_clash"] == clash["th"], "left_semi").select(
            docs["doc_id"].alias("doc_id"), docs[part].alias("part"), docs["text"].alias("text"))
        first = own.groupBy(F.coalesce("text", F.lit("")).alias("body")).agg(F.min("doc_id").alias("least"))
        judged = own.mapInArrow(_with_masks, StructType([*own.schema, StructField("mask", IntegerType())])).select(
            F.col("doc_id").alias("id"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"),
            F.coalesce("text", F.lit("")).alias("body"), "mask").join(first, "body")
        out = out.unionByName(judged.select(
            "id", "part", F.lit(0).cast("long").alias("th"),
            F.col("mask").bitwiseOR(F.when(_later(F.col("least")), 16).otherwise(0)).alias("mask")))
    return out.select("id", "part", "mask")


def _with_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.append_column("mask", pa.array([text_mask(t) for t in b.column(2).to_pylist()], pa.int32()))


def mask_counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the additive counts."""
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return masked.join(said, "id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).cast("long").alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).cast("long").alias("toxic"))


def order_effects(n: int = len(FILTERS)):
    """(orders, steps, filters) and 0/1 matrices masks x (order, step): kept, removed, redundant,
    unique; and masks x filter: removed in how many orders."""
    mask = np.arange(1 << n)
    rows, columns = [], {k: [] for k in ("kept", "removed", "redundant", "unique")}
    for order in itertools.permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << f
            fails, earlier = (mask & bit) > 0, (mask & before) > 0
            rows.append(("".join(FILTERS[i] for i in order), step, f))
            for k, v in (("kept", ~fails & ~earlier), ("removed", fails & ~earlier), ("redundant", fails & earlier),
                         ("unique", mask == bit)):
                columns[k].append(v)
            before |= bit
    effect = {k: np.array(v, np.int64).T for k, v in columns.items()}
    filters = np.array([f for _, _, f in rows])
    effect["shapley"] = np.stack([effect["removed"][:, filters == f].sum(1) for f in range(n)], 1)
    return [r[0] for r in rows], [r[1] for r in rows], filters, effect


def report(counts: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, all ``COUNTS``, from ``mask_counts``."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, steps, filters, effect = order_effects()
        for b in batches:
            for name, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, good, toxic = (np.zeros(32, np.int64) for _ in range(3))
                for c in own:               # 32 masks at most
                    n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
                values = [n @ effect["kept"], n @ effect["removed"], n @ effect["redundant"], n @ effect["unique"],
                          good @ effect["removed"], toxic @ effect["removed"], (n @ effect["shapley"])[filters]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(orders)), pa.array(orders), pa.array(steps, pa.int32()),
                     *map(pa.array, values)], ["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, "part string, filter_order string, step int, "
                            + ", ".join(f"{c} long" for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", broadcast_blocks: int = 1 << 20) -> DataFrame:
    return report(mask_counts(masks(docs, part, broadcast_blocks), labels))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (
  SELECT doc_id, part,
         len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, doc_id > least AS e FROM w),
l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
  FROM labels GROUP BY doc_id),
m AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END)
         || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END)
         || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM x p, x q, x r, x s, x t
  WHERE q.x <> p.x AND r.x NOT IN (p.x, q.x) AND s.x NOT IN (p.x, q.x, r.x)
    AND t.x NOT IN (p.x, q.x, r.x, s.x)),
st AS (
  SELECT filter_order, step, filter_order[step] AS f, substr(filter_order, 1, step - 1) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
j AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, f, n, good, toxic, contains(fails, f) AS bad,
         fails = f AS only_f, length(translate(fails, before, '')) < length(fails) AS gone
  FROM m, st),
s AS (
  SELECT part, filter_order, step, f,
         CAST(coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (bad AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (bad AND gone), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (only_f), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (bad AND NOT gone), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (bad AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM j GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM s
"""
