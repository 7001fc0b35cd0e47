"""Line deduplication over a whole corpus, in DataFrame functions only.

Method: explode each document's distinct normalised lines, hash them,
count the documents of each hash, and take the frequent ones as a table.
Lines are then exploded with their positions, joined to that table, and
each document is reassembled from the positions that stay.

Scale. A document sends a line once and counts are combined before the
shuffle, so a line found everywhere costs one row per task. The frequent
lines are a written table: the planner broadcasts it only if its true
size allows, else it is a sort-merge join whose hot keys AQE splits. What
is gathered per document is bounded by that document's own lines.

Defined cases. A null or empty text is one empty line and keeps the empty
text. Lines whose key is shorter than ``min_chars`` always stay. Each row
counts as a document, also one that repeats an earlier row. A line is
known by 96 bits (two independent hashes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import line_key, same, stored, text_hash


def _keyed(lines: DataFrame) -> DataFrame:
    return lines.select("*", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2")).drop("key")


def frequent_lines(texts: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(h1, h2) of the line keys found in at least ``min_docs`` rows of ``texts`` (body)."""
    own = texts.select(F.explode(F.array_distinct(
        F.transform(F.split("body", "\n", -1), line_key))).alias("key"))
    return (_keyed(own.filter(F.char_length("key") >= min_chars))
            .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_docs).select("h1", "h2"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """One row per document: ``row`` (all input columns as a struct),
    ``n_lines``, ``n_dropped`` and ``kept_text``."""
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       docs["doc_id"].alias("id"),
                       F.coalesce(docs["text"], F.lit("")).alias("body"))
    base = base.withColumn("th", text_hash(F.col("body")))
    frequent = stored(frequent_lines(base, min_docs, min_chars), "frequent-lines")
    at = _keyed(base.select("id", "th", F.posexplode(
        F.transform(F.split("body", "\n", -1), line_key)).alias("pos", "key")))
    drops = (at.join(frequent, ["h1", "h2"]).groupBy("id", "th")
             .agg(F.collect_set("pos").alias("drop")))
    # the positions are hashed, not sorted, so that the whole texts of a partition are never held
    d = base.alias("d").join(drops.hint("shuffle_hash").alias("x"), same(base, drops, "id", "th"), "left")
    lines = F.split("d.body", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("x.drop"))
    d = d.select("d.row", lines.alias("lines"), left.alias("left"), F.col("d.body").alias("body"))
    return d.select(
        "row", F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("left").isNull(), F.lit(0))
        .otherwise(F.size("lines") - F.size("left")).cast("long").alias("n_dropped"),
        F.when(F.col("left").isNull(), F.col("body"))
        .otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))
        .alias("kept_text"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
                      F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.key IS NULL), ''))
         AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY k.doc_id
"""
