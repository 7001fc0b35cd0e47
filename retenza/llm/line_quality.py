"""Quality rules by cross-document line frequency, in DataFrame functions only.

Method: hash each document's normalised lines, count for every host the
distinct documents that hold a line, remove the lines above the limits,
and reject the documents of which too little is left. Beside it stand the
base rules, all computed inside the document's own row.

Limits. A line is boilerplate of a host if at least ``min_docs`` distinct
documents of the host hold it and these are at least one in ``one_in`` of
the host's distinct documents. Copies of one text count as one document, and
the share is high enough that a group of near copies does not make its own
lines boilerplate. A document is depleted if more than ``max_percent`` of
its word characters are in such lines.

Scale. Lines are first counted by row with map-side combining (one row per
line and task, however hot the line or the host); only lines whose raw
count reaches the limits - a distinct count can't be higher - are exploded
a second time for the exact count. Neither pass shuffles texts. Repeated
8-word windows are found in the row by sorting window hashes, n log n in
the length of the text.

Defined cases. Null and empty texts have no words, fail the base rules and
are not kept. ``drop_rejected`` takes all copies of a line above the limits out of a kept
document; line ends between the other lines stay as they are. A null host is a host of its own. Lines without a word are
never boilerplate. Repeated rows each get the same verdict. Lines are
known by 96 bits, windows inside one text by 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, line_key, same, stored, text_hash, words_col

SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column, window: int = 8) -> Column:
    """How many words lie in a ``window``-word run that occurs twice or more in ``words``."""

    def covered(hashes: Column) -> Column:
        def from_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"])
                             | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
            starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
            steps = let(starts, lambda p: F.transform(
                p, lambda v, k: F.coalesce(F.least(F.lit(window), F.get(p, k + 1) - v),
                                           F.lit(window))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)) \
            .otherwise(let(tagged, from_sorted))

    runs = let(F.transform(words, lambda w: F.xxhash64(w)), lambda hs: F.transform(
        F.sequence(F.lit(1), F.size(hs) - window + 1), lambda i: F.xxhash64(F.slice(hs, i, window))))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(runs, covered))


def base_columns(text: Column) -> Column:
    """Struct of the row-wise counts of one text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    whole = F.coalesce(text, F.lit(""))
    return let(words_col(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.translate(whole, BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).cast("long")
        .alias("n_symbols"),
        F.coalesce(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0))
        .cast("long").alias("n_dup_lines"),
        repeated_words(w).cast("long").alias("n_repeat_words")))


def base_failed(b: str) -> Column:
    return (F.col(f"{b}.n_words") < 20) | \
        (100 * F.col(f"{b}.n_repeat_words") > 30 * F.col(f"{b}.n_words"))


def _texts(docs: DataFrame, host: str) -> DataFrame:
    return docs.select(docs["doc_id"].alias("id"), docs[host].alias("host"), docs["text"].alias("body"),
                       text_hash(docs["text"]).alias("th"))


def _lines(texts: DataFrame) -> DataFrame:
    """(id, host, th, pos, h1, h2, chars): every line that has a word."""
    keys = F.transform(F.split("body", "\n", -1), line_key)
    return texts.select("id", "host", "th", F.posexplode(keys).alias("pos", "key")) \
        .filter(F.col("key") != "") \
        .select("id", "host", "th", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"),
                F.char_length(F.translate("key", BLANKS, "")).alias("chars"))


def boilerplate_hits(docs: DataFrame, host: str = "source", min_docs: int = 20,
                     one_in: int = 10) -> DataFrame:
    """(id, th, host, h1, h2, chars, n): the documents' lines above the host's
    limits, ``n`` times in the document, ``chars`` word characters each."""
    texts = _texts(docs, host)
    sizes = texts.filter(F.col("body").isNotNull()).groupBy("host") \
        .agg(F.count_distinct("th", F.octet_length("body")).alias("host_docs"))
    sizes = stored(sizes.select("host", F.greatest(
        F.lit(min_docs), F.ceil(F.col("host_docs") / one_in)).alias("limit")), "hosts")
    own = F.array_distinct(F.filter(F.transform(F.split("body", "\n", -1), line_key),
                                    lambda k: k != ""))
    raw = (texts.select("host", F.explode(own).alias("key"))
           .groupBy("host", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))
           .agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= min_docs))
    often = raw.join(sizes, same(raw, sizes, "host")) \
        .filter(F.col("rows") >= F.col("limit")).select(raw["host"], "h1", "h2", "limit")
    often = stored(often, "often")
    lines = _lines(texts)
    hits = lines.join(often, same(lines, often, "host", "h1", "h2")).select(
        lines["id"], lines["th"], lines["host"], lines["h1"], lines["h2"], "pos", "chars", "limit")
    hits = stored(hits.groupBy("id", "th", "host", "h1", "h2").agg(
        F.size(F.collect_set("pos")).alias("n"), F.first("chars").alias("chars"),
        F.first("limit").alias("limit")), "line-hits")
    above = hits.groupBy("host", "h1", "h2").agg(
        F.count_distinct("th").alias("distinct_docs"), F.first("limit").alias("limit")) \
        .filter(F.col("distinct_docs") >= F.col("limit"))
    return hits.join(above, same(hits, above, "host", "h1", "h2"), "left_semi").drop("limit")


def verdicts(docs: DataFrame, host: str = "source", min_docs: int = 20, one_in: int = 10,
             max_percent: int = 70) -> DataFrame:
    """Row keys (id, th, host), the base counts ``b``, removed_chars, base_failed, depleted, kept,
    and ``bad``, the hashes (h1, h2) of the document's lines above the limits."""
    removed = boilerplate_hits(docs, host, min_docs, one_in).groupBy("id", "th", "host").agg(
        F.sum(F.col("n") * F.col("chars")).alias("removed"), F.collect_list(F.struct("h1", "h2")).alias("bad"))
    texts = _texts(docs, host)
    base = texts.select("id", "th", "host", base_columns(F.col("body")).alias("b"))
    out = base.join(removed, same(base, removed, "id", "th", "host"), "left").select(
        base["id"], base["th"], base["host"], "b", "bad",
        F.coalesce("removed", F.lit(0)).alias("removed_chars"), base_failed("b").alias("base_failed"))
    out = out.withColumn("depleted", 100 * F.col("removed_chars") > max_percent * F.col("b.word_chars"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def line_quality(docs: DataFrame, **limits) -> DataFrame:
    """One row per document: doc_id, the base counts, ``removed_chars`` (word
    characters in boilerplate lines), ``base_failed``, ``depleted`` and ``kept``.
    ``limits`` as for ``verdicts``."""
    return verdicts(docs, **limits).select(F.col("id").alias("doc_id"), "b.*", "removed_chars",
                                           "base_failed", "depleted", "kept")


def without_lines(text: Column, bad: Column) -> Column:
    """The text without the lines whose hashes (h1, h2) are in ``bad``."""
    def stays(line: Column) -> Column:
        return let(line_key(line), lambda k: (k == "") | ~F.array_contains(
            bad, F.struct(F.xxhash64(k).alias("h1"), F.hash(k).alias("h2"))))
    return F.array_join(F.filter(F.split(text, "\n", -1), stays), "\n")


def drop_rejected(docs: DataFrame, host: str = "source", length: str | None = None, **limits) -> DataFrame:
    """The documents that the rules keep, without their lines above the limits. All columns
    pass through; ``length`` names one that holds the number of characters, and follows. The
    verdicts are written first; as a filter on the join below they would be computed twice."""
    kept = stored(verdicts(docs, host, **limits).select("id", "th", "host", "kept", "bad"), "verdicts")
    kept = kept.filter("kept").groupBy("id", "th", "host").agg(F.first("bad").alias("bad"))
    both = docs.join(kept, docs["doc_id"].eqNullSafe(kept["id"])
                     & text_hash(docs["text"]).eqNullSafe(kept["th"])
                     & docs[host].eqNullSafe(kept["host"]))
    text = F.when(kept["bad"].isNull(), docs["text"]).otherwise(without_lines(docs["text"], kept["bad"]))
    if length is None:
        return both.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])
    size = F.when(kept["bad"].isNull(), docs[length]).otherwise(F.char_length(text).cast(docs.schema[length].dataType))
    return both.select(*[text.alias(c) if c == "text" else size.alias(c) if c == length else docs[c]
                         for c in docs.columns])


def op3_quality_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return line_quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "removed_chars", "base_failed", "depleted", "kept")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, text, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 6)) AS p, ws FROM w WHERE len(ws) >= 8),
h AS (SELECT doc_id, p, array_to_string(ws[p:p + 7], ' ') AS win FROM g),
r AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (
    SELECT doc_id, unnest(range(p, p + 8)) AS q FROM (
      SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS c FROM h) WHERE c >= 2)
  GROUP BY doc_id),
l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (
  SELECT doc_id, source, text, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
d AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM k WHERE key <> '' GROUP BY doc_id),
hosts AS (
  SELECT source, greatest(20, ceil(count(DISTINCT text) / 10)) AS top FROM documents GROUP BY source),
bad AS (
  SELECT k.source, k.key FROM k JOIN hosts ON hosts.source = k.source WHERE k.key <> ''
  GROUP BY k.source, k.key, hosts.top HAVING count(DISTINCT k.text) >= hosts.top),
x AS (
  SELECT k.doc_id, sum(length(regexp_replace(k.key, '[\x20\x09-\x0D]', '', 'g'))) AS n
  FROM k JOIN bad ON bad.source = k.source AND bad.key = k.key GROUP BY k.doc_id),
b AS (
  SELECT w.doc_id, coalesce(len(ws), 0) AS n_words,
         coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')), 0) AS word_chars,
         coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS n_symbols,
         coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         CAST(coalesce(x.n, 0) AS BIGINT) AS removed_chars
  FROM w LEFT JOIN d USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       100 * removed_chars > 70 * word_chars AS depleted,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND NOT 100 * removed_chars > 70 * word_chars AS kept
FROM b
"""
