"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and is written before the next one reads it. All stages but the last
return the columns of ``documents``; extra columns pass through.

1. quality_rules   documents that the base rules or the line rules reject go, and with them the
                   lines above their host's limits; n_chars follows
2. line_dedup      lines found in 10 documents or more go; n_chars follows
3. near_dedup      of each class of near-duplicates the smallest id stays
4. decontaminate   documents with benchmark passages in 5 % of their words go
5. packing         token pieces placed into sequences of 1024
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retenza.llm import decontaminate, line_dedup, line_quality, near_dup, packing
from retenza.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.drop_rejected(docs, length="n_chars")


def frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text stays null; n_chars is the new text's length."""
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    new = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long"))
           .otherwise(F.col("row.n_chars"))}
    return line_dedup.line_dedup(docs).select(*[
        new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_copies(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", frequent_lines), ("near_dedup", near_dedup),
          ("decontaminate", benchmark_free), ("packing", packed)]

#: Alignment, tokenisation and packing have no SQL form; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
