"""Batch and stream readers over Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import EVENTS


def event_source(spark: SparkSession, path: str, schema: StructType = EVENTS,
                 watermark: str | None = "0 seconds", max_files: int | None = None) -> DataFrame:
    """Stream of events from a Parquet folder, event time = ``timestamp``.

    The schema is fixed (no inference); ``watermark`` is the allowed
    lateness (the reference's is 0).
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.parquet(path)
    if watermark is not None:
        df = df.withWatermark("timestamp", watermark)
    return df


def scan_filter_project(spark: SparkSession, path: str, where: Column | str | None = None,
                        cols: list[str] | None = None) -> DataFrame:
    """find(filter, projection): the filter and the columns reach the Parquet
    scan (PushedFilters / ReadSchema)."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    if cols:
        df = df.select(*cols)
    return df


def lookup_by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Rows whose ``key`` equals ``value`` (one document by id, or the rows of
    one user); an equality filter that Parquet can use for row-group skipping."""
    return df.filter(F.col(key) == F.lit(value))


def footer_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table_name, total) of Parquet tables from the row counts in their footers: the count is
    pushed into the scan, which reads no data page. The settings that this needs hold in a
    session of its own; a number per table reaches the driver."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    rows = [(name, count_of_footers(own, path).first()["total"] or 0) for name, path in paths.items()]   # null: no footer
    return spark.createDataFrame(rows, "table_name string, total long")


def count_of_footers(session: SparkSession, path: str) -> DataFrame:
    return session.read.parquet(path).agg(F.count(F.lit(1)).alias("total"))
