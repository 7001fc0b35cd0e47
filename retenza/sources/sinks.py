"""Sinks: keyed merges and table writes, idempotent under replays.

Each merge is expressed as a DataFrame (what the target holds after the
merge) plus a writer that appends only the new rows, so a re-run of the
same batch (a ``foreachBatch`` retry after an executor loss) changes
nothing.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Column of the folders that micro-batches write to.
BATCH = "_batch"


def new_rows_if_absent(target: DataFrame | None, batch: DataFrame, key: str = "_id",
                       unique: bool = False) -> DataFrame:
    """Rows of ``batch`` whose key the target lacks; duplicates in the batch
    collapse to one (whenMatched keepExisting, whenNotMatched insert), unless the batch is
    ``unique`` by its key."""
    fresh = batch if unique else batch.dropDuplicates([key])
    if target is None:
        return fresh
    return fresh.join(target.select(key), key, "left_anti")


def merge_insert_if_absent(target: DataFrame, batch: DataFrame, key: str = "_id") -> DataFrame:
    """The merged table: existing rows kept, unseen keys inserted."""
    return target.unionByName(new_rows_if_absent(target, batch, key), allowMissingColumns=True)


def latest_rows(batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: the one with the largest ``order`` (``scored_at`` if the
    batch has it), as the last of several updates wins; rows with equal order
    are told apart by their values, so a replay picks the same one."""
    order = order or ("scored_at" if "scored_at" in batch.columns else None)
    cols = [c for c in batch.columns if c != key]
    rank = F.struct(*([F.col(order)] if order else []), F.xxhash64(*cols))
    return batch.groupBy(key).agg(F.max_by(F.struct(*cols), rank).alias("_r")).select(key, "_r.*")


def upsert_scores(target: DataFrame | None, batch: DataFrame, key: str = "uid",
                  order: str | None = None) -> DataFrame:
    """update_one({key}, $set, upsert): fields present in the batch replace the
    old ones, also with null; fields it lacks keep the old value; unseen keys
    are inserted. Of several rows of a key the latest counts (``latest_rows``)."""
    latest = latest_rows(batch, key, order)
    if target is None:
        return latest
    cols = [c for c in target.columns if c != key]
    new = latest.withColumn("_new", F.lit(True))
    j = target.alias("o").join(new.alias("n"), key, "full_outer")
    out = [F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
           if c in latest.columns else F.col(f"o.{c}").alias(c) for c in cols]
    extra = [F.col(f"n.{c}").alias(c) for c in latest.columns if c != key and c not in cols]
    return j.select(key, *out, *extra)


def merge_session_state(target_rows: DataFrame | None, batch_rows: DataFrame,
                        key: str = "sessionId", unique: bool = False) -> DataFrame:
    """Idempotent session merge: window rows are stored keyed by
    (session, window start) and combined on read (``session_state_flat``),
    so a replayed window is a no-op instead of a double count. ``unique``: the batch has each
    key once, as a window aggregate does."""
    keyed = batch_rows.withColumn("_wkey", F.concat_ws("|", F.col(key),
                                                       F.col("window.start").cast("string")))
    return new_rows_if_absent(target_rows, keyed, "_wkey", unique)


def _file_system(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether committed data files lie under ``path``. No marker file is asked
    for: object stores are often written without one."""
    fs, hpath = _file_system(spark, path)
    if not fs.exists(hpath):
        return False
    files = fs.listFiles(hpath, True)
    while files.hasNext():
        file = files.next().getPath()
        if file.getName().startswith("part-") and "/_temporary/" not in file.toString():
            return True
    return False


def remove(spark: SparkSession, path: str) -> None:
    fs, hpath = _file_system(spark, path)
    fs.delete(hpath, True)


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` without the column of its batch folders; None if it has no data."""
    if not has_data(spark, path):
        return None
    return spark.read.option("mergeSchema", "true").parquet(path).drop(BATCH)


def fitted(df: DataFrame, schema: StructType, new_columns: bool = False) -> DataFrame:
    """``df`` with the columns of ``schema``, by name, in its order and types; missing ones are
    null. Columns that the schema lacks are refused, or follow at the end with ``new_columns``."""
    own = {c.lower(): c for c in df.columns}
    extra = [c for c in df.columns if c.lower() not in {f.name.lower() for f in schema}]
    if extra and not new_columns:
        raise ValueError(f"the table has no column {', '.join(extra)}")
    cols = [(df[own[f.name.lower()]] if f.name.lower() in own else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema]
    return df.select(*cols, *[df[c] for c in extra])


def append_table(df: DataFrame, path: str, new_columns: bool = False) -> None:
    """Append rows to the Parquet table at ``path`` in the table's own schema (``fitted``), so
    that all its files are alike: a reader takes the schema of any one of them. With
    ``new_columns`` a batch may bring columns; such a table is read with ``read_if_exists``."""
    spark = df.sparkSession
    if has_data(spark, path):
        known = spark.read.option("mergeSchema", "true").parquet(path)
        df = fitted(df, known.schema, new_columns)
    df.write.mode("append").parquet(path)


def overwrite_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                    lookup_key: str | None = None, row_group_bytes: int = 8 << 20) -> None:
    """Replace the table. With ``lookup_key`` it is laid out for ``tables.lookup_by_key``: rows in
    ranges of the key, sorted, in row groups of about ``row_group_bytes`` with a bloom filter each,
    so an equality on the key skips nearly all of them by min and max, and an absent key
    that lies between them by the filter."""
    if lookup_key:
        df = df.repartitionByRange(lookup_key).sortWithinPartitions(*(partition_by or []), lookup_key)
    w = df.write.mode("overwrite")
    if lookup_key:
        w = w.option(f"parquet.bloom.filter.enabled#{lookup_key}", "true").option("parquet.block.size", row_group_bytes)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def batch_name(checkpoint: str, batch_id: int) -> str:
    """A name for one micro-batch of one stream; another checkpoint's batches differ."""
    return f"b{zlib.crc32(checkpoint.encode()):08x}-{batch_id}"


def insert_if_absent_to(spark: SparkSession, batch: DataFrame, path: str, key: str = "_id",
                        since: str | None = None, batch_id: str | None = None,
                        lowest=None) -> None:
    """Add the batch's unseen keys to the Parquet table at ``path``.

    Only the key column of the existing table is read (column pruning), and
    the anti join makes a replayed batch add nothing. ``since`` names an
    event-time column that a duplicate key must share with its original
    (a signal's window end, a session window's start): the existing table is
    then read only from the batch's earliest value on (``lowest``, if the
    caller knows it), which Parquet skips by row-group statistics, so each
    batch costs O(batch), not O(table).

    With ``batch_id`` (``batch_name``) the rows go to a folder of that batch,
    which a replay overwrites: what a failed first attempt may have left is
    replaced, not taken for earlier rows. ``read_if_exists`` reads all batches.
    """
    target = spark.read.parquet(path) if has_data(spark, path) else None
    if target is not None and batch_id is not None and BATCH in target.columns:
        target = target.filter(F.coalesce(F.col(BATCH) != batch_id, F.lit(True)))
    if target is not None and since is not None:
        if lowest is None:
            lowest = batch.agg(F.min(since).alias("lo")).first()["lo"]
            if lowest is None:
                return
        target = target.filter(F.col(since) >= F.lit(lowest))
    fresh = new_rows_if_absent(target, batch, key)
    if batch_id is None:
        fresh.write.mode("append").parquet(path)
    else:
        fresh.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
