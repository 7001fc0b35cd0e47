"""A keyed table on Parquet: bounded upserts, ordered versions, replays that change nothing.

Rows are spread over a fixed number of buckets by a hash of their key. A
merge reads and rewrites only the buckets that its batch touches; a small
manifest per version says in which folder each bucket's rows are::

    <path>/manifest/v-00000000000000000007.json     one entry per bucket
    <path>/data/<write>/_bucket=<b>/part-*.parquet  rows, written once, never changed

A version exists as soon as its manifest does. Manifests are written beside and
renamed into place, and a rename never replaces one: of two writers that meet, one
starts again from the other's version. A write that dies before leaves the old
version as it was, and a folder that its replay overwrites. Versions count up over all
writers and checkpoints.

Streams name their micro-batches (``stream``, ``batch_id``); the manifest keeps the
last batch of each stream, so a replayed batch is known and skipped.

Readers keep the version they opened: the files of the newest ``KEEP`` versions stay.
Rows without a key are left out. Only manifests (a line per bucket) and the touched bucket
numbers reach the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import sinks as SK

KEEP = 2
BUCKET = "_bucket"
MERGES = ("upsert", "update", "insert", "latest", "add")


class ConcurrentWrite(RuntimeError):
    """Another writer kept taking the next version."""


class _Files:
    """The few file operations, by the Hadoop client that Spark itself uses."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.array = spark.sparkContext._gateway.new_array

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a whole file or none; False if there is one already."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        _, beside = self._at(f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf)
        try:
            context.rename(context.makeQualified(beside), context.makeQualified(p), self.array(rename, 0))
        except Exception as e:                               # py4j's error around Java's
            fs.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """A name for a stream: of its checkpoint folder and, once it has begun, of the id in there,
    so a folder that was emptied and used again is another stream."""
    name = SK.batch_name(checkpoint, 0).split("-")[0]
    files = _Files(spark)
    if "metadata" in files.names(checkpoint):
        name += "-" + json.loads(files.read(f"{checkpoint.rstrip('/')}/metadata"))["id"][:8]
    return name


class KeyedTable:
    """One row per ``key``; ``buckets`` is fixed when the first version is written
    (``rebucket`` changes it: choose it so that a bucket holds some 100 MB)."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.files = _Files(spark)

    # ------------------------------------------------------------ versions
    def versions(self) -> list[int]:
        return sorted(int(n[2:-5]) for n in self.files.names(f"{self.path}/manifest")
                      if n.startswith("v-") and n.endswith(".json"))

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifest/v-{version:020d}.json"

    def manifest(self, version: int | None = None) -> dict | None:
        """What a version (the newest one) is made of; None if there is none."""
        known = self.versions()
        if not known:
            return None
        return json.loads(self.files.read(self._manifest_path(known[-1] if version is None else version)))

    def _read(self, manifest: dict, buckets=None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/data/{write}/{BUCKET}={b}" for b, write in manifest["files"].items()
                 if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version (the newest one); None if there is none."""
        manifest = self.manifest(version)
        return None if manifest is None else self._read(manifest)

    def lookup(self, *keys) -> DataFrame | None:
        """The rows of some keys: only their buckets are read."""
        manifest = self.manifest()
        if manifest is None:
            return None
        kind = StructType.fromJson(manifest["schema"])[self.key].dataType
        wanted = self.spark.createDataFrame([(k,) for k in keys], StructType().add(self.key, kind))
        own = wanted.select(self._bucket(manifest["buckets"]).alias("b")).distinct().collect()
        return self._read(manifest, {r["b"] for r in own}).filter(F.col(self.key).isin(*keys))

    # ------------------------------------------------------------ writing
    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int")

    def _reduced(self, batch: DataFrame, how: str, order: str | None) -> DataFrame:
        batch = batch.filter(F.col(self.key).isNotNull())
        if how == "latest":
            from ..operators.commerce import latest_by_key
            return latest_by_key(batch, self.key, order)
        if how == "add":
            return self._added(batch, order)
        return SK.latest_rows(batch, self.key, order)

    def _added(self, rows: DataFrame, number: str) -> DataFrame:
        """One row per key with the sum of ``number``; the other columns belong to the key."""
        rest = [F.first(c).alias(c) for c in rows.columns if c not in (self.key, number)]
        return rows.groupBy(self.key).agg(F.sum(number).alias(number), *rest)

    def _merged(self, old: DataFrame, new: DataFrame, how: str, order: str | None) -> DataFrame:
        if how == "insert":
            return SK.merge_insert_if_absent(old, new, self.key)
        if how in ("latest", "add"):
            return self._reduced(old.unionByName(new, allowMissingColumns=True), how, order)
        if how == "update":
            new = new.join(old.select(self.key), self.key, "left_semi")
        return SK.upsert_scores(old, new, self.key, order)

    def _fitted(self, batch: DataFrame, schema: StructType) -> DataFrame:
        """Columns that the table has too, in its types."""
        kinds = {f.name: f.dataType for f in schema}
        return batch.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in batch.columns])

    def merge(self, batch: DataFrame, how: str = "upsert", order: str | None = None, stream: str | None = None,
              batch_id: int | None = None, attempts: int = 5) -> int:
        """Store the table with ``batch`` merged in and return its version.

        ``upsert``: the batch's columns replace the old ones, also with null; other columns
        stay; unseen keys are inserted. ``update``: the same for known keys only.
        ``insert``: unseen keys only. ``latest``: of old and new rows the one with the
        largest ``order``. ``add``: the number in column ``order`` is added to the old one. Of several rows of a key in a batch the one with the
        largest ``order`` counts. A batch of ``stream`` that is in the table
        already changes nothing.
        """
        if how not in MERGES:
            raise ValueError(f"how is one of {', '.join(MERGES)}")
        name = uuid.uuid4().hex if stream is None else f"{stream}-{batch_id}"
        current = self.manifest()
        buckets = current["buckets"] if current else self.buckets
        staged_at = f"{self.path}/staging/{name}"
        self._reduced(batch, how, order).withColumn(BUCKET, self._bucket(buckets)).write.mode("overwrite").parquet(staged_at)
        if stream is not None and current is not None and current["streams"].get(stream, -1) >= batch_id:
            self.files.remove(staged_at)                     # a stateful batch has to be run even so
            return current["version"]
        staged = self.spark.read.parquet(staged_at)
        touched = {r[BUCKET] for r in staged.select(BUCKET).distinct().collect()}      # bucket numbers
        try:
            for attempt in range(attempts):
                current = self.manifest()
                if current is not None and current["buckets"] != buckets:
                    raise ConcurrentWrite(f"{self.path} got other buckets")
                new = staged.drop(BUCKET)
                if current is None:
                    merged = new if how != "update" else new.limit(0)
                    schema, files, streams, version = merged.schema, {}, {}, 0
                else:
                    schema = StructType.fromJson(current["schema"])
                    merged = self._merged(self._read(current, touched), self._fitted(new, schema), how, order)
                    schema = StructType([*schema, *[f for f in merged.schema if f.name not in schema.names]])
                    files, streams, version = dict(current["files"]), dict(current["streams"]), current["version"] + 1
                write = f"{name}-{attempt}"
                files |= {str(b): write for b in self._write(merged.select(*schema.names), write, touched, buckets)}
                if stream is not None:
                    streams[stream] = batch_id
                made = {"version": version, "key": self.key, "buckets": buckets, "schema": schema.jsonValue(),
                        "files": files, "streams": streams}
                if self._commit(made):
                    return version
                self.files.remove(f"{self.path}/data/{write}")
            raise ConcurrentWrite(f"{self.path}: {attempts} attempts met other writers")
        finally:
            self.files.remove(staged_at)

    def _write(self, rows: DataFrame, write: str, touched: set[int], buckets: int) -> set[int]:
        """Write the rows by bucket; the buckets that have any."""
        if not touched:
            return set()
        rows.withColumn(BUCKET, self._bucket(buckets)).repartition(len(touched), BUCKET) \
            .write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/{write}")
        return {int(n.split("=")[1]) for n in self.files.names(f"{self.path}/data/{write}") if n.startswith(f"{BUCKET}=")}

    def _commit(self, made: dict) -> bool:
        if not self.files.create(self._manifest_path(made["version"]), json.dumps(made)):
            return False
        known = self.versions()
        for old in [v for v in known if v <= made["version"] - KEEP]:
            gone = self._folders(self.manifest(old))
            for v in known:
                if v != old:
                    gone -= self._folders(self.manifest(v))
            for folder in gone:
                self.files.remove(f"{self.path}/data/{folder}")
            self.files.remove(self._manifest_path(old))
            known.remove(old)
        return True

    @staticmethod
    def _folders(manifest: dict) -> set[str]:
        return {f"{write}/{BUCKET}={b}" for b, write in manifest["files"].items()}

    def rebucket(self, buckets: int) -> int:
        """Spread the rows over another number of buckets; rewrites the table."""
        current = self.manifest()
        write = uuid.uuid4().hex
        rows = self._read(current)
        written = self._write(rows, write, set(range(buckets)), buckets)
        made = current | {"version": current["version"] + 1, "buckets": buckets, "files": {str(b): write for b in written}}
        if not self._commit(made):
            self.files.remove(f"{self.path}/data/{write}")
            raise ConcurrentWrite(self.path)
        return made["version"]


def read_scores(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of the keyed table at ``path``; None if there is none."""
    return KeyedTable(spark, path, "uid").read()


def upsert_scores_to(spark: SparkSession, batch: DataFrame, path: str, key: str = "uid", buckets: int = 64,
                     stream: str | None = None, batch_id: int | None = None) -> DataFrame:
    """Store scores in the keyed table at ``path`` and return the table."""
    table = KeyedTable(spark, path, key, buckets)
    return table.read(table.merge(batch, "upsert", stream=stream, batch_id=batch_id))


def redeem_to(spark: SparkSession, redemption_log: DataFrame, path: str, key: str = "signal_id",
              stream: str | None = None, batch_id: int | None = None) -> DataFrame:
    """Set ``redeemed`` for the ids of a log in the keyed table of actions at ``path``; ids
    that it lacks are not added. Returns the table."""
    table = KeyedTable(spark, path, key)
    hits = redemption_log.select(key).withColumn("redeemed", F.lit(True))
    return table.read(table.merge(hits, "update", stream=stream, batch_id=batch_id))
