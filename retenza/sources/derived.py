"""Derived tables by day: only days whose input changed are computed again.

The input lies in folders ``<day>=<date>``. What a day's files are (names, sizes, times) is
summed up to a fingerprint in Spark, and held against that of the last refresh. The rows
of changed days alone are read, derived and written, with dynamic partition overwrite, so the
other days' files stay as they are. The fingerprints are stored last: a refresh that
dies is done again from the start and writes the same partitions.

The rule from input to output must stay within a day, as windows that divide a day do. One
number per day reaches the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .keyed import _Files


class DayTable:
    """The derived table at ``path``, partitioned by ``day``."""

    def __init__(self, spark: SparkSession, path: str, day: str = "day"):
        self.spark, self.path, self.day = spark, path.rstrip("/"), day
        self.files, self.state = _Files(spark), f"{self.path}-state/days.json"

    def _days(self, source: str) -> dict[str, list[int]]:
        """For each input day: files, bytes and a hash of names, sizes and times."""
        if not [n for n in self.files.names(source) if n.startswith(f"{self.day}=")]:
            return {}
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet") \
            .load(f"{source.rstrip('/')}/{self.day}=*").select("path", "modificationTime", "length")   # no content
        day = F.regexp_extract("path", f"/{self.day}=([^/]+)/", 1)
        rows = found.groupBy(day.alias("d")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"),
            F.bit_xor(F.xxhash64("path", "modificationTime", "length")).alias("h")).collect()
        return {r["d"]: [r["n"], r["b"], r["h"]] for r in rows}

    def _known(self) -> dict[str, list[int]]:
        folder = self.state.rsplit("/", 1)
        return json.loads(self.files.read(self.state)) if folder[1] in self.files.names(folder[0]) else {}

    def refresh(self, source: str, schema: StructType, build: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Bring the table up to the input at ``source`` and return the days that were done.

        ``schema``: of the input without the day. ``build``: input rows (with the day
        column) to output rows with it. Days that left the input, or give no rows now, leave the table."""
        now, known = self._days(source), self._known()
        changed = sorted(d for d in {*now, *known} if now.get(d) != known.get(d))
        if not changed:
            return []
        there = [d for d in changed if d in now]
        written = set()
        if there:
            kind = StructType([*schema.fields, *StructType().add(self.day, "date").fields])
            rows = self.spark.read.schema(kind).parquet(source) \
                .filter(F.col(self.day).isin(*[F.to_date(F.lit(d)) for d in there]))
            staged = f"{self.path}-state/staged"
            build(rows).write.mode("overwrite").parquet(staged)
            out = self.spark.read.parquet(staged)
            written = {str(r["d"]) for r in out.select(F.col(self.day).cast("string").alias("d")).distinct().collect()}
            stray = written - set(there)
            if stray:
                raise ValueError(f"rows of {', '.join(sorted(stray))} came out of other days")
            out.repartition(self.day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
                .partitionBy(self.day).parquet(self.path)
            self.files.remove(staged)
        for d in changed:
            if d not in written:
                self.files.remove(f"{self.path}/{self.day}={d}")
        self.files.remove(self.state)
        self.files.create(self.state, json.dumps(now))
        return changed

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)
