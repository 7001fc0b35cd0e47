"""Reports kept up to date by signed partial counts.

A report is a set of counts (a cube) in a keyed table. Each batch of a feed is reduced to
partial counts and added; a redemption moves an action from one cell to another, as
-1 here and +1 there. Shares and rates are finished when a report is read, from one row per
cell, so reading costs what the cells cost, not what the signals or actions
do, and a batch costs what its own cells' buckets cost.

Batches count once: the tables know the last batch of every stream (``sources.keyed``). Where a
batch changes both the actions and their counts, the counts go first: they are worked out against
the actions as they were before the batch, and a replay after a crash between the two
finds the counts done and the actions still to be stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable
from . import analytics as A


class CountCube:
    """Counts by ``dims`` in a keyed table."""

    def __init__(self, spark: SparkSession, path: str, dims: tuple[str, ...], buckets: int = 64):
        self.dims, self.table = dims, KeyedTable(spark, path, "cell", buckets)

    def add(self, rows: DataFrame, stream: str | None = None, batch_id: int | None = None) -> None:
        """Add rows (``dims``, n); n may be negative."""
        cell = F.to_json(F.struct(*self.dims), {"ignoreNullFields": "false"}).alias("cell")
        self.table.merge(rows.groupBy(*self.dims).agg(F.sum("n").alias("n")).select(cell, *self.dims, "n"), "add", "n",
                         stream, batch_id)

    def by(self, *dims: str) -> DataFrame:
        """(dims, count) of the cells that aren't empty; no rows before the first batch."""
        rows = self.table.read()
        if rows is None:
            raise ValueError(f"no batch has been added to {self.table.path}")
        return rows.groupBy(*dims).agg(F.sum("n").alias("count")).filter(F.col("count") != 0)


class SignalReports:
    """Reports over a feed of signals (each signal once, as the signal table holds them)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.cube = CountCube(spark, path, ("uid", "signal", "severity", "day"), buckets)

    def add(self, signals: DataFrame, stream: str | None = None, batch_id: int | None = None) -> None:
        self.cube.add(signals.select("uid", "signal", "severity", F.to_date("ts").alias("day"), F.lit(1).cast("long")
                                     .alias("n")), stream, batch_id)

    def behavior_mix(self) -> DataFrame:
        return A.shares(self.cube.by("uid", "signal"), "signal")

    def signal_distribution(self) -> DataFrame:
        return self.cube.by("signal").orderBy(F.desc("count"), "signal")

    def signal_severity_distribution(self) -> DataFrame:
        return self.cube.by("signal", "severity").orderBy(F.desc("signal"), F.desc("count"), "severity")

    def signals_by_day(self) -> DataFrame:
        return self.cube.by("day", "signal").orderBy("day", "signal")


class ActionReports:
    """Reports over next best actions and their redemptions."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.actions = KeyedTable(spark, f"{path}/actions", "signal_id", buckets)
        self.cube = CountCube(spark, f"{path}/counts", ("uid", "type", "redeemed"), buckets)

    def add(self, nbas: DataFrame, stream: str | None = None, batch_id: int | None = None) -> None:
        """New actions; those whose ``signal_id`` is known change nothing."""
        rows = nbas.select("signal_id", "uid", "type", F.coalesce("redeemed", F.lit(False)).alias("redeemed")) \
            .dropDuplicates(["signal_id"])
        old = self.actions.read()
        fresh = rows if old is None else rows.join(old.select("signal_id"), "signal_id", "left_anti")
        one = F.lit(1).cast("long").alias("n")
        self.cube.add(fresh.select("uid", "type", "redeemed", one), stream, batch_id)
        self.actions.merge(rows, "insert", stream=stream, batch_id=batch_id)

    def redeem(self, log: DataFrame, stream: str | None = None, batch_id: int | None = None) -> None:
        """Ids of redeemed actions; unknown ones and those redeemed before change nothing."""
        old = self.actions.read()
        if old is None:
            return
        ids = log.select("signal_id").distinct()
        hits = old.filter(~F.col("redeemed")).join(ids, "signal_id", "left_semi")
        moves = hits.select("uid", "type", F.explode(F.array(
            F.struct(F.lit(False).alias("redeemed"), F.lit(-1).cast("long").alias("n")),
            F.struct(F.lit(True).alias("redeemed"), F.lit(1).cast("long").alias("n")))).alias("m"))
        self.cube.add(moves.select("uid", "type", "m.redeemed", "m.n"), stream, batch_id)
        self.actions.merge(ids.withColumn("redeemed", F.lit(True)), "update", stream=stream, batch_id=batch_id)

    def nba_mix(self) -> DataFrame:
        return A.shares(self.cube.by("uid", "type"), "type")

    def engaged_mix(self) -> DataFrame:
        done = self.cube.by("uid", "type", "redeemed").filter("redeemed")
        return A.shares(done.select("uid", F.col("type").alias("actionType"), "count"), "actionType")

    def most_responsive_action(self) -> DataFrame:
        return A.first_of_mix(self.engaged_mix())

    def unredeemed_count(self) -> DataFrame:
        """Per user, with 0 for users whose actions are all redeemed."""
        return self.cube.by("uid", "redeemed").groupBy("uid").agg(
            F.sum(F.when(~F.col("redeemed"), F.col("count")).otherwise(F.lit(0))).alias("unredeemed"))

    def nba_distribution(self) -> DataFrame:
        return self.cube.by("type").orderBy(F.desc("count"), "type")

    def nba_redeemed_distribution(self) -> DataFrame:
        return self.cube.by("type", "redeemed").orderBy("type", "redeemed")

    def redemption_rate(self) -> DataFrame:
        hit = F.sum(F.when(F.col("redeemed"), F.col("count")).otherwise(F.lit(0)))
        return self.cube.by("type", "redeemed").rollup("type").agg(
            F.sum("count").alias("total"), hit.alias("redeemed"), (hit / F.sum("count")).alias("redemption_rate")) \
            .orderBy(F.col("type").asc_nulls_last())
