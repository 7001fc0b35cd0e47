"""Day-partitioned derived tables: changed days only, and the rows of a full build."""

from __future__ import annotations

import os

import pytest
from conftest import BASE, ev, events_df
from pyspark.sql import functions as F

from retenza.operators import signals as S
from retenza.schemas import EVENTS
from retenza.sources.derived import DayTable

DAY_S = 86_400


def day_events(day, n, salt=0):
    return [ev(day * 1000 + salt * 100 + i, day * DAY_S + 40 * i, "exit-risk" if i % 3 else "add-to-cart", sid=f"s{i % 4}",
               pid="p1" if i % 3 == 0 else None) for i in range(n)]


def put(spark, path, rows, mode="append"):
    events_df(spark, rows).withColumn("day", F.to_date("timestamp")).coalesce(1) \
        .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def derive(events):
    return S.flat_signals(S.all_signals(events, "30 seconds")).withColumn("day", F.to_date(F.col("ts") - F.expr("INTERVAL 1 SECOND")))


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names
            if f.endswith(".parquet")}


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def test_only_changed_days_are_built(spark, tmp_path):
    source, table = str(tmp_path / "in"), DayTable(spark, str(tmp_path / "out"))
    everything = [r for d in range(4) for r in day_events(d, 12)]
    put(spark, source, everything)
    assert len(table.refresh(source, EVENTS, derive)) == 4
    assert rows_of(table.read()) == rows_of(derive(events_df(spark, everything)))
    before = files(table.path)
    assert table.refresh(source, EVENTS, derive) == [] and files(table.path) == before
    more = day_events(2, 5, salt=3)                              # one day changes
    put(spark, source, more)
    (day,) = table.refresh(source, EVENTS, derive)
    assert day == str((BASE.date().replace(day=BASE.day + 2)))
    after = files(table.path)
    assert {f for f in before if f in after} == {f for f in before if f"day={day}" not in f}
    assert all(f"day={day}" in f for f in after if f not in before)
    assert rows_of(table.read()) == rows_of(derive(events_df(spark, everything + more)))


def test_days_that_go_or_give_nothing(spark, tmp_path):
    source, table = str(tmp_path / "in"), DayTable(spark, str(tmp_path / "out"))
    put(spark, source, [r for d in range(3) for r in day_events(d, 6)])
    table.refresh(source, EVENTS, derive)
    put(spark, source, [ev(1, 0, "heartbeat")], "overwrite")      # day 0 has no signal now
    gone = f"{source}/day={BASE.date().replace(day=BASE.day + 1)}"
    spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).delete(
        spark._jvm.org.apache.hadoop.fs.Path(gone), True)
    assert len(table.refresh(source, EVENTS, derive)) == 2
    assert rows_of(table.read()) == rows_of(derive(events_df(spark, day_events(2, 6))))


def test_a_refresh_that_dies_is_done_again(spark, tmp_path):
    source, table = str(tmp_path / "in"), DayTable(spark, str(tmp_path / "out"))
    put(spark, source, day_events(0, 6))

    def dies(rows):
        raise OSError("lost")
    with pytest.raises(OSError):
        table.refresh(source, EVENTS, dies)
    assert len(table.refresh(source, EVENTS, derive)) == 1

    def wrong(rows):
        return derive(rows).withColumn("day", F.date_add("day", 1))
    put(spark, source, day_events(0, 2, salt=5))
    with pytest.raises(ValueError):
        table.refresh(source, EVENTS, wrong)
    assert len(table.refresh(source, EVENTS, derive)) == 1
    assert table.read().count() == derive(events_df(spark, day_events(0, 6) + day_events(0, 2, salt=5))).count()
