"""The streamed friction path: the join with searches, late ones, restarts, and its actions."""

from __future__ import annotations

import datetime as dt
import os
import random
import time

from conftest import BASE, ev, events_df
from pyspark.sql import functions as F

from retenza.operators import text_index as TX
from retenza.operators.actions import nba_from_signals
from retenza.operators.search import product_recommendation
from retenza.sources.tables import event_source
from retenza.streaming import drivers as DR
from retenza.streaming import friction as FR

SIGNAL = ("_id string, sid string, uid string, signal string, severity string, evidence string, ts timestamp, "
          "productId string, distinctProducts long, topic struct<dimension:string,value:string>")
HORIZON_S = 120


def sig(i, secs, signal="search-friction", uid="u", sid="s", topic="Topic"):
    return (f"sig{i}", sid, uid, signal, "high", "e", BASE + dt.timedelta(seconds=secs), "p1", 1,
            ("articleType", topic) if signal == "search-friction" else None)


def search(i, secs, query, uid="u", sid="s"):
    return ev(i, secs, "search", uid=uid, sid=sid, pid="p1", at="A", sc="S", brand="b", query=query)


#: Neither a search nor friction: all rows of a stream move its watermark.
CLOSE_EVENT, CLOSE_SIGNAL = ev(99_999, 90_000, "heartbeat", uid="~", sid="~"), sig(99_999, 90_000, "exit-risk", "~", "~")


def write(spark, path, rows, schema=None):
    df = spark.createDataFrame(rows, schema) if schema else events_df(spark, rows)
    df.coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)


def brute(signals, searches):
    out = []
    for s in signals:
        if s[3] != "search-friction":
            continue
        near = [(e[2], e[0], e[3][4]) for e in searches if e[1][:2] == (s[2], s[1]) and e[3][4]
                and s[6] - dt.timedelta(seconds=HORIZON_S) <= e[2] < s[6]]
        out.append((s[0], len(near), max(near)[2] if near else s[9][1]))
    return sorted(out)


def run_intents(spark, base, keep=("_id", "historyLength", "intentSummary")):
    """The joined stream into a table, over one checkpoint."""
    signals = FR.signal_source(spark, f"{base}/signals", spark.createDataFrame([], SIGNAL).schema)
    searches = FR.searches_of(event_source(spark, f"{base}/events", max_files=1))
    q = (FR.friction_intents(signals, searches, f"{HORIZON_S} seconds").select(*keep).writeStream.format("parquet")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    DR.run_to_completion(q)
    return sorted(tuple(r) for r in spark.read.schema("_id string, historyLength long, intentSummary string")
                  .parquet(f"{base}/out").collect() if r["_id"] != "sig99999")


def test_join_equals_brute_force_and_restarts(spark, tmp_path):
    rng, base = random.Random(4), str(tmp_path)
    searches = sorted((search(i, rng.randrange(600), rng.choice(["blue", "red", ""]), f"u{rng.randrange(3)}",
                              f"s{rng.randrange(2)}") for i in range(60)), key=lambda e: e[2])
    signals = sorted((sig(i, rng.randrange(600), rng.choice(["search-friction", "exit-risk"]), f"u{rng.randrange(4)}",
                          f"s{rng.randrange(2)}") for i in range(40)), key=lambda s: s[6])
    write(spark, f"{base}/events", searches[:30])
    write(spark, f"{base}/signals", [s for s in signals if s[6] <= searches[29][2]], SIGNAL)
    first = run_intents(spark, base)
    write(spark, f"{base}/events", searches[30:])
    write(spark, f"{base}/signals", [s for s in signals if s[6] > searches[29][2]], SIGNAL)
    write(spark, f"{base}/events", [CLOSE_EVENT])
    write(spark, f"{base}/signals", [CLOSE_SIGNAL], SIGNAL)
    got = run_intents(spark, base)
    want = brute(signals, searches)
    assert got == want and len(first) < len(got)
    assert any(n == 0 for _, n, _ in want) and any(n > 1 for _, n, _ in want)


def test_late_searches_do_not_count(spark, tmp_path):
    base = str(tmp_path)
    write(spark, f"{base}/events", [search(1, 10, "early"), search(2, 5_000, "much later", "v", "v")])
    write(spark, f"{base}/signals", [sig(1, 60), sig(2, 5_000, "exit-risk"), sig(3, 5_000, uid="v", sid="v")], SIGNAL)
    assert run_intents(spark, base) == [("sig1", 1, "early")]
    write(spark, f"{base}/events", [search(3, 50, "late")])              # behind the watermark
    write(spark, f"{base}/events", [CLOSE_EVENT])
    write(spark, f"{base}/signals", [CLOSE_SIGNAL], SIGNAL)
    assert run_intents(spark, base) == [("sig1", 1, "early"), ("sig3", 0, "Topic")]


def test_stream_of_all_actions_equals_batch(spark, tmp_path):
    """Friction through the join, the others as before; a replay from scratch adds nothing."""
    base = str(tmp_path)
    products = spark.createDataFrame(
        [(f"p{i}", n, "Shoe", "S", "b", (f"/{i}.jpg",)) for i, n in enumerate(["blue shoe", "red hat", "green bag"])],
        "_id string, name string, articleType string, subCategory string, brand string, image struct<url:string>")
    searches = [search(1, 10, "blue"), search(2, 20, "red hat"), search(3, 15, "green", "w", "w")]
    signals = [sig(1, 30), sig(2, 40, "exit-risk"), sig(3, 30, uid="x", sid="x", topic="Shoe"),
               sig(4, 30, uid="w", sid="w"), sig(5, 45, "cart-abandonment")]
    write(spark, f"{base}/events", [*searches, CLOSE_EVENT])
    write(spark, f"{base}/signals", [*signals, CLOSE_SIGNAL], SIGNAL)
    schema = spark.createDataFrame([], SIGNAL).schema
    for index, ck in ((None, "ck1"), (TX.build_text_index(products, f"{base}/ix"), "ck2")):
        DR.run_to_completion(FR.nba_enriched_stream(
            spark, f"{base}/signals", event_source(spark, f"{base}/events"), f"{base}/nbas", f"{base}/{ck}", products,
            horizon=f"{HORIZON_S} seconds", index=index, schema=schema))
    rows = spark.createDataFrame(signals, SIGNAL)
    intents = spark.createDataFrame(brute(signals, searches), "signal_id string, n long, intentSummary string") \
        .join(rows.select(F.col("_id").alias("signal_id"), "sid"), "signal_id").select("signal_id", "sid", "intentSummary")
    want = nba_from_signals(rows, products=products, recommendations=product_recommendation(intents, products, 1))

    def plain(df):
        return sorted((r["signal_id"], r["type"], r["actionMetadata"]["message"],
                       (r["actionMetadata"]["productRecommendation"] or {"name": None})["name"])
                      for r in df.filter("signal_id <> 'sig99999'").collect())
    got = plain(spark.read.parquet(f"{base}/nbas"))
    assert got == plain(want) and [r[3] for r in got] == ["red hat", None, "blue shoe", "green bag", None]
    assert os.path.exists(f"{base}/nbas")


def test_the_stream_input_is_written_by_many_tasks(spark, tmp_path):
    """One file per task and day half, not one task for half of the events; the closing event comes last."""
    from retenza.plans import registry as R
    sf = "/root/testdata/sf0.001"
    parts = tmp_path / "sf"
    parts.mkdir()
    for name in os.listdir(sf):
        if name != "events.parquet":
            os.symlink(f"{sf}/{name}", parts / name)
    spark.read.parquet(f"{sf}/events.parquet").repartition(4).write.parquet(str(parts / "events.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        at = R._event_files(spark, str(parts), str(tmp_path / "base"))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len([f for f in os.listdir(tmp_path / "base/in/a") if f.endswith(".parquet")]) > 1
    rows = spark.read.parquet(at)
    want = spark.read.parquet(f"{sf}/events.parquet")
    assert rows.count() == want.count() + 1
    end = rows.filter(F.col("tags.sessionId") == R.END_SESSION).first()
    last = want.agg(F.max(F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 YEAR")).alias("t")).first()["t"]
    assert end["timestamp"] == last
