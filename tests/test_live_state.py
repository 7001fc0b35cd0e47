"""The live session state: stream = batch, replays, restarts, expiry."""

from __future__ import annotations

import json
import os
import random
import subprocess
import sys
import time

import pytest
from conftest import ev, events_df, seven_events
from pyspark.sql import functions as F

from retenza.operators import windows as W
from retenza.sources.keyed import KeyedTable
from retenza.sources.tables import event_source
from retenza.streaming import drivers as DR
from retenza.streaming import live_state as L

CLOSING = [ev(9999, 20_000, "heartbeat", uid="z", sid="~z")]


def some_events(seed=3, n=160):
    rng, out = random.Random(seed), seven_events()
    for i in range(n):
        event = rng.choice(["heartbeat", "search", "view-product", "add-to-cart", "exit-risk"])
        product = None if event in ("heartbeat", "exit-risk") else rng.choice(["p1", "p2", "é", ""])
        out.append(ev(100 + i, i * 2, event, uid=f"u{i % 5}", sid=f"s{rng.randrange(4)}", pid=product,
                      at=product and rng.choice(["A", "B"]), sc=product and "S", brand="b",
                      query=rng.choice(["blue", "", "red shoes"]) if event == "search" else None))
    return out


def files(spark, base, chunks, start=0):
    for i, rows in enumerate(chunks, start):
        events_df(spark, rows).coalesce(1).write.parquet(os.path.join(base, f"f{i}"))
        time.sleep(1.1)


def run(spark, base, **options):
    q = L.live_session_state(event_source(spark, os.path.join(base, "in", "*"), max_files=1), os.path.join(base, "out"),
                             os.path.join(base, "ck"), buckets=4, **options)
    DR.run_to_completion(q)


def flat(df):
    rows = df.filter("sessionId <> '~z'").select(
        "sessionId", "userId", "firstSeen", "lastSeen", "lastEvent", "lastWindow", "eventCounts", "windowCount",
        "searchHistory", *W.DIMENSIONS).collect()
    return sorted((r["sessionId"], r["userId"], r["firstSeen"], r["lastSeen"], tuple(r["lastEvent"]),
                   tuple(r["lastWindow"]), tuple(r["eventCounts"]), r["windowCount"], tuple(r["searchHistory"]),
                   *(tuple((*x[:5], round(x[5], 9)) for x in r[n]) for n in W.DIMENSIONS)) for r in rows)


def batch_state(spark, rows):
    valid, _ = W.dead_letter_split(events_df(spark, rows))
    state = W.session_state(W.session_window_agg(valid, "10 seconds"))
    return flat(state.select("*", F.col("last10s.window").alias("lastWindow"),
                             *[F.col(f"last10s.intent.{n}").alias(n) for n in W.DIMENSIONS],
                             F.col("sessionTotals.eventCounts").alias("eventCounts"),
                             F.col("sessionTotals.windowCount").alias("windowCount")))


def test_live_state_equals_batch_and_restarts(spark, tmp_path):
    """Two runs over one checkpoint; the second goes on where the first ended."""
    rows, base = some_events(), str(tmp_path)
    rows.sort(key=lambda r: r[2])
    files(spark, base + "/in", [rows[:60], rows[60:90]])
    run(spark, base)
    middle = L.read_live_state(spark, base + "/out").count()
    files(spark, base + "/in", [rows[90:], CLOSING], 2)
    run(spark, base)
    got = L.read_live_state(spark, base + "/out")
    assert middle > 0 and flat(got) == batch_state(spark, rows)
    counts = {r["sessionId"]: r["searchCount"] for r in got.collect()}
    assert counts["sess-1"] == 1
    versions = KeyedTable(spark, base + "/out", "partId").versions()
    run(spark, base)                                     # nothing new: no version
    assert KeyedTable(spark, base + "/out", "partId").versions() == versions


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """The sink's last batch again, as after a crash between its commit and the checkpoint's."""
    rows, base = some_events(5, 60), str(tmp_path)
    rows.sort(key=lambda r: r[2])
    files(spark, base + "/in", [rows, CLOSING])
    run(spark, base)
    before = flat(L.read_live_state(spark, base + "/out"))
    commits = sorted((f for f in os.listdir(base + "/ck/commits") if f.isdigit()), key=int)
    version = KeyedTable(spark, base + "/out", "partId").versions()[-1]
    os.remove(f"{base}/ck/commits/{commits[-1]}")
    crc = f"{base}/ck/commits/.{commits[-1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    run(spark, base)
    assert flat(L.read_live_state(spark, base + "/out")) == before == batch_state(spark, rows)
    assert KeyedTable(spark, base + "/out", "partId").versions()[-1] == version


def test_state_leaves_after_its_expiry(spark, tmp_path):
    """Long pauses: the state store holds only young sessions, and what comes back is not lost."""
    base = str(tmp_path)
    rows = [ev(1, 0, "search", sid="old", pid="p", at="A", sc="S", query="one"), ev(2, 1, "heartbeat", sid="old"),
            ev(3, 400, "heartbeat", sid="young"), ev(4, 800, "search", sid="old", pid="q", at="B", sc="S", query="two"),
            ev(5, 801, "exit-risk", sid="old")]
    files(spark, base + "/in", [rows[:2], rows[2:3]])
    run(spark, base, expiry_ms=60_000)
    files(spark, base + "/in", [[ev(6, 500, "heartbeat", sid="young")], rows[3:], CLOSING], 2)
    run(spark, base, expiry_ms=60_000)
    table = KeyedTable(spark, base + "/out", "partId").read()
    assert table.filter("sessionId = 'old'").count() == 2
    assert flat(L.read_live_state(spark, base + "/out")) == batch_state(spark, [*rows, ev(6, 500, "heartbeat", sid="young")])
    left = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "summary").load(base + "/ck")
    assert left.count() <= 1                             # all but perhaps the closing session have expired


class Store:
    """A group's list state and timers, counting the calls."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], [], 0

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, rows

    def clear(self):
        self.calls, self.rows = self.calls + 1, []

    def registerTimer(self, ms):
        self.calls, self.timers = self.calls + 1, [*self.timers, ms]

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def fact(session, start, event="heartbeat", eid=1, uid="u", **more):
    """A row for the processor; times are seconds."""
    first = {"ts": start * 10**6, "uid": uid} | ({} if eid is None else {"eid": eid})
    last = {"p": 0, "ts": start * 10**6, "event": event} | ({} if eid is None else {"eid": eid})
    return session, json.dumps({"start": start * 10**6, "end": (start + 10) * 10**6, "event": event, "n": 1, "weight": 0,
                                "first": first, "last": last, "firstSeen": start * 10**6, "lastSeen": start * 10**6} | more)


def processor(expiry_ms=60_000):
    import pandas as pd

    store, p = Store(), L.SessionStateProcessor(expiry_ms)
    p.init(store)
    return store, lambda *facts: [json.loads(x) for frame in p.handleInputRows(
        (0,), iter([pd.DataFrame([f], columns=["sessionId", "fact"]) for f in facts]), At(0)) for x in frame["document"]], p


def test_calls_to_the_state_do_not_grow_with_the_sessions():
    """A call costs more than a session's merge: a group of 500 takes a few, at each batch."""
    store, feed, _ = processor()
    for start in (0, 10):
        store.calls = 0
        got = feed(*[fact(f"s{i}", start) for i in range(500)])
        assert store.calls <= 5 and sorted(d["sessionId"] for d in got) == sorted(f"s{i}" for i in range(500))
    assert {d["windowCount"] for d in got} == {2} and {d["eventCounts"]["heartbeat"] for d in got} == {2}
    assert len(store.rows) == 500 and store.timers == [20_000 + 60_000]


def test_sessions_of_a_group_expire_one_by_one():
    store, feed, p = processor()
    feed(fact("old", 0))
    feed(fact("young", 30), fact("new", 50))
    assert store.timers == [70_000]
    store.timers.clear()                                  # Spark takes a timer that has fired
    assert list(p.handleExpiredTimer((0,), At(70_001), None)) == []
    assert sorted(r[0] for r in store.rows) == ["new", "young"] and store.timers == [100_000]
    store.timers.clear()
    list(p.handleExpiredTimer((0,), At(100_000), None))   # due then, not before
    assert sorted(r[0] for r in store.rows) == ["new", "young"] and store.timers == [100_000]
    store.timers.clear()
    list(p.handleExpiredTimer((0,), At(10**6), None))
    assert store.rows == [] and store.timers == []


def test_events_without_an_id_come_first():
    _, feed, _ = processor()
    got, = feed(fact("s", 0, "search", 2, "b", query="two"), fact("s", 0, "search", None, "a", query="none"))
    assert got["userId"] == "a" and got["searchHistory"] == ["none", "two"]


def test_texts_and_all_sessions_in_one_group(spark, tmp_path):
    """Quotes, controls and wide characters pass; the sessions of one group don't mix."""
    base, text = str(tmp_path), 'a "b" \\ \n\t\x01 é 漢 😀 {"sessionId": 1}, [null]'
    rows = some_events(9, 60) + [ev(900 + i, 3 * i, "search", uid="u", sid=s, pid=text, at=text, sc="S", query=text)
                                 for i, s in enumerate(["s1", text, text + "'"])]
    rows.sort(key=lambda r: r[2])
    files(spark, base + "/in", [rows[:30], rows[30:], CLOSING])
    run(spark, base, groups=1)
    assert flat(L.read_live_state(spark, base + "/out")) == batch_state(spark, rows)


def test_intent_of_a_window():
    import pandas as pd

    rows = pd.DataFrame({"event": ["search", "add-to-cart", "view-product", "heartbeat"], "n": [2, 1, 1, 4],
                         "weight": [2, 7, 3, 0], "productId": ["b", "a", "b", None]})
    assert L.window_intent(rows, "productId") == [("a", 0, 0, 1, 7, 7 / 12), ("b", 2, 1, 0, 5, 5 / 12)]
    assert L.window_intent(rows[3:], "productId") == []


def test_runs_in_a_session_of_spark_defaults(spark, tmp_path):
    """A session that names no state store: the query brings its own, and leaves the setting."""
    rows, base = some_events(7, 40), str(tmp_path)
    rows.sort(key=lambda r: r[2])
    files(spark, base + "/in", [rows, CLOSING])
    plain = spark.newSession()
    plain.conf.set("spark.sql.shuffle.partitions", 4)
    plain.conf.set("spark.sql.session.timeZone", "UTC")
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    plain.conf.set(L._PROVIDER, default)
    run(plain, base)
    assert flat(L.read_live_state(spark, base + "/out")) == batch_state(spark, rows)
    assert plain.conf.get(L._PROVIDER) == default


def test_the_processor_needs_no_package(tmp_path):
    """A worker that doesn't find this package can still read the processor."""
    from pyspark import cloudpickle
    (tmp_path / "p").write_bytes(cloudpickle.dumps(L.SessionStateProcessor))
    code = "import pickle, sys; print(pickle.load(open(sys.argv[1], 'rb')).__name__)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path / "p")], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == "SessionStateProcessor", done.stderr


@pytest.mark.parametrize("path", ["none"])
def test_no_table_yet(spark, tmp_path, path):
    assert L.read_live_state(spark, str(tmp_path / path)) is None
