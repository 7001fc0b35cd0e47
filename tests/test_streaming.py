"""Stream = batch for signals and session state; replays and late rows."""

import os
import tempfile
import time

from conftest import ev, events_df, seven_events
from pyspark.sql import functions as F

from retenza.operators import signals as S
from retenza.operators import windows as W
from retenza.sources.tables import event_source
from retenza.streaming import drivers as DR


def _rows():
    a = seven_events()
    b = [ev(100 + i, 40 + i, "view-product", uid="u2", sid="s2", pid=f"p{i}", at="A" if i % 2 else "B",
            sc="S", brand="b") for i in range(5)]
    c = [ev(200, 65, "view-cart", uid="u3", sid="s3", items=2),
         ev(201, 66, "exit-risk", uid="u3", sid="s3"), ev(202, 67, "exit-risk", uid="u3", sid="s3"),
         ev(203, 70, "search", uid="u3", sid="s3", pid="p1", at="A", sc="S", query="blue")]
    return [a, b, c]


def _write_files(spark, base, chunks):
    for i, rows in enumerate(chunks):
        events_df(spark, rows).coalesce(1).write.parquet(os.path.join(base, f"f{i}"))
        time.sleep(1.1)       # distinct modification times keep the file order


def _signal_rows(df):
    return sorted((r["_id"], r["signal"], r["severity"], r["uid"], str(r["ts"]),
                   r["productId"], r["distinctProducts"]) for r in df.collect())


def test_signal_stream_equals_batch_and_replay(spark):
    tmp = tempfile.mkdtemp(prefix="retenza-stream-")
    src = os.path.join(tmp, "events")
    chunks = _rows()
    closing = [[ev(999, 600, "heartbeat", uid="z", sid="z")]]          # closes every window
    _write_files(spark, src, chunks + closing)
    glob = os.path.join(src, "*")
    out = os.path.join(tmp, "signals")
    stream = event_source(spark, glob, max_files=1)
    DR.run_to_completion(DR.signal_stream(stream, out, os.path.join(tmp, "ck1")))
    batch = S.all_signals(events_df(spark, [r for c in chunks for r in c]), "30 seconds")
    assert _signal_rows(spark.read.parquet(out)) == _signal_rows(batch)
    n = spark.read.parquet(out).count()
    # a replay from scratch (new checkpoint) inserts nothing twice
    DR.run_to_completion(DR.signal_stream(event_source(spark, glob, max_files=1), out,
                                          os.path.join(tmp, "ck2")))
    assert spark.read.parquet(out).count() == n


def test_late_file_is_dropped(spark):
    tmp = tempfile.mkdtemp(prefix="retenza-late-")
    src = os.path.join(tmp, "events")
    out = os.path.join(tmp, "signals")
    _write_files(spark, src, [[ev(1, 1000, "exit-risk", uid="u", sid="s")],
                              [ev(2, 2000, "heartbeat", uid="u", sid="s")]])
    glob = os.path.join(src, "*")
    ck = os.path.join(tmp, "ck")
    DR.run_to_completion(DR.signal_stream(event_source(spark, glob, max_files=1), out, ck))
    before = spark.read.parquet(out).count()
    _write_files(spark, os.path.join(src, "late"), [[ev(3, 5, "exit-risk", uid="u", sid="s")]])
    late_glob = os.path.join(src, "*", "*")           # picks up the late file too
    DR.run_to_completion(DR.signal_stream(event_source(spark, late_glob, max_files=1), out, ck))
    assert spark.read.parquet(out).count() == before == 1


def test_session_state_stream_equals_batch(spark):
    tmp = tempfile.mkdtemp(prefix="retenza-state-")
    src = os.path.join(tmp, "events")
    chunks = _rows()
    _write_files(spark, src, chunks + [[ev(999, 600, "heartbeat", uid="z", sid="z")]])
    paths = {k: os.path.join(tmp, k) for k in ("rows", "hist", "dlq", "intent")}
    qs = DR.session_state_stream(event_source(spark, os.path.join(src, "*"), max_files=1),
                                 paths["rows"], paths["hist"], paths["dlq"],
                                 os.path.join(tmp, "ck"), window="10 seconds",
                                 intent_path=paths["intent"])
    DR.run_to_completion(qs)
    rows = spark.read.parquet(paths["rows"]).drop("_wkey")
    hist = spark.read.parquet(paths["hist"])
    streamed = W.flat_session_state(W.session_state_flat(rows, hist)).drop("lastWindow_start")
    allrows = events_df(spark, [r for c in chunks for r in c])
    valid, dlq = W.dead_letter_split(allrows)
    batch = W.flat_session_state(W.session_state_flat(
        W.session_window_rows(valid, "10 seconds"),
        W.search_history_long(valid, "10 seconds"))).drop("lastWindow_start")
    key = lambda df: sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())
    assert key(streamed) == key(batch)
    assert spark.read.parquet(paths["dlq"]).filter(F.col("event_id") == 200).count() == 1
    intent = spark.read.parquet(paths["intent"])
    for dim, fn in (("productId", W.intent_products), ("articleType", W.intent_article_types),
                    ("subCategory", W.intent_sub_categories)):
        want = sorted((str(r["window"]["start"]), r["sessionId"], r[dim], r["weight"],
                       round(r["focus"], 9), r["viewCount"])
                      for r in fn(valid, "10 seconds").collect())
        got = sorted((str(r["window"]["start"]), r["sessionId"], r["key"], r["weight"],
                      round(r["focus"], 9), r["viewCount"])
                     for r in intent.filter(F.col("dimension") == dim).collect())
        assert got == want


def test_nba_stream_is_idempotent(spark):
    tmp = tempfile.mkdtemp(prefix="retenza-nba-")
    sig = S.all_signals(events_df(spark, [r for c in _rows() for r in c]), "30 seconds")
    sig.write.parquet(os.path.join(tmp, "signals"))
    out = os.path.join(tmp, "nbas")
    DR.run_to_completion(DR.nba_stream(spark, os.path.join(tmp, "signals"), out,
                                       os.path.join(tmp, "ck1")))
    DR.run_to_completion(DR.nba_stream(spark, os.path.join(tmp, "signals"), out,
                                       os.path.join(tmp, "ck2")))     # replay from scratch
    assert spark.read.parquet(out).count() == sig.count()


def test_waiting_too_short_raises(spark, tmp_path):
    import pytest

    src = spark.readStream.format("rate").load()
    q = src.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).start()
    with pytest.raises(TimeoutError):
        DR.run_to_completion(q, timeout_s=1)
    assert not q.isActive


def test_feed_of_one_session_and_latest_feed(spark, tmp_path):
    sig = spark.createDataFrame([("1", "u", "s1", 1), ("2", "u", "s2", 2), ("3", "v", "s1", 3)],
                                "_id string, uid string, sid string, n int")
    sig.write.parquet(str(tmp_path / "sig"))
    got = []
    DR.run_to_completion(DR.signal_feed(
        spark, str(tmp_path / "sig"), lambda b, i: got.extend(r["_id"] for r in b.collect()),
        str(tmp_path / "ck1"), uid="u", sid="s1"))
    assert got == ["1"]
    feed = "key string, v int, x string"
    for i, rows in enumerate([[("a", 1, "p"), ("b", 5, "q")], [("a", 3, "r"), ("b", 4, "s"), ("c", 1, "t")]]):
        spark.createDataFrame(rows, feed).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        src = spark.readStream.schema(feed).parquet(str(tmp_path / "feed"))
        DR.run_to_completion(DR.latest_feed(src, str(tmp_path / "out"), str(tmp_path / "ck2"), "key", "v"))
    from retenza.sources.keyed import read_scores
    table = sorted(map(tuple, read_scores(spark, str(tmp_path / "out")).collect()))
    assert table == [("a", 3, "r"), ("b", 5, "q"), ("c", 1, "t")]


def test_product_message_is_the_same_in_stream_and_batch(spark, tmp_path):
    """Two users want one product in different batches; the count is over all signals."""
    from retenza.operators.actions import nba_from_signals

    evs = [ev(1, 0, "add-to-cart", uid="u1", sid="s1", pid="p1", at="A", sc="S", brand="b"),
           ev(2, 1, "add-to-cart", uid="u2", sid="s2", pid="p1", at="A", sc="S", brand="b")]
    sig = S.all_signals(events_df(spark, evs), "30 seconds")
    products = spark.createDataFrame([("p1",)], "_id string")
    path, out, ck = (str(tmp_path / x) for x in ("signals", "nbas", "ck"))
    for user in ("u1", "u2"):                                   # both are there before the stream runs
        sig.filter(F.col("uid") == user).write.mode("append").parquet(path)

    def messages(df):
        return sorted((r["signal_id"], r["embedInProduct"]["message"]) for r in df.collect())
    DR.run_to_completion(DR.nba_stream(spark, path, out, ck, products=products))
    want = messages(nba_from_signals(spark.read.parquet(path), products=products))
    assert messages(spark.read.parquet(out)) == want and len(want) == 2
    assert all(m.startswith("2 people") for _, m in want)
