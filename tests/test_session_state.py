"""The reference's seven-event session case and session-state rules."""

from conftest import ev, events_df, seven_events
from pyspark.sql import functions as F

from retenza.operators import signals as S
from retenza.operators import windows as W


def test_seven_event_session_state(spark):
    valid, dlq = W.dead_letter_split(events_df(spark, seven_events()))
    assert dlq.count() == 0
    docs = W.session_window_agg(valid, "10 seconds")
    assert docs.count() == 3
    st = W.session_state(docs).collect()
    assert len(st) == 1
    s = st[0]
    counts = s["sessionTotals"]["eventCounts"].asDict()
    assert counts == {"heartbeat": 2, "search": 1, "view-product": 2, "add-to-cart": 1,
                      "exit-risk": 1}
    assert s["sessionTotals"]["windowCount"] == 3
    assert s["last10s"]["lastEvent"]["event"] == "exit-risk"
    assert s["lastEvent"]["event"] == "exit-risk"
    assert s["searchHistory"] == ["running shoes"]
    prods = s["last10s"]["intent"]["products"]
    assert [(p["productId"], p["weight"], p["focus"], p["addToCartCount"]) for p in prods] \
        == [("p1", 7, 1.0, 1)]
    assert s["userId"] == "user-1"


def test_flat_state_equals_nested(spark):
    valid = events_df(spark, seven_events())
    rows = W.session_window_rows(valid, "10 seconds")
    flat = W.flat_session_state(W.session_state_flat(
        rows, W.search_history_long(valid, "10 seconds"))).collect()[0]
    assert flat["windowCount"] == 3 and flat["view_product_count"] == 2
    assert flat["lastEvent_event"] == "exit-risk" and flat["searchCount"] == 1


def test_seven_event_signals_in_one_30s_window(spark):
    sig = S.all_signals(events_df(spark, seven_events()), "30 seconds").collect()
    kinds = sorted((r["signal"], r["severity"], r["productId"]) for r in sig)
    assert kinds == [("exit-risk", "low", None), ("high-intent", "high", "p1")]
    for r in sig:
        assert r["ts"].second == 30            # window end
        assert r["_id"].startswith("sess-1:")


def test_view_cart_and_missing_article_type_go_to_dlq(spark):
    rows = [ev(1, 0, "view-cart", items=2),
            ev(2, 1, "view-product", pid="p1", sc="x", brand="b"),       # no articleType
            ev(3, 2, "view-product", pid="p1", at="", sc="x", brand="b")]  # '' passes
    valid, dlq = W.dead_letter_split(events_df(spark, rows))
    assert sorted(r["event_id"] for r in dlq.collect()) == [1, 2]
    assert [r["event_id"] for r in valid.collect()] == [3]


def test_exit_risk_beats_later_events(spark):
    rows = [ev(1, 1, "exit-risk"), ev(2, 5, "heartbeat"), ev(3, 6, "search", pid="p", at="a",
                                                              sc="s", query="q")]
    r = W.session_window_rows(events_df(spark, rows), "10 seconds").collect()[0]
    assert r["lastEvent"]["event"] == "exit-risk"


def test_intent_skips_blank_keys_and_zero_weights(spark):
    rows = [ev(1, 0, "view-product", pid="", at="A", sc="S"),
            ev(2, 1, "heartbeat", pid="p9", at="A", sc="S"),
            ev(3, 2, "search", pid="p1", at="A", sc="S", query="x")]
    lg = W.intent_products(events_df(spark, rows), "10 seconds").collect()
    assert [(r["productId"], r["weight"], r["focus"]) for r in lg] == [("p1", 1, 1.0)]
    at = W.intent_article_types(events_df(spark, rows), "10 seconds").collect()
    assert [(r["articleType"], r["weight"], r["viewCount"]) for r in at] == [("A", 4, 1)]


def test_window_rows_are_per_session(spark):
    rows = seven_events() + [ev(8, 1, "heartbeat", uid="u2", sid="s2")]
    n = W.session_window_rows(events_df(spark, rows), "10 seconds") \
        .filter(F.col("sessionId") == "s2").count()
    assert n == 1
