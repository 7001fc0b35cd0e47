"""Boundary rows for the four signal rules."""

import pytest
from conftest import ev, events_df

from retenza.operators import signals as S


def _one(spark, rows, fn):
    return fn(events_df(spark, rows), "30 seconds").collect()


@pytest.mark.parametrize("n,sev", [(0, None), (1, "low"), (2, "medium"), (3, "high"),
                                   (4, "high")])
def test_exit_risk_severity(spark, n, sev):
    rows = [ev(i, i, "exit-risk") for i in range(n)] + [ev(99, 1, "heartbeat")]
    out = _one(spark, rows, S.exit_risk_signal)
    assert [r["severity"] for r in out] == ([sev] if sev else [])


@pytest.mark.parametrize("d,sev", [(2, None), (3, "low"), (4, "low"), (5, "medium"),
                                   (6, "medium"), (7, "high")])
def test_search_friction(spark, d, sev):
    rows = [ev(i, i, "view-product", pid=f"p{i}", at="A", sc="S") for i in range(d)]
    out = _one(spark, rows, S.search_friction_signal)
    assert [r["severity"] for r in out] == ([sev] if sev else [])
    if sev:
        assert out[0]["distinctProducts"] == d
        assert out[0]["topic"]["value"] == "A"
    with_cart = rows + [ev(50, 20, "add-to-cart", pid="p0")]
    assert _one(spark, with_cart, S.search_friction_signal) == []


def test_friction_topic_tie_goes_to_first_to_reach_top(spark):
    seq = ["A", "B", "B", "A"]
    rows = [ev(i, i, "search", pid=f"p{i}", at=a, sc="S", query="q") for i, a in enumerate(seq)]
    out = _one(spark, rows, S.search_friction_signal)
    assert out[0]["topic"]["value"] == "B"


@pytest.mark.parametrize("items,sev,shown", [(None, "low", 1), (0, "low", 1), (1, "low", 1),
                                              (2, "medium", 2), (3, "high", 3)])
def test_cart_abandonment(spark, items, sev, shown):
    out = _one(spark, [ev(1, 1, "view-cart", items=items)], S.cart_abandonment_signal)
    assert out[0]["severity"] == sev
    assert f"cart with {shown} item(s)" in out[0]["evidence"]


def test_empty_strings_are_absent(spark):
    rows = [ev(1, 1, "add-to-cart", pid=""), ev(2, 2, "add-to-cart", pid="p1"),
            ev(3, 3, "add-to-cart", pid="p1")]
    out = _one(spark, rows, S.high_intent_signal)
    assert [r["productId"] for r in out] == ["p1"]
    assert out[0]["_id"].startswith("sess-1:highintent:p1:")


def test_signal_ids_use_window_bucket(spark):
    rows = [ev(1, 1, "exit-risk"), ev(2, 31, "exit-risk")]
    out = sorted(r["_id"] for r in _one(spark, rows, S.exit_risk_signal))
    assert len(out) == 2 and out[0] != out[1]


def test_all_signals_is_union_of_rules(spark):
    rows = [ev(1, 1, "exit-risk"), ev(2, 2, "view-cart", items=3),
            ev(3, 3, "add-to-cart", pid="p1")] + \
        [ev(10 + i, 4 + i, "view-product", pid=f"q{i}", at="A", sc="S", uid="u2", sid="s2")
         for i in range(3)]
    df = events_df(spark, rows)
    parts = sum(len(f(df, "30 seconds").collect()) for f in (
        S.exit_risk_signal, S.high_intent_signal, S.search_friction_signal,
        S.cart_abandonment_signal))
    assert S.all_signals(df, "30 seconds").count() == parts == 4
