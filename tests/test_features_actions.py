"""Churn features, tiers, rounding, top factor and the offer ladders."""

import pytest
from pyspark.sql import functions as F

from retenza.operators import actions as AC
from retenza.operators import analytics as A
from retenza.operators import features as FT
from retenza.schemas import CART_LADDER, EXIT_LADDER, FEATURE_COLUMNS


def sig_df(spark, rows):
    return spark.createDataFrame(rows, "uid string, sid string, signal string, severity string")


@pytest.mark.parametrize("p,tier", [(0.0, "Low"), (0.3, "Low"), (0.3000001, "Medium"),
                                    (0.6, "Medium"), (0.6000001, "High"), (1.0, "High"),
                                    (-0.5, None)])
def test_risk_tier_right_closed(spark, p, tier):
    df = spark.createDataFrame([(p,)], "churn_probability double")
    assert FT.risk_tier(df).collect()[0]["churn_risk_tier"] == tier


def test_share_rounding_half_even(spark):
    rows = [("u", "s", "exit-risk", "low")] + [("u", "s", "high-intent", "high")] * 3 + \
        [("u", "s", "search-friction", "low")] * 4
    mix = {r["signal"]: r["percentage"] for r in A.behavior_mix(sig_df(spark, rows)).collect()}
    assert mix == {"exit-risk": 12, "high-intent": 38, "search-friction": 50}


def test_features_users_without_nbas_and_label(spark):
    sig = sig_df(spark, [("u1", "s1", "exit-risk", "low"), ("u1", "s2", "exit-risk", "low"),
                         ("u1", "s2", "high-intent", "high"), ("u2", "s3", "search-friction", "low")])
    nbas = spark.createDataFrame([("u1", True), ("u1", False), ("u9", True)],
                                 "uid string, redeemed boolean")
    f = {r["uid"]: r for r in FT.churn_label(FT.churn_features(sig, nbas)).collect()}
    assert set(f) == {"u1", "u2"}                      # u9 has no signals: no row
    assert f["u2"]["total_nbas"] == 0 and f["u2"]["engagement_rate"] == 0.0
    assert f["u1"]["session_count"] == 2 and f["u1"]["signals_per_session"] == 1.5
    assert f["u1"]["exit_risk_ratio"] == pytest.approx(2 / 3)
    assert f["u1"]["churned"] == 0                     # engagement 0.5 >= 0.3
    assert f["u2"]["churned"] == 0                     # exit ratio 0
    assert list(FT.churn_features(sig, nbas).columns) == ["uid"] + FEATURE_COLUMNS


def test_top_factor_first_on_tie(spark):
    df = spark.createDataFrame([tuple([1.0] * 10)], ", ".join(f"{c} double" for c in FEATURE_COLUMNS))
    out = FT.top_risk_factor(df, [0.1] * 10).collect()[0]["top_risk_factor"]
    assert out == "total_signals"
    out2 = FT.top_risk_factor(df, [0.1] * 9 + [0.5]).collect()[0]["top_risk_factor"]
    assert out2 == "signals_per_session"


SEVERITIES = {"exit-risk": ["low", "medium", "high", "urgent"],
              "cart-abandonment": ["low", "medium", "high"]}


@pytest.mark.parametrize("signal", ["exit-risk", "cart-abandonment"])
def test_offer_ladders(spark, signal):
    ladder = EXIT_LADDER if signal == "exit-risk" else CART_LADDER
    rows, scores = [], []
    for i, sev in enumerate(SEVERITIES[signal]):
        for tier in ("High", "Medium", "Low", None):
            uid = f"{sev}-{tier}"
            rows.append((uid, "s", signal, sev))
            if tier:
                scores.append((uid, 0.5, tier, "exit_risk_ratio"))
    sig = sig_df(spark, rows)
    sc = spark.createDataFrame(scores, "uid string, churn_probability double, "
                                       "churn_risk_tier string, top_risk_factor string")
    out = AC.offer_enriched(sig, sc).collect()
    assert len(out) == len(rows)
    for r in out:
        base, enr, tier = r["baselineDecision"], r["enrichedDecision"], r["churnRiskTier"]
        assert base in ladder
        if tier == "High":
            assert enr == "FREE shipping and 25% off your order"
        elif tier == "Medium":
            i = ladder.index(base)
            assert enr == ladder[min(i + 1, len(ladder) - 1)]
        else:
            assert enr == base
        if enr in ladder:                                  # never below the baseline
            assert ladder.index(enr) >= ladder.index(base)
    off = AC.offer_enriched(sig, sc, enabled=False).collect()
    assert all(r["enrichedDecision"] is None for r in off)


def test_route_and_nba(spark):
    sig = spark.createDataFrame(
        [("i1", "u", "s", "exit-risk", "high", None), ("i2", "u", "s", "bogus", "low", None)],
        "_id string, uid string, sid string, signal string, severity string, productId string"
    ).withColumn("ts", F.current_timestamp())
    routed = {r["_id"]: (r["type"], r["status"]) for r in AC.route_signal(sig).collect()}
    assert routed == {"i1": ("shipping-discount", "ok"), "i2": (None, "error")}
    n = AC.nba_from_signals(sig).collect()
    assert len(n) == 1 and n[0]["redeemed"] is False
    assert n[0]["actionMetadata"]["triggeredBySignal"] == "high_exit-risk"
    assert n[0]["actionMetadata"]["baselineDecision"] == "25% off your order"
    red = AC.redeem(AC.nba_from_signals(sig), spark.createDataFrame([("i1",), ("i1",)],
                                                                    "signal_id string"))
    assert [r["redeemed"] for r in red.collect()] == [True]
