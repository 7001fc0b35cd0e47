"""Maintained reports: any split into batches, replays and crashes give the batch reports."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from retenza.operators import analytics as A
from retenza.operators import maintained as M

NBA = "signal_id string, uid string, type string, redeemed boolean"
TYPES = ["shipping-discount", "cart-rescue", "social-proof-notification"]


def nba_rows(n, seed=1):
    rng = random.Random(seed)
    return [(f"s{i}", f"u{rng.randrange(6)}", rng.choice(TYPES), rng.random() < 0.1) for i in range(n)]


def same(a, b):
    def plain(df):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in
                       df.select(*sorted(df.columns)).collect()), key=str)
    assert plain(a) == plain(b)


REPORTS = ("nba_mix", "engaged_mix", "most_responsive_action", "unredeemed_count", "nba_distribution",
           "nba_redeemed_distribution", "redemption_rate")


@pytest.mark.parametrize("seed", [1, 2])
def test_action_reports_equal_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, reports = nba_rows(80, seed), M.ActionReports(spark, str(tmp_path), 4)
    state, redeemed, left, step = {}, set(), list(rows), 0
    while left:
        k = rng.randint(10, 40)
        batch, left = left[:k] + rng.sample(rows, 5), left[k:]     # some were there before or come again
        for r in batch:
            state.setdefault(r[0], r)
        for _ in range(2):                                         # the second is a replay
            reports.add(spark.createDataFrame(batch, NBA), "nbas", step)
        log = [(i,) for i in rng.sample(sorted(state), 6)] + [("unknown",), (None,)]
        redeemed |= {i for (i,) in log}
        for _ in range(2):
            reports.redeem(spark.createDataFrame(log, "signal_id string"), "log", step)
        step += 1
    whole = spark.createDataFrame([(i, u, t, d or i in redeemed) for i, u, t, d in state.values()], NBA)
    for name in REPORTS:
        same(getattr(reports, name)(), getattr(A, name)(whole))


def test_a_crash_between_counts_and_actions(spark, tmp_path, monkeypatch):
    reports = M.ActionReports(spark, str(tmp_path), 2)
    reports.add(spark.createDataFrame(nba_rows(10), NBA), "nbas", 0)
    more = spark.createDataFrame(nba_rows(20), NBA)
    log = spark.createDataFrame([("s1",), ("s2",), ("s15",)], "signal_id string")

    def dies(*a, **k):
        raise OSError("lost")
    for call in (lambda r: r.add(more, "nbas", 1), lambda r: r.redeem(log, "log", 0)):
        monkeypatch.setattr(reports.actions, "merge", dies)
        with pytest.raises(OSError):
            call(reports)
        monkeypatch.undo()
        call(reports)
    want = [(i, u, t, d or i in ("s1", "s2", "s15")) for i, u, t, d in nba_rows(20)]
    same(reports.nba_redeemed_distribution(), A.nba_redeemed_distribution(spark.createDataFrame(want, NBA)))


def test_signal_reports_equal_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"s{i}", rng.choice(["u1", "u2", None]), rng.choice(["exit-risk", "high-intent"]), rng.choice(["low", "high"]),
             dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randrange(72))) for i in range(60)]
    schema, reports = "_id string, uid string, signal string, severity string, ts timestamp", M.SignalReports(spark, str(tmp_path), 4)
    for step, i in enumerate(range(0, 60, 23)):
        for _ in range(2):
            reports.add(spark.createDataFrame(rows[i:i + 23], schema), "signals", step)
    whole = spark.createDataFrame(rows, schema)
    for name in ("behavior_mix", "signal_distribution", "signal_severity_distribution", "signals_by_day"):
        same(getattr(reports, name)(), getattr(A, name)(whole))


def test_reports_of_nothing(spark, tmp_path):
    reports = M.ActionReports(spark, str(tmp_path), 2)
    with pytest.raises(ValueError):
        reports.nba_mix()
    reports.redeem(spark.createDataFrame([("a",)], "signal_id string"))
    reports.add(spark.createDataFrame([], NBA))
    assert reports.nba_mix().count() == 0
