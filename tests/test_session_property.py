"""Session window rows and intent focus against a plain-Python brute force."""

import datetime as dt
import math

from conftest import ev, events_df
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from retenza.operators import windows as W

NAMES = ["heartbeat", "search", "view-product", "add-to-cart", "exit-risk"]
WEIGHT = {"search": 1, "view-product": 3, "add-to-cart": 7}
W_S = 10


def brute(rows):
    groups = {}
    for eid, (uid, sid, event), ts, md in rows:
        secs = (ts - dt.datetime(1970, 1, 1)).total_seconds()
        groups.setdefault((math.floor(secs / W_S), sid), []).append((ts, eid, uid, event, md))
    win, focus = {}, {}
    for (w, sid), evs in groups.items():
        evs.sort(key=lambda e: (e[0], e[1]))
        last = max(evs, key=lambda e: (e[3] == "exit-risk", e[0], e[1]))
        counts = tuple(sum(e[3] == n for e in evs) for n in NAMES)
        per, total = {}, 0
        for e in evs:
            wt = WEIGHT.get(e[3], 0)
            if wt > 0 and e[4][0]:
                per[e[4][0]] = per.get(e[4][0], 0) + wt
                total += wt
        win[(w, sid)] = (evs[0][2], last[3], counts, total)
        for k, v in per.items():
            focus[(w, sid, k)] = (v, round(v / total, 9))
    return win, focus


event_st = st.tuples(st.sampled_from(NAMES), st.integers(0, 29), st.sampled_from(["s1", "s2"]),
                     st.sampled_from(["u1", "u2"]),
                     st.sampled_from([None, "", "p1", "p2", "p3"]))


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(event_st, min_size=1, max_size=25))
def test_window_rows_and_focus(spark, evs):
    rows = [ev(i, secs, e, uid=u, sid=s, pid=p, at="A", sc="S", query="q")
            for i, (e, secs, s, u, p) in enumerate(evs)]
    df = events_df(spark, rows)
    want_win, want_focus = brute(rows)
    got_win = {}
    for r in W.session_window_rows(df, "10 seconds").collect():
        w = math.floor((r["window"]["start"] - dt.datetime(1970, 1, 1)).total_seconds() / W_S)
        got_win[(w, r["sessionId"])] = (
            r["userId"], r["lastEvent"]["event"], tuple(r["eventCounts"][n] for n in NAMES),
            r["dimensionTotals"]["productWeightTotal"])
    assert got_win == want_win
    got_focus = {}
    for r in W.intent_products(df, "10 seconds").collect():
        w = math.floor((r["window"]["start"] - dt.datetime(1970, 1, 1)).total_seconds() / W_S)
        got_focus[(w, r["sessionId"], r["productId"])] = (r["weight"], round(r["focus"], 9))
    assert got_focus == want_focus
