"""all_signals against a plain-Python brute force of the four rules.

Random small sessions (blank and null keys, repeated products, ties in
articleType counts, several users per session) are scored by Spark and by
a direct loop over the events in arrival order (timestamp, event_id).
"""

import datetime as dt
import math

from conftest import BASE, ev, events_df
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from retenza.operators import signals as S

EVENTS = ["heartbeat", "search", "view-product", "add-to-cart", "exit-risk", "view-cart"]
W = 30


def brute(rows):
    groups = {}
    for r in rows:
        eid, (uid, sid, event), ts, md = r
        secs = (ts - dt.datetime(1970, 1, 1)).total_seconds()
        groups.setdefault((math.floor(secs / W), sid), []).append((ts, eid, uid, event, md))
    out = set()
    for (w, sid), evs in groups.items():
        evs.sort(key=lambda e: (e[0], e[1]))
        uid = evs[0][2]
        last = max(e[0] for e in evs)
        bucket = math.floor((last - dt.datetime(1970, 1, 1)).total_seconds() * 1000 / (W * 1000))
        n_exit = sum(e[3] == "exit-risk" for e in evs)
        if n_exit:
            sev = "high" if n_exit >= 3 else "medium" if n_exit == 2 else "low"
            out.add((f"{sid}:exitrisk:{bucket}", "exit-risk", sev, uid, None, None, None))
        for pid in {e[4][0] for e in evs if e[3] == "add-to-cart" and e[4][0]}:
            out.add((f"{sid}:highintent:{pid}:{bucket}", "high-intent", "high", uid, pid, None, None))
        carts = sum(e[3] == "add-to-cart" for e in evs)
        viewed = {e[4][0] for e in evs if e[3] in ("view-product", "search") and e[4][0]}
        if carts == 0 and len(viewed) >= 3:
            d = len(viewed)
            sev = "high" if d >= 7 else "medium" if d >= 5 else "low"
            counts, top, top_n = {}, None, 0
            for e in evs:
                a = e[4][1]
                if e[3] in ("view-product", "search") and a:
                    counts[a] = counts.get(a, 0) + 1
                    if counts[a] > top_n:
                        top_n, top = counts[a], a
            out.add((f"{sid}:searchfriction:{bucket}", "search-friction", sev, uid, None, d, top))
        n_vc = sum(e[3] == "view-cart" for e in evs)
        if n_vc:
            vals = [e[4][5] if e[3] == "view-cart" else 0 for e in evs]
            vals = [v for v in vals if v is not None]
            mx = max(vals) if vals else None
            items = mx if mx is not None and mx > 0 else 1
            sev = "high" if items >= 3 else "medium" if items == 2 else "low"
            out.add((f"{sid}:cartabandon:{bucket}", "cart-abandonment", sev, uid, None, None, None))
    return out


event_st = st.tuples(
    st.sampled_from(EVENTS),
    st.integers(0, 89),                                   # second offset: three windows
    st.sampled_from(["s1", "s2"]),
    st.sampled_from(["u1", "u2"]),
    st.sampled_from([None, "", "p1", "p2", "p3", "p4", "p5", "p6", "p7", "p8"]),
    st.sampled_from([None, "", "A", "B", "C"]),
    st.sampled_from([None, 0, 1, 2, 3]),
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(event_st, min_size=1, max_size=30))
def test_all_signals_matches_brute_force(spark, evs):
    rows = [ev(i, secs, e, uid=u, sid=s, pid=p, at=a, sc="S", query="q", items=n)
            for i, (e, secs, s, u, p, a, n) in enumerate(evs)]
    got = {(r["_id"], r["signal"], r["severity"], r["uid"], r["productId"],
            r["distinctProducts"], r["topic"]["value"] if r["topic"] else None)
           for r in S.all_signals(events_df(spark, rows), "30 seconds").collect()}
    assert got == brute(rows)
    assert BASE.second == 0
