"""Column expressions over events and signals (``Column -> Column``).

All rules are native Catalyst expressions, so they stay inside
whole-stage code generation; no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EVENT_WEIGHTS, REQUIRED_FIELDS, SESSION_EVENTS

def EV() -> Column:
    return F.col("tags.event")


def SID() -> Column:
    return F.col("tags.sessionId")


def UID() -> Column:
    return F.col("tags.userId")


def TS() -> Column:
    return F.col("timestamp")


def md(name: str) -> Column:
    return F.col(f"metadata.{name}")


def present(c: Column) -> Column:
    """Truthy string: not null and not the empty string."""
    return c.isNotNull() & (c != F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def validate_event() -> Column:
    """The session-state validator (type tests become null tests).

    sessionId, userId, timestamp present; event one of five names;
    heartbeat/exit-risk, or productId+articleType+subCategory present;
    search needs a query. '' passes (the validator tests type only).
    Null-safe: a null anywhere yields false, never null.
    """
    ok = (SID().isNotNull() & UID().isNotNull() & TS().isNotNull()
          & EV().isin(*SESSION_EVENTS)
          & (EV().isin("heartbeat", "exit-risk")
             | (md("productId").isNotNull() & md("articleType").isNotNull()
                & md("subCategory").isNotNull()))
          & ((EV() != F.lit("search")) | md("query").isNotNull()))
    return F.coalesce(ok, F.lit(False))


def validate_required_fields() -> Column:
    """Client rule: every required field of the event is truthy.

    Unknown events have no rule and pass, like the client.
    """
    cond = None
    for event, fields in REQUIRED_FIELDS.items():
        req = F.lit(True)
        for f in fields:
            req = req & present(md(f))
        cond = (F.when(EV() == event, req) if cond is None
                else cond.when(EV() == event, req))
    return F.coalesce(cond.otherwise(F.lit(True)), F.lit(False))


def match_identified_events() -> Column:
    """Signal pipelines' filter: a date and two string ids."""
    return F.coalesce(TS().isNotNull() & SID().isNotNull() & UID().isNotNull(), F.lit(False))


def event_weight(event: Column | None = None) -> Column:
    event = EV() if event is None else event
    expr = None
    for name, w in EVENT_WEIGHTS.items():
        expr = F.when(event == name, F.lit(w)) if expr is None else expr.when(event == name, F.lit(w))
    return expr.otherwise(F.lit(0))


def event_priority(event: Column | None = None) -> Column:
    event = EV() if event is None else event
    return F.when(event == "exit-risk", F.lit(1)).otherwise(F.lit(0))


def window_ms(window: str) -> int:
    """Length of a window string such as '30 seconds' or '1 day' in ms."""
    n, unit = window.split()
    unit = unit.lower().rstrip("s")
    factor = {"millisecond": 1, "second": 1000, "minute": 60_000,
              "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}[unit]
    return int(n) * factor


def signal_bucket(last_ts: Column, window: str = "30 seconds") -> Column:
    return F.floor(F.unix_millis(last_ts) / F.lit(window_ms(window))).cast("long")


def signal_id(sid: Column, kind: str, last_ts: Column, window: str = "30 seconds",
              product: Column | None = None) -> Column:
    """``sid:kind[:productId]:floor(lastTs / window)``."""
    parts = [sid, F.lit(kind)]
    if product is not None:
        parts.append(product)
    parts.append(signal_bucket(last_ts, window).cast("string"))
    return F.concat_ws(":", *parts)


def window_end_ts(window: Column, last_ts: Column) -> Column:
    return F.coalesce(window.getField("end"), last_ts)


def severity_by_count(n: Column, medium_at: int = 2, high_at: int = 3) -> Column:
    return (F.when(n >= high_at, F.lit("high"))
            .when(n == medium_at, F.lit("medium"))
            .otherwise(F.lit("low")))


def split_trigger(trigger: Column) -> Column:
    """``severity_signal`` -> struct(severity, signal), split at the first '_'."""
    parts = F.split(trigger, "_", 2)
    return F.struct(parts.getItem(0).alias("severity"), parts.getItem(1).alias("signal"))
