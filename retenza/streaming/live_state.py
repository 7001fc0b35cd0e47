"""Session state kept live: a state store of the live sessions, documents as windows close.

Events are first combined at window grain (``windows.session_facts``, append mode
behind the watermark), so a hot session reaches its state as a few rows per window. The
facts of closed windows go to ``transformWithStateInPandas``, which holds each live
session's merged document (user, first and last seen, last event, event counts, newest window
and its intent, searches) and emits it for every session that closed a window.

A call to the state store costs more than the merge of a session. So sessions are dealt by a
hash of their id into ``groups``, and a micro-batch reads and writes the state of a
group, one list element per session, in a few calls; it rewrites the groups of its sessions only.
Facts and documents cross between Spark and Python as one text each, times as microseconds.

State leaves ``expiry`` after a session's newest window, by an event-time timer of its group,
set to the first of the group's sessions that is due. Should the session come back later, it
begins a new part: documents are keyed by (session, start of the part's first window), and
``read_live_state`` merges the few parts of a session, so an expired state loses nothing.

The documents are stored in a ``KeyedTable``: a micro-batch rewrites the buckets of its
sessions only, reading one session opens one bucket, and a replayed batch is skipped.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.events import validate_event
from ..operators.windows import DIMENSIONS, session_facts
from ..schemas import SESSION_EVENTS
from ..session import DEFAULT_CONF
from ..sources.keyed import KeyedTable, stream_name
from .drivers import _start

# the processor is also read by a worker beside the driver, which may not find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: What the query's state store is set to: RocksDB, which looks up each key before a write only to count the rows.
_STORE = {_PROVIDER: DEFAULT_CONF[_PROVIDER], "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}
_INTENT = "array<struct<key:string,searchCount:int,viewCount:int,addToCartCount:int,weight:int,focus:double>>"
_INTENT_NAMES = ("key", "searchCount", "viewCount", "addToCartCount", "weight", "focus")
_COUNT_OF = {"search": "searchCount", "view-product": "viewCount", "add-to-cart": "addToCartCount"}
#: The merged document of one part of a session.
DOCUMENT = ("partId string, sessionId string, part timestamp, userId string, firstSeen timestamp, lastSeen timestamp, "
            "lastEvent struct<event:string,ts:timestamp>, lastWindow struct<start:timestamp,end:timestamp>, "
            f"eventCounts struct<{', '.join(f'`{e}`:bigint' for e in SESSION_EVENTS)}>, windowCount int, "
            + ", ".join(f"{name} {_INTENT}" for name in DIMENSIONS) + ", searchHistory array<string>")
#: The document as the processor writes it: times are microseconds.
_WRITTEN = DOCUMENT.replace("timestamp", "bigint")
#: Groups of sessions; sessions whose group changes begin a new part.
GROUPS = 4096
#: A session's state: when it is due (milliseconds), and its document.
_STATE = "sessionId string, due long, document string"


def window_intent(rows, column: str) -> list[tuple]:
    """The intent array of one dimension from the columns of one window's facts, by key."""
    own: dict[str, dict] = {}
    total = 0
    for event, key, n, weight in zip(rows["event"], rows[column], rows["n"], rows["weight"]):
        if key is not None and weight > 0:
            row = own.setdefault(key, {"searchCount": 0, "viewCount": 0, "addToCartCount": 0, "weight": 0})
            row[_COUNT_OF[event]] += int(n)
            row["weight"] += int(weight)
            total += int(weight)
    return [(key, r["searchCount"], r["viewCount"], r["addToCartCount"], r["weight"], r["weight"] / total)
            for key, r in sorted(own.items(), key=lambda x: x[0].encode())]


def _first(fact: dict) -> tuple:
    x = fact["first"]                                        # a null id comes first, as in Spark
    return x["ts"], "eid" in x, x.get("eid", 0), x["uid"]


def _last(fact: dict) -> tuple:
    x = fact["last"]
    return x["p"], x["ts"], "eid" in x, x.get("eid", 0), x["event"]


def merged(session: str, before: dict | None, facts: list[dict]) -> dict:
    """A session's document (as in ``_WRITTEN``) with the facts of newly closed windows."""
    starts = {f["start"] for f in facts}
    newest = max(starts)
    own = [f for f in facts if f["start"] == newest]
    last = max(map(_last, own))
    old = before or {"part": min(starts), "firstSeen": facts[0]["firstSeen"], "lastSeen": facts[0]["lastSeen"],
                     "eventCounts": dict.fromkeys(SESSION_EVENTS, 0), "windowCount": 0, "searchHistory": []}
    counts = dict(old["eventCounts"])
    for f in facts:
        counts[f["event"]] += f["n"]
    columns = {c: [f.get(c) for f in own] for c in ("event", "n", "weight", *DIMENSIONS.values())}
    found = sorted((*_first(f)[:3], f["query"], f["n"]) for f in facts if f["event"] == "search" and f.get("query"))
    return {
        "partId": f"{session}|{old['part'] // 1000}", "sessionId": session, "part": old["part"],
        "userId": min(map(_first, own))[-1],
        "firstSeen": min(old["firstSeen"], min(f["firstSeen"] for f in facts)),
        "lastSeen": max(old["lastSeen"], max(f["lastSeen"] for f in facts)),
        "lastEvent": {"event": last[-1], "ts": last[1]}, "lastWindow": {"start": newest, "end": own[0]["end"]},
        "eventCounts": counts, "windowCount": old["windowCount"] + len(starts),
        **{name: [dict(zip(_INTENT_NAMES, x)) for x in window_intent(columns, column)]
           for name, column in DIMENSIONS.items()},
        "searchHistory": old["searchHistory"] + [q for *_, q, n in found for _ in range(n)]}


class SessionStateProcessor(StatefulProcessor):
    """Merges the facts of closed windows into the sessions of a group (see the module)."""

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms
        # texts of types are only understood on the driver, where this runs
        self.state = StructType.fromDDL(_STATE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.summary = handle.getListState("summary", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        facts: dict[str, list[dict]] = {}                   # of the group's windows that closed in this batch
        for part in rows:
            for session, fact in zip(part["sessionId"], json.loads(f"[{','.join(part['fact'])}]")):
                facts.setdefault(session, []).append(fact)
        states = self._states()
        timer = self._first_due(states)
        for session, own in facts.items():
            before = states.get(session)
            document = merged(session, before and json.loads(before[1]), own)
            states[session] = document["lastWindow"]["end"] // 1000 + self.expiry_ms, json.dumps(document)
        self._put(states)
        if timer != self._first_due(states):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self._first_due(states))
        yield pd.DataFrame({"document": [states[session][1] for session in facts]})

    def _states(self) -> dict[str, tuple[int, str]]:
        return {session: (due, document) for session, due, document in self.summary.get()}

    def _put(self, states: dict[str, tuple[int, str]]) -> None:
        self.summary.put([(session, *state) for session, state in states.items()])

    @staticmethod
    def _first_due(states: dict[str, tuple[int, str]]) -> int | None:
        return min((due for due, _ in states.values()), default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The documents of the sessions that are due are stored already; their state goes."""
        now = timerValues.getCurrentWatermarkInMs()
        states = {session: state for session, state in self._states().items() if state[0] >= now}
        if states:
            self._put(states)
            self.handle.registerTimer(self._first_due(states))
        else:
            self.summary.clear()
        yield from ()


def _with_micros(c: Column, kind) -> Column:
    """A column of type ``kind`` with microseconds in place of its times."""
    if isinstance(kind, StructType):
        return F.struct(*[_with_micros(c[f.name], f.dataType).alias(f.name) for f in kind])
    return F.unix_micros(c) if kind.typeName() == "timestamp" else c


def _with_times(c: Column, kind) -> Column:
    """A column of type ``kind``, where its times are microseconds as yet."""
    if isinstance(kind, StructType):
        return F.struct(*[_with_times(c[f.name], f.dataType).alias(f.name) for f in kind])
    return F.timestamp_micros(c) if kind.typeName() == "timestamp" else c


def live_documents(events: DataFrame, window: str = "10 seconds", expiry_ms: int = 30 * 60 * 1000,
                   groups: int = GROUPS) -> DataFrame:
    """Stream of merged documents (``DOCUMENT``) from an event stream with a watermark. ``groups``:
    some hundred live sessions in each are few enough."""
    valid = events.withColumn("_valid", validate_event()).filter("_valid").drop("_valid")
    facts = session_facts(valid, window)
    fact = F.struct(F.unix_micros("window.start").alias("start"), F.unix_micros("window.end").alias("end"),
                    *[_with_micros(F.col(c), facts.schema[c].dataType).alias(c)
                      for c in facts.columns if c not in ("window", "sessionId", "search_id")])
    group = F.pmod(F.xxhash64("sessionId"), F.lit(groups)).cast("int").alias("group")
    written = facts.select(group, "sessionId", F.to_json(fact).alias("fact")).groupBy("group").transformWithStateInPandas(
        SessionStateProcessor(expiry_ms), outputStructType="document string", outputMode="Append", timeMode="EventTime")
    read = F.from_json("document", _WRITTEN, {"mode": "FAILFAST"})
    kinds = StructType.fromDDL(DOCUMENT)
    return written.select(read.alias("d")).select(
        *[_with_times(F.col("d")[f.name], f.dataType).alias(f.name) for f in kinds])


@contextmanager
def _state_store(spark: SparkSession):
    """The state store that the processor needs (several kinds of state for a key), for the query
    that starts here: it takes the settings over, and the session gets its own ones back."""
    before = {name: spark.conf.get(name, None) for name in _STORE}
    for name, value in _STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def live_session_state(events: DataFrame, path: str, checkpoint: str, window: str = "10 seconds",
                       expiry_ms: int = 30 * 60 * 1000, trigger: dict | None = None,
                       buckets: int = 64, groups: int = GROUPS) -> StreamingQuery:
    """Keep the documents of all sessions in the keyed table at ``path``. The query runs on the
    RocksDB state store, whichever one the session names."""
    spark = events.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        KeyedTable(spark, path, "partId", buckets).merge(
            batch, "latest", "windowCount", stream=stream_name(spark, checkpoint), batch_id=batch_id)

    with _state_store(spark):
        return _start(live_documents(events, window, expiry_ms, groups), sink, checkpoint, trigger)


def read_live_state(spark: SparkSession, path: str) -> DataFrame | None:
    """One row per session: the parts of each merged, in the columns of ``windows.session_state_flat``
    with the newest window's intent arrays, searchCount and searchHistory."""
    parts = KeyedTable(spark, path, "partId").read()
    if parts is None:
        return None
    newest = F.col("part")
    return parts.groupBy("sessionId").agg(
        *[F.max_by(c, newest).alias(c) for c in ("userId", "lastEvent", "lastWindow", *DIMENSIONS)],
        F.min("firstSeen").alias("firstSeen"), F.max("lastSeen").alias("lastSeen"),
        F.struct(*[F.sum(F.col(f"eventCounts.`{e}`")).cast("int").alias(e) for e in SESSION_EVENTS]).alias("eventCounts"),
        F.sum("windowCount").cast("int").alias("windowCount"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "searchHistory"))),
                              lambda x: x["searchHistory"])).alias("searchHistory")) \
        .withColumn("searchCount", F.size("searchHistory"))
