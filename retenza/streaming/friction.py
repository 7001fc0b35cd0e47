"""The friction path as a stream: signals joined with the searches that led to them.

A search-friction signal is answered with a product for what the shopper was looking
for. Signals and search events are two streams; they are joined on (user, session) within a
time bound, each behind its watermark, so Spark holds a search for ``horizon`` and a
signal until no earlier search can come any more. Then the signal is emitted once:
with the last search before it, or, by the outer side of the join, with
its own topic if there was none. A search that comes behind the watermark is late and
doesn't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.events import EV, SID, UID, md, present, validate_event
from ..operators.actions import nba_from_signals
from ..operators.search import product_recommendation
from ..sources import sinks as SK
from .drivers import _start, work_folder

HORIZON = "30 minutes"


def _timed(ts: str, cond: Column) -> Column:
    """``cond``, but in need of the event time, so that Spark leaves the filter above the
    watermark: all rows of a stream move it on, not only those that pass."""
    return F.when(F.col(ts).isNotNull(), cond).otherwise(F.lit(False))


def searches_of(events: DataFrame) -> DataFrame:
    """Search events with a query from an event stream with a watermark:
    (userId, sessionId, searchTs, searchId, query)."""
    return events.filter(_timed("timestamp", validate_event() & (EV() == "search") & present(md("query")))).select(
        UID().alias("userId"), SID().alias("sessionId"), F.col("timestamp").alias("searchTs"),
        F.col("event_id").alias("searchId"), md("query").alias("query"))


def signal_source(spark: SparkSession, path: str, schema=None, delay: str = "0 seconds") -> DataFrame:
    """The signal table as a stream with ``ts`` as event time."""
    schema = schema or spark.read.parquet(path).drop(SK.BATCH).schema
    return spark.readStream.schema(schema).parquet(path).withWatermark("ts", delay)


def friction_intents(signals: DataFrame, searches: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """Stream of search-friction signals, each once, with ``historyLength`` (its session's
    searches in the ``horizon`` before it), ``lastQuery`` (the last of them) and
    ``intentSummary`` (that query, else the signal's topic)."""
    friction = signals.filter(_timed("ts", F.col("signal") == "search-friction"))
    near = F.expr(f"uid = userId AND sid = sessionId AND searchTs < ts AND searchTs >= ts - INTERVAL {horizon}")
    pairs = friction.withColumn("_row", F.struct(*[F.col(c) for c in signals.columns if c not in ("_id", "ts")])) \
        .join(searches, near, "left_outer")
    one = pairs.groupBy("ts", "_id").agg(
        F.first("_row").alias("_row"), F.max_by("query", F.struct("searchTs", "searchId")).alias("lastQuery"),
        F.count("searchId").alias("historyLength"))
    return one.select("_id", "ts", "_row.*", "lastQuery", "historyLength",
                      F.when(F.col("historyLength") > 0, F.col("lastQuery")).otherwise(F.col("_row.topic.value"))
                      .alias("intentSummary"))


def friction_stream(spark: SparkSession, signals: DataFrame, searches: DataFrame, products: DataFrame, nbas_path: str,
                    checkpoint: str, horizon: str = HORIZON, index=None, trigger: dict | None = None) -> StreamingQuery:
    """Friction signals -> next best actions with intent and recommended product, inserted
    when their ``signal_id`` is absent. ``index``: a stored ``text_index`` of the products,
    else each batch searches the products themselves."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        path = f"{work_folder(checkpoint)}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(path)          # the stateful plan runs once
        SK.remove(spark, f"{work_folder(checkpoint)}/batch={batch_id - 1}")
        rows = spark.read.parquet(path)
        lowest = rows.agg(F.min("ts").alias("lo")).first()["lo"]
        if lowest is None:
            return
        intents = rows.select(F.col("_id").alias("signal_id"), "sid", "intentSummary")
        top = product_recommendation(intents, products, 1, index=index)
        nbas = nba_from_signals(rows.drop("lastQuery", "historyLength", "intentSummary"), recommendations=top)
        SK.insert_if_absent_to(spark, nbas, nbas_path, "signal_id", since="ts", lowest=lowest,
                               batch_id=SK.batch_name(checkpoint, batch_id))

    return _start(friction_intents(signals, searches, horizon), sink, checkpoint, trigger)


def nba_enriched_stream(spark: SparkSession, signals_path: str, events: DataFrame, nbas_path: str, checkpoint: str,
                        products: DataFrame, scores: DataFrame | None = None, horizon: str = HORIZON, index=None,
                        delay: str = "0 seconds", schema=None, trigger: dict | None = None) -> list[StreamingQuery]:
    """The whole action path: friction signals through ``friction_stream``, the others through
    ``drivers.nba_stream``, into one table."""
    from .drivers import nba_stream
    return [nba_stream(spark, signals_path, nbas_path, f"{checkpoint}/plain", scores=scores, products=products,
                       trigger=trigger, skip=("search-friction",)),
            friction_stream(spark, signal_source(spark, signals_path, schema, delay), searches_of(events), products,
                            nbas_path, f"{checkpoint}/friction", horizon, index, trigger)]
