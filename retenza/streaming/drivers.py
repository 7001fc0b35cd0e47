"""Structured Streaming drivers: events -> signals, session state, DLQ, feed.

Design: the streaming query holds only **algebraic** state. Events are
aggregated at the finest grain the rules need (window, session, event,
product, articleType[, subCategory]) with counts / min / max, in append
mode behind an event-time watermark. A window's rows are emitted
together in the micro-batch in which the watermark passes its end, so the
per-window rules (distinct products, dominant articleType, intent focus)
are finished inside ``foreachBatch`` on complete windows with the same
batch functions the library uses elsewhere.

Sinks are idempotent: signals are inserted only when their ``_id`` is
absent, session windows only when their (session, window) key is absent,
so a micro-batch replayed after a failure writes nothing twice. The
checkpoint folder is required and must be on shared storage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.events import validate_event
from ..operators import signals as S
from ..operators.windows import history_from_facts, intent_from_facts, session_facts, window_rows_from_facts
from ..sources import sinks as SK
from ..sources.keyed import KeyedTable, stream_name


def plain_window(batch: DataFrame) -> DataFrame:
    """Rebuild the ``window`` struct without its event-time metadata, so the
    micro-batch can be persisted and reused like any batch DataFrame."""
    return batch.withColumn("window", F.struct(F.col("window.start").alias("start"),
                                               F.col("window.end").alias("end")))


def materialize_batch(batch: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Write a micro-batch once and read it back.

    Every action on the ``foreachBatch`` DataFrame re-runs the stateful
    aggregate (``persist`` on it is not picked up by later jobs; measured:
    about 10 state updates per input row). Writing the batch to a folder
    keyed by the batch id (overwritten on a replay) runs it exactly once,
    and the rules then read the written rows.
    """
    spark = batch.sparkSession
    plain_window(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    SK.remove(spark, f"{path}/batch={batch_id - 1}")       # committed, as this batch has begun
    return spark.read.parquet(f"{path}/batch={batch_id}")


def work_folder(checkpoint: str) -> str:
    """Where a stream keeps its current micro-batch, beside its checkpoint."""
    return checkpoint.rstrip("/") + "-work"


def _start(df: DataFrame, fn, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    w = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.foreachBatch(fn).start()


# ------------------------------------------------------------------ signals
def signal_facts_stream(events: DataFrame, window: str) -> DataFrame:
    """Streaming form of ``signals.window_facts`` (same columns)."""
    return S.window_facts(events, window)


def finish_signals(facts: DataFrame, window: str) -> DataFrame:
    """All four signal kinds from the facts of closed windows."""
    return S.signals_from_facts(facts, window)


def signal_stream(events: DataFrame, signals_path: str, checkpoint: str,
                  window: str = S.DEFAULT_WINDOW, trigger: dict | None = None) -> StreamingQuery:
    """Events stream (with watermark) -> session_signals table (insert if
    ``_id`` absent)."""
    facts = signal_facts_stream(events, window)
    spark = events.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        # the closed windows' facts feed four rules: computed once per batch
        facts = materialize_batch(batch, work_folder(checkpoint), batch_id)
        lowest = facts.agg(F.min("window.end").alias("lo")).first()["lo"]    # a signal's ts
        if lowest is not None:
            SK.insert_if_absent_to(spark, finish_signals(facts, window), signals_path, "_id", since="ts",
                                   batch_id=SK.batch_name(checkpoint, batch_id), lowest=lowest)

    return _start(facts, sink, checkpoint, trigger)


# ------------------------------------------------------------------ session state
def session_state_stream(events: DataFrame, rows_path: str, history_path: str,
                         dlq_path: str, checkpoint: str, window: str = "10 seconds",
                         trigger: dict | None = None,
                         intent_path: str | None = None) -> list[StreamingQuery]:
    """Events -> (1) DLQ rows, (2) per-window session rows + search history
    (+ intent rows when ``intent_path`` is given), all keyed and inserted
    only when absent. Session state is the aggregate of the window rows on
    read (``windows.session_state_flat``)."""
    spark = events.sparkSession
    flagged = events.withColumn("_valid", validate_event())
    dlq = flagged.filter(~F.col("_valid")).drop("_valid")
    dlq_q = (dlq.writeStream.format("parquet").option("path", dlq_path)
             .option("checkpointLocation", checkpoint + "/dlq")
             .trigger(**(trigger or {"availableNow": True})).start())
    facts = session_facts(flagged.filter("_valid").drop("_valid"), window)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = materialize_batch(batch, work_folder(checkpoint), batch_id)
        lo = batch.agg(F.min("window.start").alias("lo")).first()["lo"]
        if lo is None:
            return
        own = {"batch_id": SK.batch_name(checkpoint, batch_id), "lowest": lo}
        rows = SK.merge_session_state(None, window_rows_from_facts(batch).withColumn(
            "_wstart", F.col("window.start")), unique=True)
        # a replayed window can only match its own start
        SK.insert_if_absent_to(spark, rows, rows_path, "_wkey", since="_wstart", **own)
        hist = history_from_facts(batch).withColumn(
            "_hkey", F.concat_ws("|", "sessionId", F.col("event_id").cast("string")))
        SK.insert_if_absent_to(spark, hist, history_path, "_hkey", since="ts", **own)
        if intent_path is not None:
            intent = intent_from_facts(batch).withColumn("_ikey", F.concat_ws(
                "|", "sessionId", F.col("window.start").cast("string"), "dimension", "key"))
            intent = intent.withColumn("_wstart", F.col("window.start"))
            SK.insert_if_absent_to(spark, intent, intent_path, "_ikey", since="_wstart", **own)

    return [dlq_q, _start(facts, sink, checkpoint + "/state", trigger)]


# ------------------------------------------------------------------ feed
def signal_feed(spark: SparkSession, path: str, handler: Callable[[DataFrame, int], None],
                checkpoint: str, schema=None, trigger: dict | None = None,
                uid: str | None = None, sid: str | None = None) -> StreamingQuery:
    """Inserted signals handed on per micro-batch, of one user or session if
    ``uid`` or ``sid`` is given; the checkpoint gives the resume the
    reference's change stream lacks. A failing batch is retried by Spark;
    ``handler`` must be idempotent (as the sinks here are)."""
    schema = schema or spark.read.parquet(path).schema
    src = spark.readStream.schema(schema).parquet(path)
    for column, value in (("uid", uid), ("sid", sid)):
        if value is not None:
            src = src.filter(F.col(column) == F.lit(value))
    return _start(src, handler, checkpoint, trigger)


def latest_feed(feed: DataFrame, path: str, checkpoint: str, key: str, version: str,
                trigger: dict | None = None, buckets: int = 64) -> StreamingQuery:
    """Keyed upsert of a feed: the keyed table at ``path`` (``keyed.read_scores``) holds
    the newest row of each key seen so far, as ``commerce.latest_by_key`` does
    for a whole feed. A micro-batch rewrites the buckets of its keys only; a replayed
    one is skipped."""
    spark = feed.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        KeyedTable(spark, path, key, buckets).merge(batch, "latest", version, stream=stream_name(spark, checkpoint),
                                                    batch_id=batch_id)

    return _start(feed, sink, checkpoint, trigger)


def nba_stream(spark: SparkSession, signals_path: str, nbas_path: str, checkpoint: str,
               scores: DataFrame | None = None, products: DataFrame | None = None,
               trigger: dict | None = None, skip: tuple[str, ...] = ()) -> StreamingQuery:
    """Signal feed -> one next best action per new signal, but for the kinds in ``skip``
    (``friction.nba_enriched_stream`` answers these itself), inserted only when
    its ``signal_id`` is absent (a replayed batch adds nothing). ``scores``
    enables the churn-enriched offers. A product's buyers are counted over
    the whole signal table as it is when the batch runs."""
    from ..operators.actions import nba_from_signals, product_buyers

    def handler(batch: DataFrame, batch_id: int) -> None:
        if skip:
            batch = batch.filter(~F.col("signal").isin(*skip))
        lowest = batch.agg(F.min("ts").alias("lo")).first()["lo"]
        if lowest is None:
            return
        buyers = None
        if products is not None:
            mine = batch.filter(F.col("signal") == "high-intent").select("productId").distinct()
            buyers = product_buyers(spark.read.parquet(signals_path).join(mine, "productId", "left_semi"))
        nbas = nba_from_signals(batch, scores=scores, products=products,
                                enriched=scores is not None, buyers=buyers)
        SK.insert_if_absent_to(spark, nbas, nbas_path, "signal_id", since="ts", lowest=lowest,
                               batch_id=SK.batch_name(checkpoint, batch_id))

    return signal_feed(spark, signals_path, handler, checkpoint, trigger=trigger)


def run_to_completion(queries: list[StreamingQuery] | StreamingQuery,
                      timeout_s: float | None = None) -> None:
    """Wait until the queries end, as ``availableNow`` ones do by themselves.

    There is no time limit unless ``timeout_s`` is given; a query that still
    runs then is stopped and ``TimeoutError`` raised, so a caller never goes
    on with a half-written table. A failed query raises its error.
    """
    queries = queries if isinstance(queries, list) else [queries]
    try:
        for q in queries:
            if timeout_s is None:
                q.awaitTermination()
            elif not q.awaitTermination(timeout_s):
                raise TimeoutError(f"query {q.id} still runs after {timeout_s} s")
            if q.exception() is not None:
                raise RuntimeError(str(q.exception()))
    finally:
        for q in queries:
            if q.isActive:
                q.stop()
