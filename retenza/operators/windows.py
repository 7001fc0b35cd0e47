"""Session state: validated events -> per-window rows -> per-session state.

Tabular ("long") forms are the primary outputs: they are algebraic
aggregates that partially combine before each shuffle. The nested
document shape of the reference (arrays inside one session row) is built
from them by ``session_window_agg(nested=True)``; its arrays hold one
element per distinct key or search of a window, so they stay small for
the short windows the stream uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.events import (EV, SID, TS, UID, blank_to_null, event_priority,
                                event_weight, md, present, validate_event)
from ..schemas import SESSION_EVENTS
from ..session import cut_lineage

DEFAULT_WINDOW = "10 seconds"
DIMENSIONS = {"products": "productId", "articleTypes": "articleType",
              "subCategories": "subCategory"}
TOTAL_NAMES = {"productId": "productWeightTotal", "articleType": "articleTypeWeightTotal",
               "subCategory": "subCategoryWeightTotal"}


def dead_letter_split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, dlq) by the session-state validator; null tests count as false."""
    flagged = events.withColumn("_valid", validate_event())
    return (flagged.filter("_valid").drop("_valid"),
            flagged.filter(~F.col("_valid")).drop("_valid"))


def tumbling_window(events: DataFrame, window: str = DEFAULT_WINDOW,
                    watermark: str | None = None) -> DataFrame:
    """Add the event-time window column; with a watermark for streams."""
    if watermark is not None:
        events = events.withWatermark("timestamp", watermark)
    return events.withColumn("window", F.window(TS(), window))


def late_data_drop(events: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """Lateness 0: Spark drops rows whose window is already closed."""
    return events.withWatermark("timestamp", watermark)


def event_counts_expr():
    return F.struct(*[F.count_if(EV() == e).alias(e) for e in SESSION_EVENTS])


def session_window_rows(valid: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    """Per (window, sessionId): ids, first/last seen, last event, five counts
    and the three intent weight totals (all algebraic)."""
    w = event_weight()
    last_rank = F.struct(event_priority().alias("p"), TS().alias("ts"),
                         F.col("event_id").alias("eid"))

    def total(dim: str):
        return F.sum(F.when(present(md(dim)) & (w > 0), w).otherwise(F.lit(0))).cast("int")

    return valid.groupBy(F.window(TS(), window).alias("window"), SID().alias("sessionId")).agg(
        F.min_by(UID(), F.struct(TS(), F.col("event_id"))).alias("userId"),
        F.min(TS()).alias("firstSeen"),
        F.max(TS()).alias("lastSeen"),
        F.max_by(F.struct(EV().alias("event"), TS().alias("ts")), last_rank).alias("lastEvent"),
        event_counts_expr().alias("eventCounts"),
        F.struct(*[total(d).alias(n) for d, n in TOTAL_NAMES.items()]).alias("dimensionTotals"),
    )


def event_counts(valid: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    """Five zero-filled counters per (window, sessionId)."""
    return valid.groupBy(F.window(TS(), window).alias("window"), SID().alias("sessionId")) \
        .agg(event_counts_expr().alias("eventCounts"))


def intent_dimension_totals(valid: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    return session_window_rows(valid, window).select("window", "sessionId", "dimensionTotals")


def intent_long(valid: DataFrame, key: str, window: str = DEFAULT_WINDOW) -> DataFrame:
    """Per (window, sessionId, key value): search/view/cart counts, weight, focus.

    Keys null or '' and weight <= 0 are skipped. ``focus`` is weight over
    the dimension's total in that window; the total comes from a separate
    aggregate joined back (no window function over a possibly hot session).
    """
    w = event_weight()
    ev = valid.filter(present(md(key)) & (w > 0))
    keyed = ev.groupBy(F.window(TS(), window).alias("window"), SID().alias("sessionId"),
                       md(key).alias(key)).agg(
        F.count_if(EV() == "search").cast("int").alias("searchCount"),
        F.count_if(EV() == "view-product").cast("int").alias("viewCount"),
        F.count_if(EV() == "add-to-cart").cast("int").alias("addToCartCount"),
        F.sum(w).cast("int").alias("weight"))
    totals = keyed.groupBy("window", "sessionId").agg(F.sum("weight").alias("_total"))
    return (keyed.join(totals, ["window", "sessionId"])
            .withColumn("focus", F.when(F.col("_total") > 0, F.col("weight") / F.col("_total"))
                        .otherwise(F.lit(0.0)))
            .drop("_total"))


def intent_products(valid: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    return intent_long(valid, "productId", window)


def intent_article_types(valid: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    return intent_long(valid, "articleType", window)


def intent_sub_categories(valid: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    return intent_long(valid, "subCategory", window)


def search_history_long(valid: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    """One row per non-empty search query: (window, sessionId, userId, ts, event_id, query)."""
    return valid.filter((EV() == "search") & present(md("query"))).select(
        F.window(TS(), window).alias("window"), SID().alias("sessionId"), UID().alias("userId"),
        TS().alias("ts"), "event_id", md("query").alias("query"))


def session_facts(valid: DataFrame, window: str) -> DataFrame:
    """Per (window, session, event, product, articleType, subCategory, search
    event id): counts and extremes. Search events keep their own row (their
    id is part of the key) so the search history keeps every query in order;
    all other events are combined."""
    w = event_weight()
    search_id = F.when(EV() == "search", F.col("event_id"))
    return valid.groupBy(
        F.window(TS(), window).alias("window"), SID().alias("sessionId"), EV().alias("event"),
        blank_to_null(md("productId")).alias("productId"),
        blank_to_null(md("articleType")).alias("articleType"),
        blank_to_null(md("subCategory")).alias("subCategory"),
        search_id.alias("search_id"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(w).alias("weight"),
        F.min(F.struct(TS().alias("ts"), F.col("event_id").alias("eid"),
                       UID().alias("uid"))).alias("first"),
        F.min(TS()).alias("firstSeen"),
        F.max(TS()).alias("lastSeen"),
        F.max(F.struct(event_priority().alias("p"), TS().alias("ts"),
                       F.col("event_id").alias("eid"), EV().alias("event"))).alias("last"),
        F.max(md("query")).alias("query"),
    )


def window_rows_from_facts(facts: DataFrame) -> DataFrame:
    """``windows.session_window_rows`` rebuilt from the streaming facts."""
    def total(key: str):
        return F.sum(F.when(F.col(key).isNotNull() & (F.col("weight") > 0), F.col("weight"))
                     .otherwise(F.lit(0))).cast("int")
    counts = F.struct(*[F.sum(F.when(F.col("event") == e, F.col("n")).otherwise(F.lit(0)))
                        .cast("long").alias(e) for e in SESSION_EVENTS])
    return facts.groupBy("window", "sessionId").agg(
        F.min("first").getField("uid").alias("userId"),
        F.min("firstSeen").alias("firstSeen"),
        F.max("lastSeen").alias("lastSeen"),
        F.max("last").alias("_last"),
        counts.alias("eventCounts"),
        F.struct(total("productId").alias("productWeightTotal"),
                 total("articleType").alias("articleTypeWeightTotal"),
                 total("subCategory").alias("subCategoryWeightTotal")).alias("dimensionTotals"),
    ).withColumn("lastEvent", F.struct(F.col("_last.event").alias("event"),
                                       F.col("_last.ts").alias("ts"))).drop("_last")


def intent_counts(facts: DataFrame) -> DataFrame:
    """(window, sessionId, dimension, key) of all three dimensions with search/view/cart counts
    and weight, in one aggregate; keys null or '' and weights <= 0 are skipped."""
    dims = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("key"))
                               for d in DIMENSIONS.values()]))
    keyed = facts.filter(F.col("weight") > 0).select("window", "sessionId", "event", "n", "weight", dims.alias("d")) \
        .filter(F.col("d.key").isNotNull())
    return keyed.groupBy("window", "sessionId", F.col("d.dimension").alias("dimension"), F.col("d.key").alias("key")).agg(
        *[F.sum(F.when(F.col("event") == e, F.col("n")).otherwise(F.lit(0))).cast("int").alias(a)
          for e, a in (("search", "searchCount"), ("view-product", "viewCount"), ("add-to-cart", "addToCartCount"))],
        F.sum("weight").cast("int").alias("weight"))


def intent_from_facts(facts: DataFrame) -> DataFrame:
    """Long intent rows of all three dimensions from closed windows' facts:
    (window, sessionId, dimension, key, search/view/cart counts, weight,
    focus). Same numbers as ``intent_long`` per dimension."""
    out = intent_counts(facts)
    totals = out.groupBy("window", "sessionId", "dimension").agg(F.sum("weight").alias("_t"))
    return (out.join(totals, ["window", "sessionId", "dimension"])
            .withColumn("focus", F.when(F.col("_t") > 0, F.col("weight") / F.col("_t"))
                        .otherwise(F.lit(0.0))).drop("_t"))


def history_from_facts(facts: DataFrame) -> DataFrame:
    return facts.filter((F.col("event") == "search") & present(F.col("query"))).select(
        "window", "sessionId", F.col("first.uid").alias("userId"), F.col("first.ts").alias("ts"),
        F.col("search_id").alias("event_id"), "query")


def session_window_agg(valid: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    """Nested per-window session documents (the reference's window output):
    sessionId, userId, firstSeen, lastSeen, lastEvent,
    last10s{intent{products, articleTypes, subCategories, dimensionTotals},
    lastEvent, window}, searchHistory, sessionTotals{eventCounts, windowCount=1}.

    One pass over the events makes the facts, which are written once
    (reliable checkpoint); all parts of a document are aggregates of them."""
    return session_docs(cut_lineage(session_facts(valid, window)))


def session_docs(facts: DataFrame) -> DataFrame:
    """The documents of ``session_window_agg`` from the facts of their windows."""
    keys = ["window", "sessionId"]
    found = (F.col("event") == "search") & present(F.col("query"))
    searches = facts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(found, F.struct(
        F.col("first.ts").alias("ts"), F.col("search_id").alias("eid"), F.col("query").alias("query"),
        F.col("n").cast("int").alias("n"))))).alias("_h"))
    intent = intent_counts(facts).groupBy(*keys).agg(F.collect_list(F.struct(
        "dimension", "key", "searchCount", "viewCount", "addToCartCount", "weight")).alias("_i"))
    docs = window_rows_from_facts(facts).join(searches, keys).join(intent, keys, "left")

    def array_of(dimension: str):
        total = F.col(f"dimensionTotals.{TOTAL_NAMES[dimension]}")
        own = F.filter(F.col("_i"), lambda x: x["dimension"] == dimension)
        return F.coalesce(F.array_sort(F.transform(own, lambda x: F.struct(
            x["key"].alias(dimension), x["searchCount"].alias("searchCount"), x["viewCount"].alias("viewCount"),
            x["addToCartCount"].alias("addToCartCount"), x["weight"].alias("weight"),
            (x["weight"] / total).alias("focus")))), F.array())

    return docs.select(
        "sessionId", "userId", "firstSeen", "lastSeen", "lastEvent",
        F.struct(
            F.struct(*[array_of(d).alias(name) for name, d in DIMENSIONS.items()], F.col("dimensionTotals")).alias("intent"),
            F.col("lastEvent"),
            F.col("window")).alias("last10s"),
        F.flatten(F.transform("_h", lambda x: F.array_repeat(x["query"], x["n"]))).alias("searchHistory"),
        F.struct(F.col("eventCounts"), F.lit(1).alias("windowCount")).alias("sessionTotals"),
    )


def _sum_counts(col: str):
    return F.struct(*[F.sum(F.col(f"{col}.`{e}`")).cast("int").alias(e) for e in SESSION_EVENTS])


def session_state_flat(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Per-session merge of window rows (batch form of the $merge):
    min firstSeen, max lastSeen, lastEvent/userId/window from the newest
    window, counts added, windowCount = number of windows, number of
    searches (the length of searchHistory)."""
    newest = F.col("window.start")
    out = rows.groupBy("sessionId").agg(
        F.max_by("userId", newest).alias("userId"),
        F.min("firstSeen").alias("firstSeen"),
        F.max("lastSeen").alias("lastSeen"),
        F.max_by("lastEvent", newest).alias("lastEvent"),
        F.max_by("window", newest).alias("lastWindow"),
        F.max_by("dimensionTotals", newest).alias("dimensionTotals"),
        _sum_counts("eventCounts").alias("eventCounts"),
        F.count(F.lit(1)).cast("int").alias("windowCount"),
    )
    if history is not None:
        n = history.groupBy("sessionId").agg(F.count(F.lit(1)).cast("int").alias("searchCount"))
        out = out.join(n, "sessionId", "left").fillna(0, ["searchCount"])
    return out


def session_state(window_docs: DataFrame) -> DataFrame:
    """Nested session state from nested window documents
    (``session_window_agg`` output), the reference's document shape."""
    newest = F.col("last10s.window.start")
    return window_docs.groupBy("sessionId").agg(
        F.max_by("userId", newest).alias("userId"),
        F.min("firstSeen").alias("firstSeen"),
        F.max("lastSeen").alias("lastSeen"),
        F.max_by("lastEvent", newest).alias("lastEvent"),
        F.max_by("last10s", newest).alias("last10s"),
        F.flatten(F.transform(
            F.array_sort(F.collect_list(F.struct(newest.alias("s"),
                                                 F.col("searchHistory").alias("h")))),
            lambda x: x.getField("h"))).alias("searchHistory"),
        F.struct(_sum_counts("sessionTotals.eventCounts").alias("eventCounts"),
                 F.sum("sessionTotals.windowCount").cast("int").alias("windowCount"))
        .alias("sessionTotals"),
    )


def flat_session_state(state: DataFrame, *more: str) -> DataFrame:
    """Tabular projection of ``session_state_flat`` for reports, with ``more`` columns."""
    return state.select(
        "sessionId", "userId", "firstSeen", "lastSeen",
        F.col("lastEvent.event").alias("lastEvent_event"),
        F.col("lastEvent.ts").alias("lastEvent_ts"),
        F.col("lastWindow.start").alias("lastWindow_start"),
        *[F.col(f"eventCounts.`{e}`").cast("long").alias(e.replace("-", "_") + "_count")
          for e in SESSION_EVENTS],
        F.col("windowCount").cast("long").alias("windowCount"),
        *([F.col("searchCount").cast("long").alias("searchCount")]
          if "searchCount" in state.columns else []), *more)
