"""Behavioural signals over event-time tumbling windows.

One shared, map-side-combined aggregate (``window_facts``) is computed at
(window, session, event, product, articleType) grain; the four rules are
then derived from it. Every step is an algebraic aggregate (count, sum,
min, max, max_by), so a hot session is pre-aggregated before its shuffle
and no group is ever gathered into one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.events import (EV, SID, TS, UID, blank_to_null, match_identified_events,
                                md, severity_by_count, signal_id)
from ..schemas import EVIDENCE, TOPIC

DEFAULT_WINDOW = "30 seconds"


def window_facts(events: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    """Per (window, sid, uid, event, productId, articleType): counts and extremes.

    ``first_pos`` and ``last_pos`` are the key's first and last place in
    arrival order (``arrival``). All aggregates are of fixed width, so the
    events are hashed, not sorted, before the shuffle.
    """
    ev = events.filter(match_identified_events())
    return (ev.groupBy(
                F.window(TS(), window).alias("window"),
                SID().alias("sid"),
                UID().alias("uid"),
                EV().alias("event"),
                blank_to_null(md("productId")).alias("productId"),
                blank_to_null(md("articleType")).alias("articleType"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.min(arrival()).alias("first_pos"),
                 F.max(arrival()).alias("last_pos"),
                 F.max(TS()).alias("lastTs"),
                 F.max(md("itemCount")).alias("maxItem")))


def arrival() -> Column:
    """(timestamp, event_id) as one number in the same order."""
    whole = F.unix_micros(TS()).cast("decimal(18,0)") * F.lit("10000000000000000000").cast("decimal(20,0)")
    return (whole + F.coalesce(F.col("event_id"), F.lit(0)).cast("decimal(20,0)")).cast("decimal(38,0)")


def _count_of(event: str) -> Column:
    return F.sum(F.when(F.col("event") == event, F.col("n")).otherwise(F.lit(0)))


def window_stats(facts: DataFrame) -> DataFrame:
    """Per (window, sid): uid, lastTs and the counters all four rules use."""
    viewed = F.when(F.col("event").isin("view-product", "search"), F.col("productId"))
    return facts.groupBy("window", "sid").agg(
        F.min_by("uid", "first_pos").alias("uid"),
        F.max("lastTs").alias("lastTs"),
        _count_of("exit-risk").alias("exitCount"),
        _count_of("add-to-cart").alias("cartCount"),
        _count_of("view-cart").alias("viewCartCount"),
        F.max(F.when(F.col("event") == "view-cart", F.col("maxItem"))
              .otherwise(F.lit(0))).alias("maxItemCount"),
        F.count_distinct(viewed).alias("distinctProducts"),
    )


def dominant_article_type(facts: DataFrame) -> DataFrame:
    """Per (window, sid): articleType with the highest count among viewed and
    searched events; ties go to the value whose last occurrence is earliest
    (the first to reach the top count when scanning in arrival order)."""
    per_key = (facts.filter(F.col("event").isin("view-product", "search")
                            & F.col("articleType").isNotNull())
               .groupBy("window", "sid", "articleType")
               .agg(F.sum("n").alias("cnt"), F.max("last_pos").alias("last_pos")))
    rank = F.struct(F.col("cnt"), (-F.col("last_pos")).alias("earlier"))
    return per_key.groupBy("window", "sid").agg(
        F.max_by("articleType", rank).alias("topArticleType"))


def _evidence(kind: str, window: str, level: str | None = None) -> str:
    text = EVIDENCE[kind][level] if level else EVIDENCE[kind]
    return text.format(window=f"in the last {window}")


def _finish(df: DataFrame) -> DataFrame:
    """Common signal columns in schema order; ts = window end."""
    cols = ["_id", "sid", "uid", "signal", "severity", "evidence", "ts",
            "productId", "distinctProducts", "topic"]
    out = df.withColumn("ts", F.coalesce(F.col("window.end"), F.col("lastTs")))
    for c, t in (("productId", "string"), ("distinctProducts", "int")):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    if "topic" not in out.columns:
        out = out.withColumn("topic", F.lit(None).cast(TOPIC))
    return out.select(*cols)


def exit_risk_from_stats(stats: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    n = F.col("exitCount")
    said = {x: F.lit(_evidence("exit-risk", window, x)) for x in ("high", "medium", "low")}
    evidence = F.when(n >= 3, said["high"]).when(n == 2, said["medium"]).otherwise(said["low"])
    return _finish(stats.filter(n > 0).select(
        signal_id(F.col("sid"), "exitrisk", F.col("lastTs"), window).alias("_id"),
        "sid", "uid", F.lit("exit-risk").alias("signal"),
        severity_by_count(n).alias("severity"), evidence.alias("evidence"),
        "window", "lastTs"))


def cart_abandonment_from_stats(stats: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    items = F.when(F.col("maxItemCount") > 0, F.col("maxItemCount")).otherwise(F.lit(1))
    evidence = F.format_string(_evidence("cart-abandonment", window), items)
    return _finish(stats.filter(F.col("viewCartCount") > 0).select(
        signal_id(F.col("sid"), "cartabandon", F.col("lastTs"), window).alias("_id"),
        "sid", "uid", F.lit("cart-abandonment").alias("signal"),
        severity_by_count(items).alias("severity"), evidence.alias("evidence"),
        "window", "lastTs"))


def search_friction_from_stats(stats: DataFrame, topics: DataFrame,
                               window: str = DEFAULT_WINDOW) -> DataFrame:
    d = F.col("distinctProducts")
    sev = (F.when(d >= 7, F.lit("high")).when(d >= 5, F.lit("medium"))
            .otherwise(F.lit("low")))
    said = {x: F.format_string(_evidence("search-friction", window, x), d) for x in ("high", "medium", "low")}
    evidence = F.when(d >= 7, said["high"]).when(d >= 5, said["medium"]).otherwise(said["low"])
    hit = stats.filter((F.col("cartCount") == 0) & (d >= 3))
    hit = hit.join(topics, ["window", "sid"], "left")
    topic = F.when(F.col("topArticleType").isNotNull(),
                   F.struct(F.lit("articleType").alias("dimension"),
                            F.col("topArticleType").alias("value")))
    return _finish(hit.select(
        signal_id(F.col("sid"), "searchfriction", F.col("lastTs"), window).alias("_id"),
        "sid", "uid", F.lit("search-friction").alias("signal"), sev.alias("severity"),
        evidence.alias("evidence"), d.cast("int").alias("distinctProducts"),
        topic.alias("topic"), "window", "lastTs"))


def high_intent_from_facts(facts: DataFrame, stats: DataFrame,
                           window: str = DEFAULT_WINDOW) -> DataFrame:
    carts = (facts.filter((F.col("event") == "add-to-cart") & F.col("productId").isNotNull())
             .select("window", "sid", "productId").distinct())
    j = carts.join(stats.select("window", "sid", "uid", "lastTs"), ["window", "sid"])
    return _finish(j.select(
        signal_id(F.col("sid"), "highintent", F.col("lastTs"), window,
                  product=F.col("productId")).alias("_id"),
        "sid", "uid", F.lit("high-intent").alias("signal"), F.lit("high").alias("severity"),
        F.lit(_evidence("high-intent", window)).alias("evidence"),
        "productId", "window", "lastTs"))


def exit_risk_signal(events: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    """n exit-risk events in a window: 1 low, 2 medium, >=3 high."""
    return exit_risk_from_stats(window_stats(window_facts(events, window)), window)


def _shared_facts(events: DataFrame, window: str, materialize: bool) -> DataFrame:
    """The window aggregate, checkpointed when more than one branch reads it."""
    from ..session import cut_lineage
    facts = window_facts(events, window)
    return cut_lineage(facts) if materialize and not events.isStreaming else facts


def high_intent_signal(events: DataFrame, window: str = DEFAULT_WINDOW,
                       materialize: bool = True) -> DataFrame:
    """One 'high' signal per distinct non-empty product added to the cart."""
    facts = _shared_facts(events, window, materialize)
    return high_intent_from_facts(facts, window_stats(facts), window)


def search_friction_signal(events: DataFrame, window: str = DEFAULT_WINDOW,
                           materialize: bool = True) -> DataFrame:
    """No add-to-cart and >=3 distinct viewed/searched products."""
    facts = _shared_facts(events, window, materialize)
    return search_friction_from_stats(window_stats(facts), dominant_article_type(facts), window)


def cart_abandonment_signal(events: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    """>=1 view-cart; items = max itemCount (<=0/null -> 1): 2 medium, >=3 high."""
    return cart_abandonment_from_stats(window_stats(window_facts(events, window)), window)


def session_windows(facts: DataFrame) -> DataFrame:
    """Per (window, sid) all that the four rules ask for, in one pass over the facts, which
    are dealt by (window, sid) once: first by articleType, then as a whole. The sets hold the
    distinct products of one session in one window."""
    viewed, carted = F.col("event").isin("view-product", "search"), F.col("event") == "add-to-cart"
    counts = [_count_of(e).alias(c) for e, c in (("exit-risk", "exitCount"), ("add-to-cart", "cartCount"),
                                                 ("view-cart", "viewCartCount"))]
    by_type = facts.repartition("window", "sid").groupBy("window", "sid", "articleType").agg(
        F.min(F.struct("first_pos", "uid")).alias("first"), F.max("lastTs").alias("lastTs"), *counts,
        F.max(F.when(F.col("event") == "view-cart", F.col("maxItem"))).alias("maxItem"),
        F.sum(F.when(viewed, F.col("n"))).alias("cnt"), F.max(F.when(viewed, F.col("last_pos"))).alias("last_pos"),
        F.collect_set(F.when(viewed, F.col("productId"))).alias("seen"),
        F.collect_set(F.when(carted, F.col("productId"))).alias("bought"))
    top = F.max(F.when((F.col("cnt") > 0) & F.col("articleType").isNotNull(), F.struct(
        F.col("cnt"), (-F.col("last_pos")).alias("earlier"), F.col("articleType").alias("value"))))
    return by_type.groupBy("window", "sid").agg(
        F.min("first")["uid"].alias("uid"), F.max("lastTs").alias("lastTs"),
        *[F.sum(c).alias(c) for c in ("exitCount", "cartCount", "viewCartCount")],
        F.greatest(F.max("maxItem"), F.lit(0)).alias("maxItemCount"), top["value"].alias("topArticleType"),
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("distinctProducts"),
        F.array_distinct(F.flatten(F.collect_list("bought"))).alias("bought"))


def signals_from_facts(facts: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    """The signals of all four rules: each row of ``session_windows`` is exploded into its signals."""
    def signal(kind: str, name: str, severity: Column, evidence: Column, product: Column | None = None,
               distinct: Column | None = None, topic: Column | None = None) -> Column:
        return F.struct(
            signal_id(F.col("sid"), kind, F.col("lastTs"), window, product=product).alias("_id"),
            F.lit(name).alias("signal"), severity.alias("severity"), evidence.alias("evidence"),
            (F.lit(None) if product is None else product).cast("string").alias("productId"),
            (F.lit(None) if distinct is None else distinct).cast("int").alias("distinctProducts"),
            (F.lit(None) if topic is None else topic).cast(TOPIC).alias("topic"))

    def one(cond: Column, value: Column) -> Column:
        return F.when(cond, F.array(value))

    n, d = F.col("exitCount"), F.col("distinctProducts")
    items = F.when(F.col("maxItemCount") > 0, F.col("maxItemCount")).otherwise(F.lit(1))

    def level(value: Column, high: int, medium: int, said: dict) -> Column:
        return F.when(value >= high, said["high"]).when(value >= medium, said["medium"]).otherwise(said["low"])
    names = {x: F.lit(x) for x in ("high", "medium", "low")}
    found = {x: F.format_string(_evidence("search-friction", window, x), d) for x in names}
    left = {x: F.lit(_evidence("exit-risk", window, x)) for x in names}
    topic = F.when(F.col("topArticleType").isNotNull(), F.struct(F.lit("articleType").alias("dimension"),
                                                                 F.col("topArticleType").alias("value")))
    rules = [
        one(n > 0, signal("exitrisk", "exit-risk", severity_by_count(n), level(n, 3, 2, left))),
        F.transform("bought", lambda p: signal("highintent", "high-intent", F.lit("high"),
                                               F.lit(_evidence("high-intent", window)), product=p)),
        one((F.col("cartCount") == 0) & (d >= 3), signal(
            "searchfriction", "search-friction", level(d, 7, 5, names), level(d, 7, 5, found), distinct=d, topic=topic)),
        one(F.col("viewCartCount") > 0, signal(
            "cartabandon", "cart-abandonment", severity_by_count(items),
            F.format_string(_evidence("cart-abandonment", window), items)))]
    none = F.filter(rules[1], lambda x: F.lit(False))
    out = session_windows(facts).select("window", "sid", "uid", "lastTs", F.explode(
        F.concat(*[F.coalesce(r, none) for r in rules])).alias("s"))
    return _finish(out.select("window", "sid", "uid", "lastTs", "s.*"))


def all_signals(events: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    """The four signal kinds in one pass: one scan and one aggregate of the events, one
    exchange of their facts by (window, sid), and the rules on rows of ``session_windows``."""
    return signals_from_facts(window_facts(events, window), window)


def flat_signals(signals: DataFrame) -> DataFrame:
    """Topic struct flattened (for tabular outputs and oracle comparison)."""
    return signals.select(
        "_id", "sid", "uid", "signal", "severity", "evidence", "ts", "productId",
        "distinctProducts", F.col("topic.dimension").alias("topic_dimension"),
        F.col("topic.value").alias("topic_value"))


def unwind_signals(df: DataFrame, array_col: str = "signals") -> DataFrame:
    """Array of signal structs -> one row each; an empty array yields none."""
    return df.select(F.explode(array_col).alias("s")).select("s.*")
