"""Reporting aggregates over signals, next best actions and scores.

Mixes are computed for all users in one pass (``uid=None``) or for one
user (a pushed-down filter). Shares use ``bround`` (half-to-even), as the
reference's ``$round`` does. Every total is taken over already aggregated
rows (one per user and category), so no window sees more than a handful
of rows per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _mix(df: DataFrame, key: str, out_key: str, uid: str | None) -> DataFrame:
    if uid is not None:
        df = df.filter(F.col("uid") == F.lit(uid))
    return shares(df.groupBy("uid", F.col(key).alias(out_key)).agg(F.count(F.lit(1)).alias("count")), out_key)


def shares(counts: DataFrame, out_key: str) -> DataFrame:
    """Counts per user and category with the category's whole-percent share of the user's."""
    total = F.sum("count").over(Window.partitionBy("uid"))
    return (counts.withColumn("percentage",
                              F.bround(F.col("count") / total * 100, 0).cast("long"))
            .orderBy("uid", F.desc("percentage"), out_key))


def behavior_mix(signals: DataFrame, uid: str | None = None) -> DataFrame:
    """Per user: count per signal and its whole-percent share, share desc."""
    return _mix(signals, "signal", "signal", uid)


def nba_mix(nbas: DataFrame, uid: str | None = None) -> DataFrame:
    """Per user: count per NBA type and its share."""
    return _mix(nbas, "type", "type", uid)


def engaged_mix(nbas: DataFrame, uid: str | None = None) -> DataFrame:
    """Per user, redeemed NBAs only: count per type (as ``actionType``)."""
    return _mix(nbas.filter(F.col("redeemed") == F.lit(True)), "type", "actionType", uid)


def most_responsive_action(nbas: DataFrame) -> DataFrame:
    """First row of ``engaged_mix`` per user (share desc, then name)."""
    return first_of_mix(engaged_mix(nbas))


def first_of_mix(mix: DataFrame) -> DataFrame:
    # The mix holds at most one row per (user, action type): the window
    # partition per user is bounded by the number of action types.
    w = Window.partitionBy("uid").orderBy(F.desc("percentage"), "actionType")
    return (mix.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn"))


def conversion_rate(events: DataFrame, nbas: DataFrame | None = None) -> DataFrame:
    """Per session: add-to-cart / view-product x 100 (1 decimal, 0 without
    views), the session's event count and its NBA count."""
    ev = events.groupBy(F.col("tags.sessionId").alias("sid")).agg(
        F.count_if(F.col("tags.event") == "add-to-cart").alias("productsAddedToCart"),
        F.count_if(F.col("tags.event") == "view-product").alias("totalProductsViewed"),
        F.count(F.lit(1)).alias("events"))
    out = ev.withColumn(
        "conversionRate",
        F.when(F.col("totalProductsViewed") > 0,
               F.round(F.col("productsAddedToCart") / F.col("totalProductsViewed") * 100, 1))
        .otherwise(F.lit(0.0)))
    if nbas is not None:
        n = nbas.groupBy("sid").agg(F.count(F.lit(1)).alias("nbas"))
        out = out.join(n, "sid", "left").fillna(0, ["nbas"])
    return out


def unredeemed_count(nbas: DataFrame) -> DataFrame:
    """Per user: NBAs not yet redeemed."""
    return nbas.groupBy("uid").agg(
        F.count_if(~F.coalesce(F.col("redeemed"), F.lit(False))).alias("unredeemed"))


def signal_distribution(signals: DataFrame) -> DataFrame:
    return signals.groupBy("signal").count().orderBy(F.desc("count"), "signal")


def signal_severity_distribution(signals: DataFrame) -> DataFrame:
    return signals.groupBy("signal", "severity").count() \
        .orderBy(F.desc("signal"), F.desc("count"), "severity")


def nba_distribution(nbas: DataFrame) -> DataFrame:
    return nbas.groupBy("type").count().orderBy(F.desc("count"), "type")


def nba_redeemed_distribution(nbas: DataFrame) -> DataFrame:
    return nbas.groupBy("type", "redeemed").count().orderBy("type", "redeemed")


def signals_by_day(signals: DataFrame) -> DataFrame:
    return signals.groupBy(F.to_date("ts").alias("day"), "signal").count() \
        .orderBy("day", "signal")


def redemption_rate(nbas: DataFrame) -> DataFrame:
    """Redeemed share by type and overall (type null) in one pass (rollup)."""
    return (nbas.rollup("type")
            .agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(F.col("redeemed")).alias("redeemed"),
                 F.avg(F.col("redeemed").cast("double")).alias("redemption_rate"))
            .orderBy(F.col("type").asc_nulls_last()))


def risk_distribution(predictions: DataFrame) -> DataFrame:
    """Users by churn risk tier."""
    return predictions.groupBy("churn_risk_tier").agg(F.count(F.lit(1)).alias("users")) \
        .orderBy("churn_risk_tier")


def scoring_summary(predictions: DataFrame) -> DataFrame:
    """One row: users, high/medium/low counts, average engagement rate."""
    t = F.col("churn_risk_tier")
    return predictions.agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if(t == "High").alias("high_risk"),
        F.count_if(t == "Medium").alias("medium_risk"),
        F.count_if(t == "Low").alias("low_risk"),
        F.avg("engagement_rate").alias("avg_engagement_rate"))


def row_count_reconcile(tables: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of per-table counts: (table_name, total)."""
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("total")).select(
            F.lit(name).alias("table_name"), "total")
        out = c if out is None else out.unionByName(c)
    return out
