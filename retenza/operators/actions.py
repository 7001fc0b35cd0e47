"""Next best actions: the agents' fixed rule tables as DataFrame operators.

The reference asks a language model to follow fixed tables (route by
signal, offer by severity, escalate by churn tier). Those tables are the
data work and are expressed here as column expressions and joins; titles
and messages are fixed templates instead of generated text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import sized_join
from ..schemas import (CART_LADDER, CART_OFFERS, EXIT_LADDER, EXIT_OFFERS, HIGH_RISK_OFFER,
                       SIGNAL_TO_ACTION)
from .windows import search_history_long  # noqa: F401  (re-exported for callers)

# --- message templates, written for this library (the texts are free) ------
TITLES = {
    "shipping-discount": "Delivery on better terms",
    "cart-rescue": "Still in your basket",
    "social-proof-notification": "Much wanted today",
    "discount-product-recommendation": "A deal picked for you",
}
SOCIAL_PROOF_MESSAGE = "Shoppers are adding this to their carts right now."
RECOMMENDATION_DISCOUNT = "10% off"
# ---------------------------------------------------------------------------


def _map(c: Column, table: dict) -> Column:
    expr = None
    for k, v in table.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr


def route_signal(signals: DataFrame) -> DataFrame:
    """signal -> action type; an unknown signal gets status 'error'."""
    t = _map(F.col("signal"), SIGNAL_TO_ACTION)
    return signals.withColumn("type", t).withColumn(
        "status", F.when(t.isNull(), F.lit("error")).otherwise(F.lit("ok")))


def exit_offer_baseline(signals: DataFrame) -> DataFrame:
    """Exit risk: low 15, medium 20, high 25, urgent 30 % off."""
    return signals.withColumn(
        "baselineDecision",
        F.when(F.col("signal") == "exit-risk", _map(F.col("severity"), EXIT_OFFERS)))


def cart_offer_baseline(signals: DataFrame) -> DataFrame:
    """Cart abandonment: low 10, medium 15, high 20 % off."""
    return signals.withColumn(
        "baselineDecision",
        F.when(F.col("signal") == "cart-abandonment", _map(F.col("severity"), CART_OFFERS)))


def baseline_decision() -> Column:
    s = F.col("signal")
    return (F.when(s == "exit-risk", _map(F.col("severity"), EXIT_OFFERS))
             .when(s == "cart-abandonment", _map(F.col("severity"), CART_OFFERS)))


def _one_rung_up(baseline: Column, ladder: list[str]) -> Column:
    arr = F.array(*[F.lit(x) for x in ladder])
    idx = F.array_position(arr, baseline)          # 1-based, 0 if absent
    return F.when(idx > 0, F.element_at(arr, F.least(idx + 1, F.lit(len(ladder))).cast("int")))\
        .otherwise(baseline)


def enriched_decision(baseline: Column, tier: Column) -> Column:
    """High -> free shipping + 25 %; Medium -> one rung up (top stays top);
    Low or no score -> baseline. Never below the baseline."""
    s = F.col("signal")
    ladder_up = (F.when(s == "exit-risk", _one_rung_up(baseline, EXIT_LADDER))
                  .when(s == "cart-abandonment", _one_rung_up(baseline, CART_LADDER)))
    return (F.when(baseline.isNull(), F.lit(None))
             .when(tier == "High", F.lit(HIGH_RISK_OFFER))
             .when(tier == "Medium", ladder_up)
             .otherwise(baseline))


def reason_text(baseline: Column, enriched: Column, tier: Column, prob: Column,
                factor: Column) -> Column:
    driver = F.coalesce(F.regexp_replace(factor, "_", " "), F.lit("no single factor"))
    return (F.when(baseline.isNull(), F.lit(None))
             .when(tier == "High", F.format_string(
                 "Standard offer %s; raised because of a High churn risk (%.2f, mostly %s): %s.",
                 baseline, prob, driver, enriched))
             .when(tier == "Medium", F.format_string(
                 "Standard offer %s; one step up for a Medium churn risk (%.2f, mostly %s): %s.",
                 baseline, prob, driver, enriched))
             .when(tier.isNotNull(), F.format_string(
                 "Churn risk %s (%.2f): the standard offer %s stands.", tier, prob, baseline))
             .otherwise(F.format_string("No churn score: the standard offer %s stands.", baseline)))


def offer_enriched(signals: DataFrame, scores: DataFrame | None,
                   enabled: bool = True) -> DataFrame:
    """Baseline and churn-enriched offers for exit-risk and cart signals.

    ``scores`` holds one row per uid (uid, churn_probability,
    churn_risk_tier, top_risk_factor); it is joined with a size check.
    """
    out = signals.withColumn("baselineDecision", baseline_decision())
    if enabled and scores is not None:
        sc = scores.select("uid", F.col("churn_probability").alias("churnProbability"),
                           F.col("churn_risk_tier").alias("churnRiskTier"),
                           F.col("top_risk_factor").alias("topRiskFactor"))
        out = sized_join(out, sc, "uid", "left")
        offer_kind = F.col("baselineDecision").isNotNull()
        out = (out
               .withColumn("churnProbability", F.when(offer_kind, F.col("churnProbability")))
               .withColumn("churnRiskTier", F.when(offer_kind, F.col("churnRiskTier")))
               .withColumn("topRiskFactor", F.when(offer_kind, F.col("topRiskFactor"))))
        out = out.withColumn("enrichedDecision",
                             enriched_decision(F.col("baselineDecision"), F.col("churnRiskTier")))
        out = out.withColumn("reason", reason_text(
            F.col("baselineDecision"), F.col("enrichedDecision"), F.col("churnRiskTier"),
            F.col("churnProbability"), F.col("topRiskFactor")))
    else:
        out = (out.withColumn("churnProbability", F.lit(None).cast("double"))
               .withColumn("churnRiskTier", F.lit(None).cast("string"))
               .withColumn("topRiskFactor", F.lit(None).cast("string"))
               .withColumn("enrichedDecision", F.lit(None).cast("string"))
               .withColumn("reason", F.lit(None).cast("string")))
    return out


def session_for_signal(signals: DataFrame, history: DataFrame) -> DataFrame:
    """Intent text for friction signals: the user's last search query in the
    session when the session has a search history, else the signal's topic
    value.

    ``history`` is the long search history (userId, sessionId, ts, event_id,
    query); the last query per user and session is an algebraic ``max_by``.
    """
    last_q = history.groupBy(F.col("userId").alias("uid"), F.col("sessionId").alias("sid")).agg(
        F.max_by("query", F.struct("ts", "event_id")).alias("lastQuery"),
        F.count(F.lit(1)).alias("historyLength"))
    j = sized_join(signals, last_q, ["uid", "sid"], "left")
    return j.withColumn("intentSummary",
                        F.when(F.coalesce(F.col("historyLength"), F.lit(0)) > 0,
                               F.col("lastQuery")).otherwise(F.col("topic.value")))


def product_buyers(signals: DataFrame) -> DataFrame:
    """(productId, buyers): distinct users with a high-intent signal on the product."""
    return (signals.filter(F.col("signal") == "high-intent")
            .groupBy("productId").agg(F.count_distinct("uid").alias("buyers")))


def nba_product_embed(nbas: DataFrame, products: DataFrame,
                      buyers: DataFrame | None = None) -> DataFrame:
    """High-intent NBAs gain ``embedInProduct`` when the product exists.

    The pressure message uses a real count, ``product_buyers`` of all signals;
    a caller that holds only some of them (a micro-batch) passes ``buyers``.
    """
    buyers = product_buyers(nbas) if buyers is None else buyers
    known = products.select(F.col("_id").alias("productId")).join(buyers, "productId")
    j = sized_join(nbas, known, "productId", "left")
    embed = F.when((F.col("signal") == "high-intent") & F.col("buyers").isNotNull(),
                   F.struct(F.col("productId").alias("productId"),
                            F.format_string("%d people added this to their cart recently",
                                            F.col("buyers")).alias("message")))
    return j.withColumn("embedInProduct", embed).drop("buyers")


def nba_from_signals(signals: DataFrame, scores: DataFrame | None = None,
                     products: DataFrame | None = None,
                     recommendations: DataFrame | None = None,
                     enriched: bool = False, buyers: DataFrame | None = None) -> DataFrame:
    """One NBA per signal.

    ``recommendations``: optional (signal_id, productId, name, imageUrl) for
    friction signals, from ``product_recommendation``.
    """
    routed = route_signal(signals).filter(F.col("status") == "ok")
    df = offer_enriched(routed, scores, enabled=enriched)
    if products is not None:
        df = nba_product_embed(df, products, buyers)
    else:
        df = df.withColumn("embedInProduct", F.lit(None).cast(
            "struct<productId:string,message:string>"))
    if recommendations is not None:
        rec = recommendations.select(
            F.col("signal_id").alias("_id"),
            F.struct(F.col("rec_productId").alias("productId"), F.col("rec_name").alias("name"),
                     F.col("rec_imageUrl").alias("imageUrl")).alias("productRecommendation"),
            "intentSummary")
        df = df.join(rec, "_id", "left")
    else:
        df = (df.withColumn("productRecommendation", F.lit(None).cast(
            "struct<productId:string,name:string,imageUrl:string>"))
              .withColumn("intentSummary", F.lit(None).cast("string")))
    offer = F.coalesce(F.col("enrichedDecision"), F.col("baselineDecision"))
    message = (F.when(F.col("type") == "shipping-discount",
                      F.format_string("Wait! Enjoy %s before you leave.", offer))
                .when(F.col("type") == "cart-rescue",
                      F.format_string("Check out today with %s.", offer))
                .when(F.col("type") == "social-proof-notification", F.lit(SOCIAL_PROOF_MESSAGE))
                .otherwise(F.format_string("Take %s on %s today.", F.lit(RECOMMENDATION_DISCOUNT),
                                           F.coalesce(F.col("intentSummary"),
                                                      F.lit("your picks")))))
    return df.select(
        F.col("_id").alias("signal_id"), "uid", "sid", "type",
        F.lit(False).alias("redeemed"),
        F.struct(
            _map(F.col("type"), TITLES).alias("title"),
            message.alias("message"),
            F.concat_ws("_", F.col("severity"), F.col("signal")).alias("triggeredBySignal"),
            F.col("baselineDecision"), F.col("enrichedDecision"),
            F.col("churnProbability"), F.col("churnRiskTier"), F.col("topRiskFactor"),
            F.col("reason"), F.col("productRecommendation")).alias("actionMetadata"),
        "embedInProduct", "signal", "severity", "ts", "productId")


def redeem(nbas: DataFrame, redemption_log: DataFrame, key: str = "signal_id") -> DataFrame:
    """Set ``redeemed`` true for ids in the log (deduplicated first, so the
    join never multiplies rows)."""
    log = redemption_log.select(key).distinct().withColumn("_hit", F.lit(True))
    return (nbas.join(log, key, "left")
            .withColumn("redeemed", F.coalesce(F.col("_hit"), F.col("redeemed"), F.lit(False)))
            .drop("_hit"))


def flat_nbas(nbas: DataFrame) -> DataFrame:
    """Tabular projection of NBAs for reports and oracle comparison."""
    m = "actionMetadata"
    return nbas.select(
        "signal_id", "uid", "sid", "type", "redeemed",
        F.col(f"{m}.title").alias("title"), F.col(f"{m}.message").alias("message"),
        F.col(f"{m}.triggeredBySignal").alias("triggeredBySignal"),
        F.col(f"{m}.baselineDecision").alias("baselineDecision"),
        F.col(f"{m}.enrichedDecision").alias("enrichedDecision"),
        F.col(f"{m}.churnRiskTier").alias("churnRiskTier"),
        F.col("embedInProduct.productId").alias("embedProductId"),
        F.col("embedInProduct.message").alias("embedMessage"))
