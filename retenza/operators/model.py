"""Churn model on Spark ML: random forest, cross-validated accuracy, scoring.

Training, validation and scoring run distributed (``Pipeline`` of
``VectorAssembler`` + ``RandomForestClassifier``); only the model's ten
feature importances ever reach the driver.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import FEATURE_COLUMNS
from ..session import cut_lineage
from ..sources.keyed import upsert_scores_to
from ..sources.sinks import append_table, read_if_exists
from .features import churn_features, churn_label, new_users, tier_of, top_factor_expr

LABEL_META = {"ml_attr": {"type": "nominal", "num_vals": 2, "name": "label"}}


def _training_frame(features: DataFrame) -> DataFrame:
    """Features (nulls -> 0) with a two-class nominal label, so a one-class
    sample still yields a two-element probability (0 or 1 for class 1)."""
    df = features.fillna(0, FEATURE_COLUMNS)
    if "churned" not in df.columns:
        df = churn_label(df)
    return df.withColumn("label", F.col("churned").cast("double").alias("label",
                                                                       metadata=LABEL_META))


def churn_pipeline(trees: int = 50, depth: int = 3, seed: int = 42) -> Pipeline:
    assembler = VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol="features",
                                handleInvalid="keep")
    rf = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed,
                                labelCol="label", featuresCol="features")
    return Pipeline(stages=[assembler, rf])


def stratified_folds(data: DataFrame, folds: int, label: str = "label", key: str = "uid", seed: int = 42) -> DataFrame:
    """Add ``fold``, 0 to ``folds - 1``: rows are dealt out class after class, in a seeded order, so
    a class's counts in any two folds differ by one at most, and so do the folds' sizes.

    A row's number in its class is counted inside its part and added up over the
    parts, so no class is ordered in one task."""
    parts = data.withColumn("_h", F.xxhash64(key, F.lit(seed))).repartitionByRange("_h", key) \
        .sortWithinPartitions("_h", key).withColumn("_at", F.monotonically_increasing_id())
    parts = cut_lineage(parts).withColumn("_p", F.shiftright("_at", 33))
    sizes = parts.groupBy(F.col(label).alias("_l"), "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_l", "_p").rowsBetween(Window.unboundedPreceding, -1))   # a row per part
    sizes = sizes.select("_l", "_p", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p", label).orderBy("_at")))
    return inside.join(F.broadcast(sizes), (inside[label] == sizes["_l"]) & (inside["_p"] == sizes["_p"])).select(
        *[inside[c] for c in data.columns],
        F.pmod(F.col("_before") + F.col("_i") - 1, F.lit(folds)).cast("int").alias("fold"))


def train_churn_model(features: DataFrame, trees: int = 50, depth: int = 3, folds: int = 5,
                      seed: int = 42) -> tuple[PipelineModel, float | None, float | None]:
    """Fit the forest; mean and standard deviation of the accuracy over k stratified
    folds with k = min(folds, n) when n >= 5 (``folds`` 0: none).

    The training frame is checkpointed first: cross-validation reads it
    k + 1 times, and a reliable checkpoint survives executor loss.
    """
    data = cut_lineage(_training_frame(features).select("uid", "label", *FEATURE_COLUMNS))
    n = data.count()
    pipe = churn_pipeline(trees, depth, seed)
    accuracy = spread = None
    if n >= 5 and folds > 1:
        evaluator = MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label")
        k = min(folds, n)
        cv = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().build(),
                            evaluator=evaluator, numFolds=k, foldCol="fold", seed=seed)
        cv_model = cv.fit(cut_lineage(stratified_folds(data, k, seed=seed)))
        accuracy, spread = float(cv_model.avgMetrics[0]), float(cv_model.stdMetrics[0])
    model = pipe.fit(data)
    return model, accuracy, spread


def importances(model: PipelineModel) -> list[float]:
    return [float(x) for x in model.stages[-1].featureImportances.toArray()]


def model_features(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def feature_importance(model: PipelineModel, spark=None) -> DataFrame:
    """(feature, importance) sorted by importance desc (10 rows of model data)."""
    spark = spark or SparkSession.getActiveSession()
    rows = list(zip(model_features(model), importances(model)))
    return spark.createDataFrame(rows, "feature string, importance double") \
        .orderBy(F.desc("importance"), "feature")


def save_model(model: PipelineModel, path: str) -> None:
    """Pipeline (and with it the feature list, held by the assembler)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_users(features: DataFrame, model: PipelineModel) -> DataFrame:
    """uid, probability of class 1, tier, top factor, scored_at."""
    imp = importances(model)
    cols = model_features(model)
    scored = model.transform(features.fillna(0, cols))
    prob = vector_to_array(F.col("probability"))
    p1 = F.when(F.size(prob) > 1, F.element_at(prob, 2)).otherwise(F.lit(0.0))
    return scored.select(
        "uid", *[c for c in features.columns if c != "uid"],
        p1.alias("churn_probability"),
        tier_of(p1).alias("churn_risk_tier"),
        top_factor_expr(imp, cols).alias("top_risk_factor"),
        F.current_timestamp().alias("scored_at"))


def score_on_demand(uids: DataFrame, signals: DataFrame, nbas: DataFrame,
                    model: PipelineModel, path: str | None = None) -> DataFrame:
    """Score the requested users and, with ``path``, store the scores.

    One row per user with the feature struct it was scored on. A uid without
    signals gets 0.0, Low and a null factor, is not stored, and has
    ``written`` false; so has every row when nothing is stored.
    """
    req = uids.select("uid").distinct()
    scored = score_users(churn_features(signals, nbas, req), model)
    if path is not None:
        scored = cut_lineage(scored)
        upsert_scores_to(scored.sparkSession, scored, path, "uid")
    cols = model_features(model)
    out = req.join(scored, "uid", "left")
    has = F.col("total_signals").isNotNull()
    return out.select(
        "uid",
        F.when(has, F.col("churn_probability")).otherwise(F.lit(0.0)).alias("churn_probability"),
        F.when(has, F.col("churn_risk_tier")).otherwise(F.lit("Low")).alias("churn_risk_tier"),
        F.coalesce(F.col("scored_at"), F.current_timestamp()).alias("scored_at"),
        F.col("top_risk_factor"),
        F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols]).alias("features"),
        (has & F.lit(path is not None)).alias("written"))


def incremental_scoring(signals: DataFrame, nbas: DataFrame, predictions: DataFrame,
                        model: PipelineModel, path: str | None = None) -> DataFrame:
    """Score only users not yet in ``predictions``; with ``path`` the rows are
    appended to that table, of their columns those that it has. Returns them either way."""
    fresh = new_users(signals, predictions)
    scored = score_users(churn_features(signals, nbas, fresh), model)
    if path is not None:
        scored = cut_lineage(scored)
        known = read_if_exists(scored.sparkSession, path)
        rows = scored if known is None else scored.select(*[c for c in known.columns if c in scored.columns])
        append_table(rows, path)
    return scored
