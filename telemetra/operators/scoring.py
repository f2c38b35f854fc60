"""Training, scoring and explaining boosted-tree failure models."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetra.functions.scalars import finite
from telemetra.functions.trees import with_contributions
from telemetra.operators.evaluation import IMPORTANCE_WARNING, cv_folds, roc_auc
from telemetra.operators.predictions import label_risk
from telemetra.schemas import FEATURES, LEGACY_FEATURES, TOP_FEATURES
from telemetra.session import materialize

# Training settings, positive-weight cap, explanation gate, stored factors.
DEPTH, RATE, ROUNDS, SUBSAMPLE, COLSAMPLE, MIN_LEAF = 6, 0.01, 700, 0.8, "0.8", 5
MAX_POSITIVE_WEIGHT = 4.0
EXPLAIN_MIN_RISK = 0.65
TOP_K = 5
TRAINED_MODEL_VERSION = "1.2.0"


def feature_order(names: Sequence[str] | None = None, count: int | None = None) -> list[str]:
    """The model's own names; else the older list when the count fits it; else the first ``count`` features."""
    if names:
        return list(names)
    if count == len(LEGACY_FEATURES):
        return list(LEGACY_FEATURES)
    if count and 0 < count <= len(FEATURES):
        return FEATURES[:count]
    return list(FEATURES)


def feature_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """All columns, plus the model's inputs as finite doubles; absent ones are 0."""
    return df.withColumns(
        {n: finite(F.col(n).cast("double")) if n in df.columns else F.lit(0.0) for n in order}
    )


def with_class_weight(df: DataFrame, cap: float = MAX_POSITIVE_WEIGHT) -> DataFrame:
    """``weight``: negatives per positive, capped, on positive rows; 1 on the others."""
    ratio = df.agg((F.count_if(F.col("label") == 0) / F.nullif(F.count_if(F.col("label") == 1), F.lit(0))).alias("r"))
    positive = F.least(F.coalesce(ratio.scalar(), F.lit(1.0)), F.lit(cap))
    return df.withColumn("weight", F.when(F.col("label") == 1, positive).otherwise(1.0))


def train(
    df: DataFrame,
    features: Sequence[str],
    rounds: int = ROUNDS,
    depth: int = DEPTH,
    rate: float = RATE,
    validation: str | None = None,
    seed: int = 42,
) -> PipelineModel:
    """Boosted trees on ``label``. ``validation`` names a boolean column: those rows stop the boosting early."""
    weighted = with_class_weight(feature_columns(df, features))
    assembler = VectorAssembler(inputCols=list(features), outputCol="vector")
    booster = GBTClassifier(
        featuresCol="vector",
        labelCol="label",
        weightCol="weight",
        maxDepth=depth,
        stepSize=rate,
        maxIter=rounds,
        subsamplingRate=SUBSAMPLE,
        featureSubsetStrategy=COLSAMPLE,
        minInstancesPerNode=MIN_LEAF,
        seed=seed,
    )
    if validation:
        booster = booster.setValidationIndicatorCol(validation)
    prepared = assembler.transform(weighted)
    return PipelineModel(stages=[assembler, booster.fit(prepared)])


def tree_model(model: PipelineModel) -> GBTClassificationModel:
    return model.stages[-1]


def save_model(model: PipelineModel, path: str, features: Sequence[str], metadata: dict[str, float]) -> None:
    """Model under ``path/model``, its trees under ``path/trees`` and one row of metadata."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    tree_model(model).write().overwrite().save(f"{path}/trees")
    row = spark.range(1).select(
        F.lit(TRAINED_MODEL_VERSION).alias("model_version"),
        F.lit(dt.datetime.now(dt.timezone.utc)).alias("training_date"),
        F.array(*[F.lit(f) for f in features]).alias("feature_columns"),
        F.create_map(*[F.lit(x) for kv in metadata.items() for x in (kv[0], float(kv[1]))]).alias("metrics"),
    )
    row.write.mode("overwrite").parquet(f"{path}/metadata")


def with_risk(features: DataFrame, model: PipelineModel, order: Sequence[str]) -> DataFrame:
    """Adds ``risk_score`` with label and confidence: one vectorised pass, no shuffle."""
    scored = model.transform(feature_columns(features, order))
    risk = scored.withColumn("risk_score", vector_to_array("probability")[1])
    return label_risk(risk.drop("vector", "rawPrediction", "probability", "prediction"))


def top_features(order: Sequence[str], k: int = TOP_K, contributions: str = "contributions") -> Column:
    """The k features with the largest absolute contribution, as stored items."""
    items = F.array(
        *[
            F.struct(
                F.abs(F.col(contributions)[i]).alias("abs_contribution"),
                F.lit(name).alias("feature"),
                F.lit(name).alias("name"),
                F.col(name).cast("double").alias("value"),
                F.col(contributions)[i].alias("contribution"),
            )
            for i, name in enumerate(order)
        ]
    )
    best = F.slice(F.sort_array(items, asc=False), 1, k)
    return F.transform(
        best, lambda x: F.struct(*[x[n].alias(n) for n in ("feature", "name", "value", "contribution", "abs_contribution")])
    )


def score(
    features: DataFrame,
    model: PipelineModel,
    order: Sequence[str],
    trees_path: str | None = None,
    explain_min_risk: float = EXPLAIN_MIN_RISK,
    top_k: int = TOP_K,
) -> DataFrame:
    """Risk for all rows; factors only for warmed-up rows at or above the risk gate.

    The gate filters before the Python stage, so only rows to be explained ever reach it.
    """
    scored = with_risk(features, model, order)
    empty = F.array().cast(TOP_FEATURES)
    if trees_path is None:
        return scored.withColumn("top_features", empty)
    gate = F.coalesce(F.col("is_warmed_up"), F.lit(False)) & (F.col("risk_score") >= explain_min_risk)
    explained = with_contributions(scored.filter(gate), trees_path, list(order))
    explained = explained.withColumn("top_features", top_features(order, top_k)).drop("contributions", "base_score")
    return explained.unionByName(scored.filter(~gate).withColumn("top_features", empty))


def global_importance(explained: DataFrame, order: Sequence[str]) -> DataFrame:
    """Mean absolute contribution per feature, its share, and whether one feature dominates."""
    row = explained.agg(*[F.avg(F.abs(F.col("contributions")[i])).alias(n) for i, n in enumerate(order)])
    long = row.unpivot([], list(order), "feature", "mean_abs")
    share = F.col("mean_abs") / F.nullif(F.sum("mean_abs").over(Window.partitionBy()), F.lit(0.0))
    return long.withColumn("share", share).withColumn("dominates", F.col("share") > IMPORTANCE_WARNING)


def fold_auc(df: DataFrame, order_by: Sequence[str], features: Sequence[str], folds: int = 5, **settings) -> DataFrame:
    """(fold, auc) of forward-chaining cross-validation: one training job per fold, one ranking for all of them."""
    parts = materialize(cv_folds(df, order_by, folds), "folds")
    out = None
    for fold in range(1, folds + 1):
        rows = parts.filter(F.col("fold") == fold)
        model = train(rows.filter(F.col("part") == "train"), features, **settings)
        scored = with_risk(rows.filter(F.col("part") == "test"), model, features).select("fold", "label", F.col("risk_score").alias("score"))
        out = scored if out is None else out.unionAll(scored)
    return roc_auc(out, ["fold"]).withColumnRenamed("roc_auc", "auc").orderBy("fold")


def risk_report(scored: DataFrame, threshold: float) -> DataFrame:
    """Report rows: rounded risk, label at the threshold, confidence in it, truth and factors."""
    hit = F.col("risk_score") >= threshold
    return scored.select(
        *[c for c in ("time", "org_id", "api_id", "endpoint", "method") if c in scored.columns],
        F.round("risk_score", 4).alias("risk_score"),
        F.when(hit, "DOWNTIME").otherwise("NORMAL").alias("prediction"),
        F.round(F.when(hit, F.col("risk_score")).otherwise(1 - F.col("risk_score")), 4).alias("confidence"),
        F.col("label").alias("true_label"),
        *[c for c in ("top_features",) if c in scored.columns],
    )
