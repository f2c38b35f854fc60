"""Prediction rows: labels, keyed merge, alerts, listing and grouping."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.scalars import clamp, clip01, iso_utc, minute, relative_age, risk_band, risk_label
from telemetra.schemas import ENDPOINT_KEY, FEATURES, TOP_FEATURES

# Fixed values of a stored prediction.
MODEL_VERSION = "1.0"
FEATURE_SCHEMA_VERSION = "2.0"
ALERT_THRESHOLD = 0.8
ALERT_SEVERITY = "high"

PREDICTION_KEY = [*ENDPOINT_KEY, "time"]
DEFAULT_PAGE, MAX_PAGE = 50, 100


def label_risk(df: DataFrame, risk: str = "risk_score") -> DataFrame:
    """Clips the risk to [0, 1], then adds the label and the confidence."""
    clipped = df.withColumn(risk, clip01(risk))
    return clipped.withColumn("prediction", risk_label(risk)).withColumn(
        "confidence", F.greatest(F.col(risk), 1 - F.col(risk))
    )


def prediction_rows(scored: DataFrame, model_hash: str = "") -> DataFrame:
    """Scored feature rows in the stored shape; time is kept, bucketing happens in the merge."""
    if "top_features" not in scored.columns:
        scored = scored.withColumn("top_features", F.array().cast(TOP_FEATURES))
    carried = [c for c in ("seq",) if c in scored.columns]
    features = [name for name in FEATURES if name in scored.columns]
    pairs = [x for name in features for x in (F.lit(name), F.col(name))]
    values = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    return scored.select(
        "time",
        *ENDPOINT_KEY,
        "risk_score",
        "prediction",
        "confidence",
        F.coalesce("top_features", F.array().cast(TOP_FEATURES)).alias("top_features"),
        values.alias("feature_values"),
        F.lit(MODEL_VERSION).alias("model_version"),
        F.lit(FEATURE_SCHEMA_VERSION).alias("feature_schema_version"),
        F.lit(model_hash).alias("model_hash"),
        F.coalesce("is_warmed_up", F.lit(False)).alias("is_warmed_up"),
        *carried,
    )


def merge_predictions(old: DataFrame | None, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Keyed upsert per minute: the highest risk stays, every other column comes from the last write.

    ``seq`` orders writes inside ``new``; stored rows come before all of them. The aggregates combine
    before the shuffle, so many rewrites of one key cost one partial row per task.
    """
    dtype = new.schema["time"].dataType
    rows = new.withColumn("time", minute("time", dtype)).withColumn("_order", F.col(seq).cast("bigint")).drop(seq)
    if old is not None:
        stored = old.drop("date").withColumn("_order", F.lit(None).cast("bigint"))
        rows = stored.unionByName(rows, allowMissingColumns=True)
    rows = rows.withColumn("_order", F.coalesce("_order", F.lit(-(1 << 62))))
    rest = [c for c in rows.columns if c not in (*PREDICTION_KEY, "risk_score", "_order")]
    merged = rows.groupBy(*PREDICTION_KEY).agg(
        F.max("risk_score").alias("risk_score"), F.max_by(F.struct(*rest), "_order").alias("_last")
    )
    return merged.select(*PREDICTION_KEY, "risk_score", "_last.*")


def latest_predictions(df: DataFrame, org_id: str | None, limit: int | None = None) -> DataFrame:
    """Newest rows of a tenant, 50 by default and at most 100; for ``None`` the newest rows of every tenant.

    Ties follow the endpoint key.
    """
    page = clamp(limit, DEFAULT_PAGE, 1, MAX_PAGE)
    columns = ["time", "api_id", "endpoint", "method", "risk_score", "prediction", "confidence"]
    columns += [c for c in ("top_features",) if c in df.columns]
    order = [F.desc("time"), "api_id", "endpoint", "method"]
    if org_id is not None:
        return df.filter(F.col("org_id") == org_id).select(*columns).orderBy(*order).limit(page)
    newest = Window.partitionBy("org_id").orderBy(*order)
    rows = df.select("org_id", *columns).withColumn("_rn", F.row_number().over(newest))
    return rows.filter(F.col("_rn") <= page).drop("_rn")


def with_band(df: DataFrame, risk: str = "risk_score") -> DataFrame:
    return df.withColumn("band", risk_band(risk))


def with_age(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Relative age: signed amount and its unit."""
    amount, unit = relative_age("time", F.lit(as_of).cast(df.schema["time"].dataType))
    return df.withColumn("age_amount", amount).withColumn("age_unit", unit)


def alerts(df: DataFrame, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    return df.filter(F.col("risk_score") >= threshold).select(
        *ENDPOINT_KEY,
        "risk_score",
        "prediction",
        F.lit(ALERT_SEVERITY).alias("severity"),
        iso_utc("time").alias("timestamp"),
    )


def normalise_top_features(column: str = "top_features") -> Column:
    """name (else feature, else "unknown"), value (else |contribution|) and |contribution|; null items go."""

    def item(x: Column) -> Column:
        size = F.abs(F.coalesce(x["contribution"], F.lit(0.0)))
        name = F.when(F.trim(x["name"]) != "", x["name"])
        feature = F.when(x["feature"] != "", x["feature"])
        return F.struct(
            F.coalesce(name, feature, F.lit("unknown")).alias("name"),
            F.coalesce(x["value"], size).alias("value"),
            size.alias("contribution"),
        )

    present = F.filter(F.coalesce(F.col(column), F.array().cast(TOP_FEATURES)), lambda x: x.isNotNull())
    return F.transform(present, item)


def prediction_groups(df: DataFrame, band: str = "all", recent: int = 3) -> DataFrame:
    """Per (api, endpoint): counts, means and maximum of risk, the newest row and the newest three events.

    The top-3 filter runs before the shuffle (group limit), so a hot endpoint sends three rows per task.
    """
    keys = ["api_id", "endpoint"]
    r = F.col("risk_score")
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.avg(r).alias("avg_risk"),
        F.greatest(F.max(r), F.lit(0.0)).alias("max_risk"),
        F.avg("confidence").alias("avg_confidence"),
        F.count_if(r >= 0.8).alias("critical_events"),
        F.count_if((r >= 0.5) & (r < 0.8)).alias("warning_events"),
        F.count_if(r < 0.5).alias("stable_events"),
    )
    newest = Window.partitionBy(*keys).orderBy(F.desc("time"), "org_id", "method")
    shown = ["time", "method", "risk_score", "prediction", "confidence"]
    shown += [c for c in ("top_features",) if c in df.columns]
    top = (
        df.withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= recent)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_rn", *shown))).alias("recent_events"))
    )
    first = F.col("recent_events")[0]
    latest = [
        first["time"].alias("latest_at"),
        first["prediction"].alias("latest_prediction"),
        first["confidence"].alias("latest_confidence"),
    ]
    if "top_features" in shown:
        latest.append(first["top_features"].alias("top_features"))
    groups = stats.join(top, keys).select(*stats.columns, *latest, "recent_events")
    wanted = {
        "critical": F.col("max_risk") >= 0.8,
        "warning": (F.col("max_risk") >= 0.5) & (F.col("max_risk") < 0.8),
        "stable": F.col("max_risk") < 0.5,
    }
    return groups.filter(wanted[band]) if band in wanted else groups


def sort_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("max_risk"), F.desc("latest_at"), "api_id", "endpoint")


def group_totals(groups: DataFrame) -> DataFrame:
    """All events, number of critical groups and the mean of the group means."""
    return groups.agg(
        F.coalesce(F.sum("total_events"), F.lit(0)).cast("bigint").alias("total_signals"),
        F.count_if(F.col("max_risk") >= 0.8).cast("bigint").alias("critical_groups"),
        F.coalesce(F.avg("avg_risk"), F.lit(0.0)).alias("average_risk"),
    )


def run_metrics(df: DataFrame, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Risk range and counts of one scoring run."""
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("predictions_written"),
        F.coalesce(F.min("risk_score"), F.lit(0.0)).alias("risk_score_min"),
        F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("risk_score_max"),
        F.coalesce(F.avg("risk_score"), F.lit(0.0)).alias("risk_score_avg"),
        F.count_if(F.col("risk_score") >= threshold).cast("bigint").alias("above_threshold_count"),
        F.count_if(F.col("is_warmed_up")).cast("bigint").alias("warmed_up_predictions"),
        F.count_if(~F.col("is_warmed_up")).cast("bigint").alias("cold_start_predictions"),
    )
