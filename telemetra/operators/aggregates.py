"""Dashboard aggregates over the telemetry table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.functions.scalars import clamp, is_server_error

DEFAULT_HOURS, MAX_HOURS = 24, 168


def in_window(df: DataFrame, org_id: str | None, as_of: dt.datetime, hours: int | None = None) -> DataFrame:
    """Rows of the last hours (1 to 168, default 24) of one tenant, or of all tenants for ``None``."""
    hours = clamp(hours, DEFAULT_HOURS, 1, MAX_HOURS)
    since = F.lit(as_of - dt.timedelta(hours=hours)).cast(df.schema["time"].dataType)
    rows = df.filter(F.col("time") >= since)
    return rows if org_id is None else rows.filter(F.col("org_id") == org_id)


def _tenant(org_id: str | None) -> list[str]:
    """Without a tenant the statistics are kept per tenant, all in one pass."""
    return ["org_id"] if org_id is None else []


def _summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count, server-error rate and exact p95 per key.

    Rows are first counted per (key, latency), so a hot key shrinks to its distinct latencies before the
    exact percentile is taken.
    """
    counts = df.groupBy(*keys, "latency_ms").agg(
        F.count(F.lit(1)).alias("n"), F.sum(is_server_error().cast("int")).alias("errors")
    )
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("request_count"),
        (F.sum("errors").cast("double") / F.sum("n")).alias("error_rate"),
        F.percentile("latency_ms", F.lit(0.95), F.col("n")).alias("p95_latency"),
    )


def endpoint_stats(df: DataFrame, org_id: str | None, as_of: dt.datetime, hours: int | None = None) -> DataFrame:
    """Statistics by (endpoint, method), busiest first."""
    keys = [*_tenant(org_id), "endpoint", "method"]
    return _summary(in_window(df, org_id, as_of, hours), keys).orderBy(F.desc("request_count"), *keys)


def tenant_summary(df: DataFrame, org_id: str | None, as_of: dt.datetime, hours: int | None = None) -> DataFrame:
    """One row for the tenant, zeros when it has no events in the window."""
    keys = _tenant(org_id)
    return _summary(in_window(df, org_id, as_of, hours), keys).select(
        *keys,
        F.coalesce("request_count", F.lit(0)).cast("bigint").alias("request_count"),
        F.coalesce("error_rate", F.lit(0.0)).alias("error_rate"),
        F.coalesce("p95_latency", F.lit(0.0)).alias("p95_latency"),
    )


def kpi_strip(stats: DataFrame) -> DataFrame:
    """Total requests and the plain (unweighted) means over endpoints."""
    keys = [c for c in ("org_id",) if c in stats.columns]
    return stats.groupBy(*keys).agg(
        F.coalesce(F.sum("request_count"), F.lit(0)).cast("bigint").alias("total_requests"),
        F.coalesce(F.avg("error_rate"), F.lit(0.0)).alias("avg_error_rate"),
        F.coalesce(F.avg("p95_latency"), F.lit(0.0)).alias("avg_p95_latency"),
    )


def with_health(summary: DataFrame) -> DataFrame:
    pct, p95 = F.col("error_rate") * 100, F.col("p95_latency")
    label = F.when((pct > 4) | (p95 > 700), "Degraded").when((pct > 2) | (p95 > 450), "Warning").otherwise("Healthy")
    return summary.withColumn("health", label)


def with_alarm(stats: DataFrame) -> DataFrame:
    return stats.withColumn("alarm", F.col("error_rate") > 0.05)


def hourly_rollup(df: DataFrame) -> DataFrame:
    """Per organisation and hour: mean latency, server-error rate, count."""
    hour = F.date_trunc("hour", F.col("time").cast("timestamp")).cast(df.schema["time"].dataType)
    return (
        df.groupBy("org_id", hour.alias("hour"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("latency_ms").cast("bigint")).alias("_lat"),
            F.sum(is_server_error().cast("bigint")).alias("_err"),
        )
        .select(
            "org_id",
            "hour",
            (F.col("_lat") / F.col("n")).alias("avg_latency"),
            (F.col("_err") / F.col("n")).alias("error_rate"),
            F.col("n").alias("request_count"),
        )
    )
