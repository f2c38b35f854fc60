"""Live endpoint state: running totals and last values per endpoint key."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.functions.scalars import contains_ci, is_live_error
from telemetra.schemas import ENDPOINT_KEY

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
DEFAULT_RETENTION, FALLBACK_RETENTION = 120, 60


def normalise_keys(df: DataFrame) -> DataFrame:
    for name in ENDPOINT_KEY:
        df = df.withColumn(name, F.trim(name))
    return df.withColumn("method", F.upper("method"))


def live_state(df: DataFrame, as_of: dt.datetime | None = None, retention_minutes: int = DEFAULT_RETENTION) -> DataFrame:
    """State per key; "last" follows arrival order (``seq``). Fixed-width aggregates: combined before the shuffle."""
    state = normalise_keys(df).groupBy(*ENDPOINT_KEY).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum((~is_live_error()).cast("bigint")).alias("successes"),
        F.sum(is_live_error().cast("bigint")).alias("errors"),
        F.sum(F.col("latency_ms").cast("bigint")).alias("latency_sum"),
        F.max_by("latency_ms", "seq").alias("last_latency"),
        F.max_by("status", "seq").alias("last_status"),
        F.max_by("time", "seq").alias("last_seen"),
    )
    state = (
        state.withColumn("error_rate", F.col("errors") / F.col("requests"))
        .withColumn("avg_latency", F.col("latency_sum") / F.col("requests"))
        .drop("latency_sum")
    )
    if as_of is None:
        return state
    keep = retention_minutes if retention_minutes > 0 else FALLBACK_RETENTION
    cutoff = F.lit(as_of - dt.timedelta(minutes=keep)).cast(df.schema["time"].dataType)
    return state.filter(F.col("last_seen") >= cutoff)


def page_size(limit: int | None) -> int:
    if limit is None or limit <= 0:
        return DEFAULT_LIMIT
    return min(limit, MAX_LIMIT)


def filter_live(
    state: DataFrame, org_id: str = "", api_id: str = "", method: str = "", contains: str = ""
) -> DataFrame:
    """Equality on ids and method, case-insensitive substring on the endpoint; empty means no filter."""
    for name, value in (("org_id", org_id.strip()), ("api_id", api_id.strip()), ("method", method.strip().upper())):
        if value:
            state = state.filter(F.col(name) == value)
    if contains.strip():
        state = state.filter(contains_ci("endpoint", contains))
    return state


def list_live(
    state: DataFrame, limit: int | None = None, org_id: str = "", api_id: str = "", method: str = "", contains: str = ""
) -> DataFrame:
    """Most recently seen first, then busiest; the key breaks remaining ties."""
    chosen = filter_live(state, org_id, api_id, method, contains)
    return chosen.orderBy(F.desc("last_seen"), F.desc("requests"), *ENDPOINT_KEY).limit(page_size(limit))
