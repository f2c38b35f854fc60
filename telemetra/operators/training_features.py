"""Past-only rolling features over minute frames, for training.

One row per (key, minute) and key: windows are per series and bounded by the number of minutes kept.
These formulas differ on purpose from the serving ones (lags, sample deviations, floors, one global
threshold); both families keep their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.scalars import MINUTE_US, from_micros, is_server_error, micros
from telemetra.operators.serving_features import SLOT_SECONDS, entropy_of
from telemetra.plans.scale import exact_quantiles
from telemetra.session import materialize

CAPACITY_RPS = 2000.0
EWM_ALPHA = 0.3
# A weight of 0.7^180 is far below double precision, so a longer memory cannot change a value.
EWM_ROWS = 180


def minute_frame(
    events: DataFrame, key: Sequence[str] = ("org_id", "endpoint"), label_above: float = 0.0
) -> DataFrame:
    """Minute rows of a series from events: percentiles, variance, error rate, traffic.

    ``label`` marks an error rate above ``label_above``.
    """
    key = list(key)
    at = [*key, "minute"]
    dtype = events.schema["time"].dataType
    counts = (
        events.withColumn("minute", F.floor(micros("time") / MINUTE_US).cast("bigint"))
        .groupBy(*at, "latency_ms")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(is_server_error().cast("bigint")).alias("e"))
    )
    x = F.col("latency_ms").cast("bigint")
    n, s, ss = F.col("n"), F.col("s"), F.col("ss")
    return (
        counts.groupBy(*at)
        .agg(
            F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)), F.col("n")).alias("p"),
            F.sum(F.col("n") * x).alias("s"),
            F.sum(F.col("n") * x * x).alias("ss"),
            F.sum("e").alias("e"),
            F.sum("n").alias("n"),
        )
        .select(
            *key,
            from_micros(F.col("minute") * MINUTE_US, dtype).alias("time"),
            F.col("p")[0].alias("p50_latency"),
            F.col("p")[1].alias("p90_latency"),
            F.col("p")[2].alias("p95_latency"),
            # n * sum(x^2) - sum(x)^2 in exact integers, divided once
            ((n * ss - s * s).cast("double") / (n * n)).alias("latency_variance"),
            (F.col("e") / n).alias("error_rate"),
            (n / F.lit(60.0)).alias("traffic_rps"),
            F.when(F.col("e") / n > label_above, 1).otherwise(0).alias("label"),
        )
    )


def schema_minutes(events: DataFrame, key: Sequence[str] = ("org_id", "endpoint"), slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Schema and deploy columns of the minutes of a series, from the hashes of consecutive events.

    A change is an event whose hash differs from that of the event right before it in its series; it belongs to the
    later event's minute. An event without a hash (null or empty) changes nothing. Fields added are the changes, fields
    removed one less, breaking is a change that meets a server error, a deploy any change; the entropy is that of the
    minute's hashes. Ties in time follow ``seq``. A busy minute is dealt over its slots, whose ends are linked afterwards.
    """
    key = list(key)
    at = [*key, "minute", "slot"]
    us = micros("time")
    order = Window.partitionBy(*at).orderBy("us", "seq")
    linked = events.select(
        *key,
        us.alias("us"),
        F.floor(us / MINUTE_US).cast("bigint").alias("minute"),
        F.floor(us % MINUTE_US / (slot_seconds * 1_000_000)).cast("int").alias("slot"),
        is_server_error().alias("err"),
        F.nullif("schema_hash", F.lit("")).alias("hash"),
        F.col("seq") if "seq" in events.columns else F.lit(0).alias("seq"),
    ).select(
        *at,
        "err",
        "hash",
        F.coalesce(F.col("hash") != F.lag("hash").over(order), F.lit(False)).alias("change"),
        (F.row_number().over(order) == 1).alias("first"),
        F.lead("err").over(order).isNull().alias("last"),
    )

    def number(flag: Column) -> Column:
        return F.sum(F.coalesce(flag, F.lit(False)).cast("bigint"))

    hashes = linked.groupBy(*at, "hash").agg(
        F.count(F.lit(1)).alias("w"),
        number(F.col("change")).alias("ch"),
        number(F.col("change") & F.col("err")).alias("br"),
        F.bool_or("first").alias("first"),
        F.bool_or(F.col("first") & F.col("err")).alias("first_err"),
        F.bool_or("last").alias("last"),
    )
    slots = hashes.groupBy(*at).agg(
        F.sum("ch").alias("ch"),
        F.sum("br").alias("br"),
        F.max(F.when(F.col("first"), F.col("hash"))).alias("first_hash"),
        F.bool_or("first_err").alias("first_err"),
        F.max(F.when(F.col("last"), F.col("hash"))).alias("last_hash"),
        F.collect_list(F.when(F.col("hash").isNotNull(), F.struct(F.col("hash").alias("x"), "w"))).alias("hashed"),
    )
    before = F.lag("last_hash").over(Window.partitionBy(*key).orderBy("minute", "slot"))
    link = F.coalesce(F.col("first_hash") != before, F.lit(False))
    minutes = slots.withColumn("link", link).groupBy(*key, "minute").agg(
        (F.sum("ch") + number(F.col("link"))).alias("ch"),
        (F.sum("br") + number(F.col("link") & F.col("first_err"))).alias("br"),
        F.flatten(F.collect_list("hashed")).alias("hashed"),
    )
    return minutes.select(
        *key,
        from_micros(F.col("minute") * MINUTE_US, events.schema["time"].dataType).alias("time"),
        F.col("ch").cast("int").alias("schema_fields_added"),
        F.greatest(F.col("ch") - 1, F.lit(0)).cast("int").alias("schema_fields_removed"),
        (F.col("br") > 0).cast("int").alias("schema_breaking_changes"),
        F.coalesce(F.expr(entropy_of("hashed")), F.lit(0.0)).alias("schema_entropy"),
        (F.col("ch") > 0).cast("int").alias("recent_deploy"),
    )


def full_minute_frame(events: DataFrame, key: Sequence[str] = ("org_id", "endpoint"), label_above: float = 0.0) -> DataFrame:
    """The minute frame with schema and deploy columns and all deltas: what a training file holds."""
    frame = minute_frame(events, key, label_above).join(schema_minutes(events, key), [*key, "time"])
    return deltas(frame, key).withColumn("window_duration_minutes", F.lit(1))


def _series(key: Sequence[str]):
    return Window.partitionBy(*key).orderBy("time")


def backfill(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Nulls take the next known value of the series (reverse running frame: linear, no rescans)."""
    back = Window.partitionBy(*key).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in columns})


def training_features(minutes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds the ten rolling columns to a minute frame with ``time`` and the key columns."""
    if not key:
        raise ValueError("a series key is required: one global series would be one task")
    minutes = materialize(minutes, "minutes")  # read for the windows and for the threshold's ranges
    order = _series(key)

    def past(n: int):
        return order.rowsBetween(-n, -1)

    def enough(c: str, n: int, least: int, value: Column) -> Column:
        return F.when(F.count(c).over(past(n)) >= least, value)

    e = [F.lag("error_rate", i).over(order) for i in (1, 2, 3)]
    p95, p50 = F.lag("p95_latency").over(order), F.lag("p50_latency").over(order)
    mean30, std30 = F.avg("p95_latency").over(past(30)), F.stddev_samp("p95_latency").over(past(30))
    z = enough("p95_latency", 30, 10, (p95 - mean30) / F.greatest(std30, F.lit(1.0)))
    history = F.collect_list("error_rate").over(past(EWM_ROWS))
    q80 = exact_quantiles(minutes, "error_rate", [0.8]).select("value").scalar()
    out = minutes.select(
        "*",
        enough("p95_latency", 15, 5, F.avg("p95_latency").over(past(15))).alias("p95_latency_roll_mean_15"),
        F.coalesce(
            enough("latency_variance", 15, 5, F.stddev_samp("latency_variance").over(past(15))), F.lit(0.0)
        ).alias("latency_variance_roll_std_15"),
        enough("error_rate", 15, 5, F.avg("error_rate").over(past(15))).alias("error_rate_roll_mean_15"),
        F.coalesce((e[0] - e[1]) - (e[1] - e[2]), F.lit(0.0)).alias("error_rate_acceleration"),
        enough("traffic_rps", 10, 4, F.avg("traffic_rps").over(past(10)) / CAPACITY_RPS).alias("traffic_utilization_proxy"),
        (p95 / F.greatest(p50, F.lit(1.0))).alias("p95_to_p50_ratio"),
        F.coalesce(z, F.lit(0.0)).alias("latency_p95_zscore"),
        history.alias("_e"),
        enough("p95_latency", 15, 5, F.max("p95_latency").over(past(15))).alias("p95_latency_roll_max_15"),
        F.row_number().over(order).alias("_rn"),
        F.coalesce(e[0] > q80, F.lit(False)).cast("double").alias("_high"),
    )
    ewm = F.aggregate(
        F.slice("_e", 2, EWM_ROWS),
        F.get("_e", F.lit(0)),
        lambda acc, x: F.lit(EWM_ALPHA) * x + F.lit(1.0 - EWM_ALPHA) * acc,
    )
    streak = F.sum("_high").over(order.rowsBetween(-9, 0))
    out = out.withColumn("error_rate_ewm", F.when(F.size("_e") > 0, ewm)).withColumn(
        "error_high_streak", F.when(F.col("_rn") >= 3, streak).otherwise(0.0)
    )
    filled = [
        "p95_latency_roll_mean_15",
        "error_rate_roll_mean_15",
        "traffic_utilization_proxy",
        "p95_to_p50_ratio",
        "error_rate_ewm",
        "p95_latency_roll_max_15",
    ]
    return backfill(out.drop("_e", "_high", "_rn"), filled, key)


def deltas(minutes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Change against the previous row, 0 for the first; the latency delta follows p95."""
    order = _series(key)
    sources = {
        "latency_delta": "p95_latency",
        "error_rate_delta": "error_rate",
        "traffic_delta": "traffic_rps",
        "schema_entropy_delta": "schema_entropy",
    }
    return minutes.withColumns(
        {
            name: F.coalesce(F.col(c) - F.lag(c).over(order), F.lit(0.0))
            for name, c in sources.items()
            if c in minutes.columns
        }
    )


def repair_quantiles(minutes: DataFrame) -> DataFrame:
    """Keeps p50 < p90 < p95 apart by the fixed factors 1.15 and 1.18."""
    spread = minutes.withColumn("p90_latency", F.greatest("p90_latency", F.col("p50_latency") * 1.15))
    return spread.withColumn("p95_latency", F.greatest("p95_latency", F.col("p90_latency") * 1.18))
