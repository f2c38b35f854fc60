"""Late and out-of-order events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.scalars import micros
from telemetra.schemas import ENDPOINT_KEY

LATE_AFTER = dt.timedelta(minutes=30)
ARRIVAL_BLOCK = 1 << 20


def is_late(as_of: Column, threshold: dt.timedelta = LATE_AFTER) -> Column:
    """Strictly older than the threshold."""
    return micros(as_of) - micros("time") > int(threshold.total_seconds() * 1_000_000)


def drop_late(df: DataFrame, as_of, threshold: dt.timedelta = LATE_AFTER) -> tuple[DataFrame, DataFrame]:
    """(on time, late): late is strictly older than the threshold. ``as_of`` is a datetime or a column."""
    if isinstance(as_of, dt.datetime):
        as_of = F.lit(as_of).cast(df.schema["time"].dataType)
    late = is_late(as_of, threshold)
    return df.filter(~late), df.filter(late)


def flag_out_of_order(df: DataFrame, seq: str = "seq", block: int = ARRIVAL_BLOCK) -> DataFrame:
    """Adds ``out_of_order``: older than the newest event of its key that arrived before it.

    Arrival numbers are unique, so a (key, block) window holds at most ``block`` rows however hot the
    key is; the maxima of earlier blocks come from a small per-block table on the same partitioning.
    """
    at = [*ENDPOINT_KEY, "_block"]
    blocked = df.withColumn("_block", F.floor(F.col(seq) / F.lit(block)).cast("bigint"))
    earlier = Window.partitionBy(*ENDPOINT_KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.groupBy(*at)
        .agg(F.max("time").alias("_m"))
        .select(*at, F.max("_m").over(earlier).alias("_carried"))
    )
    within = Window.partitionBy(*at).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest("_seen", "_carried")
    return (
        blocked.withColumn("_seen", F.max("time").over(within))
        .join(carried, at)
        .withColumn("out_of_order", F.coalesce(F.col("time") < seen, F.lit(False)))
        .drop("_block", "_seen", "_carried")
    )


def skew_metrics(df: DataFrame, as_of, seq: str = "seq") -> DataFrame:
    """Totals of processed, late and out-of-order events; late ones never reach the order check."""
    on_time, late = drop_late(df, as_of)
    flagged = flag_out_of_order(on_time, seq)
    parts = flagged.select(F.col("out_of_order").cast("bigint").alias("o"), F.lit(1).alias("t"), F.lit(0).alias("l"))
    parts = parts.unionAll(late.select(F.lit(0).cast("bigint"), F.lit(0), F.lit(1)))
    return parts.agg(
        F.coalesce(F.sum("t"), F.lit(0)).cast("bigint").alias("total_events_processed"),
        F.coalesce(F.sum("l"), F.lit(0)).cast("bigint").alias("late_events_dropped"),
        F.coalesce(F.sum("o"), F.lit(0)).cast("bigint").alias("out_of_order_events"),
    )
