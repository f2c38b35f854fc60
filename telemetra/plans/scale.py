"""Ordering work that never needs one task to see a whole table.

A global rank, running total or exact quantile is split into nested value ranges ("levels"). Each
window then covers one bounded range, and only the small per-range totals are carried across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.session import materialize

BINS = 65_536


def running_totals(
    groups: DataFrame, levels: Sequence[str], values: Sequence[str], by: Sequence[str] = (), stored: bool = False
) -> DataFrame:
    """Adds ``before_<v>``: the sum of ``v`` over all rows ordered ahead by the nested ``levels``.

    ``groups`` holds one row per (by, levels). The first level must have a bounded number of values;
    every later level subdivides the one before it. Each level reads the groups, so they are written to
    the scratch folder once, unless they come from there (``stored``): their source is computed one time.
    """
    by, levels = list(by), list(levels)
    if not stored:
        groups = materialize(groups, "groups")

    def ahead(part: list[str], order: str):
        return Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    out = groups
    finest = ahead(by + levels[:-1], levels[-1])
    for v in values:
        out = out.withColumn(f"before_{v}", F.coalesce(F.sum(v).over(finest), F.lit(0)))
    for depth in range(len(levels) - 1, 0, -1):
        at = by + levels[:depth]
        window = ahead(by + levels[: depth - 1], levels[depth - 1])
        sums = groups.groupBy(*at).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        carried = sums.select(
            *at, *[F.coalesce(F.sum(f"_{v}").over(window), F.lit(0)).alias(f"_{v}") for v in values]
        )
        out = out.join(carried, at)
        for v in values:
            out = out.withColumn(f"before_{v}", F.col(f"before_{v}") + F.col(f"_{v}")).drop(f"_{v}")
    return out


def ranked(
    df: DataFrame,
    order_by: Sequence[str | Column],
    levels: Sequence[str],
    by: Sequence[str] = (),
    name: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """Global row number (from 1) in ``order_by`` order; ``levels`` are coarser forms of that order.

    ``total`` names a column for the number of rows, which the ranking knows anyway. The input is read
    twice (counted, then numbered): store it first when it is costly.
    """
    at = [*by, *levels]
    counts = materialize(df.groupBy(*at).agg(F.count(F.lit(1)).alias("n")), "counts")
    offsets = running_totals(counts, levels, ["n"], by, stored=True).select(*at, F.col("before_n").alias("_offset"))
    if total:
        offsets = offsets.withColumn(total, counts.agg(F.sum("n").alias("n")).scalar())
    within = F.row_number().over(Window.partitionBy(*at).orderBy(*order_by))
    return (
        df.withColumn(name, within)
        .join(offsets, at)
        .withColumn(name, (F.col(name) + F.col("_offset")).cast("bigint"))
        .drop("_offset")
    )


def with_time_levels(df: DataFrame, time: str) -> DataFrame:
    """``_hour`` and ``_minute`` levels for ordering by time."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    return df.withColumn("_hour", F.floor(us / F.lit(3_600_000_000)).cast("bigint")).withColumn(
        "_minute", F.floor(us / F.lit(60_000_000)).cast("bigint")
    )


def unit_levels(value: str) -> tuple[Column, Column]:
    """Two nested bins for a value in [0, 1]."""
    v = F.col(value)
    return F.floor(v * BINS).cast("bigint"), F.floor(v * float(BINS) * BINS).cast("bigint")


def score_totals(df: DataFrame, score: str, sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """One row per (by, distinct score) with its sums and, as ``before_*``, those of all lower scores of that group."""
    dist = df.groupBy(*by, score).agg(*[F.sum(c).cast("bigint").alias(k) for k, c in sums.items()])
    b1, b2 = unit_levels(score)
    binned = dist.withColumn("_b1", b1).withColumn("_b2", b2)
    return running_totals(binned, ["_b1", "_b2", score], list(sums), by).drop("_b1", "_b2")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per (by, prob): no value map in any one task.

    Distinct values are dealt into ranges of about equal numbers of them, so outliers do not crowd the others together.
    """
    by = list(by)
    hist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # the numbers of ranges are settled when the values are written
    hist = materialize(hist.repartitionByRange(*by, "_v").withColumn("_range", F.spark_partition_id()), "hist")
    span = hist.groupBy(*by).agg(F.sum("n").alias("_n"))

    def attach(frame: DataFrame) -> DataFrame:
        return frame.join(span, by) if by else frame.withColumn("_n", span.scalar())

    ordered = running_totals(hist, ["_range", "_v"], ["n"], by, stored=True)
    wanted = F.array(
        *[
            F.struct(F.lit(float(p)).alias("prob"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("at"))
            for p in probs
        ]
    )
    hit = attach(ordered.select(*by, "_v", "n", "before_n")).select(
        *by, "_v", "n", "before_n", F.explode(wanted).alias("q")
    )
    first, last = F.col("before_n"), F.col("before_n") + F.col("n") - 1
    low, high = F.floor("q.at"), F.ceil("q.at")
    covers_low, covers_high = low.between(first, last), high.between(first, last)
    picked = (
        hit.filter(covers_low | covers_high)
        .groupBy(*by, F.col("q.prob").alias("prob"), F.col("q.at").alias("_at"))
        .agg(F.max(F.when(covers_low, F.col("_v"))).alias("_low"), F.max(F.when(covers_high, F.col("_v"))).alias("_high"))
    )
    share = F.col("_at") - F.floor("_at")
    return picked.select(*by, "prob", (F.col("_low") + (F.col("_high") - F.col("_low")) * share).alias("value"))
