"""Checks of a labelled minute frame. Every function returns a small DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.plans.scale import exact_quantiles, ranked, with_time_levels

# Target band of the positive rate in percent, correlation and gap limits, columns skipped.
RATE_BAND = (7.0, 12.0)
COUPLING_LIMIT = 0.15
GAP_SHARE = 0.1
METADATA = ["timestamp", "window_duration_minutes"]


def overview(df: DataFrame, time: str = "time") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls), one pass over the table."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "nulls")


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max per numeric column.

    One pass for the moments and one over the counts of (column, value) for all exact quartiles. A column without
    values has null statistics.
    """
    names = list(columns or numeric_columns(df))
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(
        *[
            F.struct(*[fn(c).cast("bigint" if s == "count" else "double").alias(s) for s, fn in stats.items()]).alias(c)
            for c in names
        ]
    )
    moments = row.unpivot([], names, "column", "s").select("column", "s.*")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in names])).alias("x")
    found = exact_quantiles(df.select(pairs).select("x.*"), "v", list(QUARTILES.values()), ["column"])
    wide = found.groupBy("column").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in QUARTILES.items()])
    return moments.join(wide, "column", "left").select("column", "count", "mean", "std", "min", *QUARTILES, "max")


def label_distribution(df: DataFrame) -> DataFrame:
    one = F.count_if(F.col("label") == 1)
    both = F.count_if(F.col("label").isin(0, 1))
    out = df.agg(both.alias("rows"), F.count_if(F.col("label") == 0).alias("normal"), one.alias("downtime"))
    pct = F.when(F.col("rows") > 0, F.col("downtime") / F.col("rows") * 100).otherwise(0.0)
    return out.withColumn("downtime_pct", pct).withColumn("in_band", F.col("downtime_pct").between(*RATE_BAND))


def class_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per (label, column): mean, sample deviation, maximum and share of non-zero values."""
    long = df.filter(F.col("label").isin(0, 1)).select(
        "label", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    )
    v = F.col("x.v")
    return long.groupBy("label", F.col("x.column").alias("column")).agg(
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.max(v).alias("max"),
        F.avg(F.when(v != 0, 1.0).otherwise(0.0)).alias("nonzero_share"),
    )


def correlations(df: DataFrame, columns: Sequence[str], target: str = "label") -> DataFrame:
    """Pearson correlation of each column with the target."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column", "correlation")


def coupling(df: DataFrame) -> DataFrame:
    r = df.agg(F.corr("traffic_rps", "p50_latency").alias("correlation"))
    return r.withColumn("coupled", F.col("correlation") > COUPLING_LIMIT)


def skewness_corrected(df: DataFrame, column: str) -> DataFrame:
    """Sample skewness (bias corrected)."""
    n = F.count(column)
    factor = F.sqrt(n * (n - 1)) / (n - 2)
    return df.agg(F.when(n > 2, F.skewness(column) * factor).alias("skewness"))


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Names of numeric columns without spread, metadata aside."""
    names = [c for c in (columns or numeric_columns(df)) if c not in METADATA]
    row = df.agg(
        *[F.when(F.count(c) > 1, F.min(c) == F.max(c)).otherwise(F.lit(False)).alias(c) for c in names]
    )
    return row.unpivot([], names, "column", "constant").filter("constant").select("column")


def chunk_distribution(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """Positive rows in each of ``n`` equal chunks of the time-ordered table; the remainder is left out.

    ``order_by`` starts with the time column and must order rows uniquely.
    """
    order = list(order_by)
    rows = ranked(with_time_levels(df, order[0]), order, ["_hour", "_minute"], total="total")
    size = F.floor(F.col("total") / n)
    chunk = F.floor((F.col("rn") - 1) / size).cast("bigint")
    return (
        rows.withColumn("chunk", chunk + 1)
        .filter(F.col("chunk") <= n)
        .groupBy("chunk")
        .agg(F.sum(F.col("label").cast("bigint")).alias("anomalies"), F.count(F.lit(1)).alias("rows"))
    )


def anomaly_starts(df: DataFrame, key: Sequence[str], time: str = "time") -> DataFrame:
    """Rows where a series turns to label 1."""
    before = F.lag("label").over(Window.partitionBy(*key).orderBy(time))
    starts = df.withColumn("_before", before).filter((F.col("label") == 1) & (F.coalesce("_before", F.lit(0)) != 1))
    return starts.drop("_before")


def max_gap(df: DataFrame, key: Sequence[str], time: str = "time") -> DataFrame:
    """Per series: widest distance in rows between successive positive rows, and whether it exceeds a tenth."""
    order = Window.partitionBy(*key).orderBy(time)
    rows = df.select(*key, time, "label", F.row_number().over(order).alias("rn"))
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    gaps = rows.filter(F.col("label") == 1).withColumn("gap", F.col("rn") - F.lag("rn").over(order))
    widest = gaps.groupBy(*key).agg(F.max("gap").cast("bigint").alias("max_gap"))
    return widest.join(sizes, list(key)).withColumn("clustered", F.col("max_gap") > F.col("rows") * GAP_SHARE)
