"""Deleting and expiring stored rows."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.session import listing, materialize, remove, scratch_dir

RETENTION_DAYS = 90
JOB_RETENTION_DAYS = 30
TERMINAL_STATUS = ["completed", "failed"]


def without_api(df: DataFrame, org_id: str, api_id: str) -> DataFrame:
    gone = (F.col("org_id") == org_id) & (F.col("api_id") == api_id)
    return df.filter(~F.coalesce(gone, F.lit(False)))


def retained(df: DataFrame, as_of: dt.datetime, days: int = RETENTION_DAYS, time: str = "time") -> DataFrame:
    cutoff = F.lit(as_of - dt.timedelta(days=days)).cast(df.schema[time].dataType)
    return df.filter(F.col(time) >= cutoff)


def purge(df: DataFrame, predicate: Column, cutoff: dt.datetime, time: str) -> DataFrame:
    """Rows that stay when those matching ``predicate`` and older than the cutoff are purged."""
    old = F.col(time) < F.lit(cutoff).cast(df.schema[time].dataType)
    return df.filter(~F.coalesce(predicate & old, F.lit(False)))


def purge_jobs(jobs: DataFrame, as_of: dt.datetime, days: int = JOB_RETENTION_DAYS, time: str = "created_at") -> DataFrame:
    return purge(jobs, F.col("status").isin(TERMINAL_STATUS), as_of - dt.timedelta(days=days), time)


def _drop_partitions(spark: SparkSession, path: str, dates: list[dt.date]) -> None:
    for date in dates:
        remove(spark, f"{path}/date={date.isoformat()}")


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """The columns a stored table is partitioned by, outermost first, from its folder names."""
    names = []
    while found := next((n for n in listing(spark, path) if "=" in n), None):
        names.append(found.split("=", 1)[0])
        path = f"{path}/{found}"
    return names


def _as_written(spark: SparkSession, path: str, layout: list[str]) -> DataFrame:
    """The table with partition values as they stand in its folder names (hour 07 is not 7)."""
    fields = [
        T.StructField(f.name, T.StringType()) if f.name in layout and f.name != "date" else f
        for f in spark.read.parquet(path).schema
    ]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def delete_api(spark: SparkSession, path: str, org_id: str, api_id: str) -> int:
    """Deletes one api's rows from a table partitioned by date, and maybe further columns, and returns their number.

    Counts per partition come first; only partitions that hold such rows are rewritten, in the layout they have.
    """
    layout = partition_columns(spark, path)
    df = _as_written(spark, path, layout)
    hit = df.filter((F.col("org_id") == org_id) & (F.col("api_id") == api_id))
    hits = materialize(hit.groupBy(*layout).agg(F.count(F.lit(1)).alias("n")), "hits")
    deleted = hits.agg(F.sum("n")).first()[0]
    if not deleted:
        return 0
    dates = [r["date"] for r in hits.select("date").distinct().collect()]  # bounded by retained days
    rest = without_api(df.filter(F.col("date").isin(dates)), org_id, api_id).join(hits.select(*layout), layout, "left_semi")
    # staged first, so the overwrite never reads what it replaces
    staged = f"{scratch_dir(spark)}/rewrite-{uuid.uuid4().hex}"
    rest.write.partitionBy(*layout).parquet(staged)
    kept = spark.read.schema(rest.schema).parquet(staged)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*layout).parquet(path)
    # overwriting writes no partition that is left without rows: those go by name
    for row in hits.join(kept.select(*layout).distinct(), layout, "left_anti").toLocalIterator():
        remove(spark, "/".join([path, *[f"{c}={row[c]}" for c in layout]]))
    return deleted


def apply_retention(spark: SparkSession, path: str, as_of: dt.datetime, days: int = RETENTION_DAYS) -> list[dt.date]:
    """Drops whole date partitions older than the cutoff's date and returns them. No data file is read."""
    cutoff = (as_of - dt.timedelta(days=days)).date()
    dates = [r["date"] for r in spark.read.parquet(path).select("date").distinct().collect()]
    expired = sorted(d for d in dates if d < cutoff)
    _drop_partitions(spark, path, expired)
    return expired
