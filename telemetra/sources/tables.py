"""Stored tables: telemetry, predictions, catalog, minute frames, models."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.functions.scalars import clamp
from telemetra.operators.predictions import merge_predictions
from telemetra.operators.retention import partition_columns
from telemetra.schemas import MINUTES
from telemetra.session import holds_data, listing, materialize, remove

MAX_RECORDS_PER_FILE = 5_000_000


def with_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.to_date("time"))


def append_telemetry(df: DataFrame, path: str) -> None:
    """Appends events under date partitions. Rows are clustered by tenant inside each file for pruning."""
    (
        with_date(df)
        .sortWithinPartitions("date", "org_id", "time")
        .write.mode("append")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy("date")
        .parquet(path)
    )


def read_telemetry(
    spark: SparkSession, path: str, org_id: str | None = None, as_of: dt.datetime | None = None, hours: int | None = None
) -> DataFrame:
    """Telemetry of a tenant and time window. The time bound also prunes date partitions."""
    df = spark.read.option("mergeSchema", "false").parquet(path)
    if org_id is not None:
        df = df.filter(F.col("org_id") == org_id)
    if as_of is not None:
        since = as_of - dt.timedelta(hours=clamp(hours, 24, 1, 168))
        df = df.filter((F.col("date") >= since.date()) & (F.col("time") >= F.lit(since).cast(df.schema["time"].dataType)))
    return df


# Predictions are stored as versioned writes, path/date=/version=, and merged when they are read. A write only adds
# its own rows. Write n has version 2n; what compaction makes of everything up to n has 2n + 1, so it replaces nothing
# and stands after all that it holds.


def _dates(df: DataFrame, since: dt.date | None, until: dt.date | None) -> DataFrame:
    df = df if since is None else df.filter(F.col("date") >= F.lit(since))
    return df if until is None else df.filter(F.col("date") <= F.lit(until))


def read_predictions(
    spark: SparkSession, path: str, org_id: str | None = None, since: dt.date | None = None, until: dt.date | None = None
) -> DataFrame:
    """One row per (endpoint key, minute): the highest risk of all writes, everything else from the last one.

    Dates and the tenant are filtered before the merge, dates by their folders; without bounds all dates are read.
    """
    df = _dates(spark.read.parquet(path), since, until)
    df = df if org_id is None else df.filter(F.col("org_id") == org_id)
    return merge_predictions(None, df.drop("date"), "version")


def versions(spark: SparkSession, path: str, date: dt.date) -> list[int]:
    """The stored versions of a date, in order."""
    return sorted(int(n.split("=", 1)[1]) for n in listing(spark, f"{path}/date={date.isoformat()}") if n.startswith("version="))


def _write_version(rows: DataFrame, path: str, version: int) -> None:
    (
        rows.withColumn("version", F.lit(version).cast("bigint"))
        .sortWithinPartitions("date", "org_id", "time")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy("date", "version")
        .parquet(path)
    )


def upsert_predictions(df: DataFrame, path: str, seq: str = "seq", version: int | None = None) -> int:
    """Adds a batch as one version of the dates it touches, merged within itself, and returns how many dates those are.

    Nothing stored is read or rewritten. ``version`` numbers the batch (a replay under the same number replaces itself);
    without one it follows the stored ones. A replay changes no answer. A folder that is no such table is refused.
    """
    spark = df.sparkSession
    if holds_data(spark, path) and partition_columns(spark, path) != ["date", "version"]:
        raise AnalysisException(message=f"{path} is not a prediction table")
    merged = materialize(with_date(merge_predictions(None, df, seq)), "predictions-in")
    # dates of one batch: bounded by its time span, not by its rows
    dates = [r["date"] for r in merged.select("date").distinct().collect()]
    if dates:
        if version is None:
            version = max((v // 2 + 1 for d in dates for v in versions(spark, path, d)), default=0)
        _write_version(merged, path, 2 * version)
    return len(dates)


def compact_predictions(spark: SparkSession, path: str, upto: int | None = None, least: int = 2) -> list[dt.date]:
    """Merges the versions of each date that has at least ``least`` of them, up to write ``upto``, and returns the dates.

    The merged rows are a version of their own, and only then do the older ones go. Stopped anywhere, every read still
    gives the same rows, and the next run ends the work. One compaction at a time; newer writes may go on.
    """
    done = []
    for name in listing(spark, path):  # retained days
        date = dt.date.fromisoformat(name.split("=", 1)[1])
        old = [v for v in versions(spark, path, date) if upto is None or v <= 2 * upto + 1]
        if len(old) < least:
            continue
        folder = f"{path}/{name}"
        rows = spark.read.option("basePath", path).parquet(*[f"{folder}/version={v}" for v in old])
        target = old[-1] | 1
        if target in old:  # an earlier compaction and older writes that came back: the same rows, staged before they are replaced
            merged = materialize(with_date(merge_predictions(None, rows.drop("date"), "version")), "compacted")
        else:
            merged = with_date(merge_predictions(None, rows.drop("date"), "version"))
        _write_version(merged, path, target)
        for v in old:
            if v != target:
                remove(spark, f"{folder}/version={v}")
        done.append(date)
    return done


def read_minutes_csv(spark: SparkSession, path: str) -> DataFrame:
    """Minute frame from CSV with its declared schema. Order is left to the windows that need it."""
    return spark.read.csv(path, header=True, schema=MINUTES)


def read_training_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Minute frame from CSV as ``training_features`` takes it: with ``time``, and the columns of its series.

    Folders named column=value are the series; without any, every file is one, by its name in ``series``.
    """
    df = read_minutes_csv(spark, path).withColumnRenamed("timestamp", "time")
    series = partition_columns(spark, path)
    if not series:
        series, df = ["series"], df.withColumn("series", F.col("_metadata.file_name"))
    return df, series


def write_training_csv(minutes: DataFrame, path: str, key: Sequence[str]) -> None:
    """Writes minute frames as CSV in the declared columns, a folder a series, minutes in order."""
    fields = T.StructType.fromDDL(MINUTES)
    named = minutes.withColumnRenamed("time", "timestamp")
    columns = [(F.col(f.name) if f.name in named.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    rows = named.select(*columns, *key).repartition(*key).sortWithinPartitions(*key, "timestamp")
    rows.write.partitionBy(*key).option("header", True).csv(path)


def read_catalog(spark: SparkSession, path: str, org_id: str | None = None, newest: str = "created_at") -> DataFrame:
    """A catalog table, optionally of one tenant, newest rows first."""
    df = spark.read.parquet(path)
    if org_id is not None:
        df = df.filter(F.col("org_id") == org_id)
    return df.orderBy(F.desc(newest), "id")


def model_hash(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file of a saved model, as (path, model_hash)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("model_hash"))
