"""Event and request validation: each bad row carries the first rule it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.functions.scalars import is_blank, is_uuid, parse_rfc3339

MAX_EVENTS_PER_REQUEST = 1000
ENDPOINT_BYTES = 256


def _first_reason(rules: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(failed, F.lit(text)) for failed, text in rules])


def _number_rules(size_in: str, size_out: str) -> list[tuple[Column, str]]:
    def negative(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) < 0

    return [
        (~F.coalesce(F.col("status"), F.lit(0)).between(100, 599), "status must be a valid HTTP status"),
        (negative("latency_ms"), "latency_ms must be >= 0"),
        (negative(size_in), f"{size_in} must be >= 0"),
        (negative(size_out), f"{size_out} must be >= 0"),
    ]


def _with_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds absent optional columns as nulls."""
    for name in names:
        if name not in df.columns:
            kind = "int" if name.startswith("re") else "string"
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def validate_strict(raw: DataFrame) -> DataFrame:
    """Ingest-side rules. Nothing is repaired; ``reason`` is null for a good row."""
    df = _with_columns(raw, ["endpoint_id", "request_size_bytes", "response_size_bytes"])
    too_long = F.octet_length(F.coalesce(F.col("endpoint"), F.lit(""))) >= ENDPOINT_BYTES
    rules = [
        (is_blank("timestamp"), "timestamp is required"),
        (parse_rfc3339("timestamp").isNull(), "timestamp must be RFC3339"),
        (is_blank("org_id"), "org_id is required"),
        (~is_uuid("org_id"), "org_id must be a valid uuid"),
        (is_blank("api_id"), "api_id is required"),
        (~is_uuid("api_id"), "api_id must be a valid uuid"),
        (~is_blank("endpoint_id") & ~is_uuid(F.trim("endpoint_id")), "endpoint_id must be a valid uuid"),
        (is_blank("endpoint"), "endpoint is required"),
        (too_long, "endpoint length must be < 256"),
        (is_blank("method"), "method is required"),
        (F.upper("method") != F.col("method"), "method must be uppercase"),
        *_number_rules("request_size_bytes", "response_size_bytes"),
    ]
    return df.withColumn("reason", _first_reason(rules))


def validate_lenient(raw: DataFrame) -> DataFrame:
    """Worker-side rules: trims, upper-cases the method, accepts the short size names, defaults sizes to 0."""
    df = _with_columns(raw, ["request_size_bytes", "response_size_bytes", "request_size", "response_size"])
    for name in ("org_id", "api_id", "endpoint", "method"):
        df = df.withColumn(name, F.trim(name))
    df = (
        df.withColumn("method", F.upper("method"))
        .withColumn("request_size_bytes", F.coalesce("request_size_bytes", "request_size", F.lit(0)))
        .withColumn("response_size_bytes", F.coalesce("response_size_bytes", "response_size", F.lit(0)))
        .drop("request_size", "response_size")
    )
    rules = [
        (parse_rfc3339("timestamp").isNull(), "timestamp must be RFC3339"),
        (~is_uuid("org_id"), "org_id must be a valid uuid"),
        (~is_uuid("api_id"), "api_id must be a valid uuid"),
        (is_blank("endpoint"), "endpoint is required"),
        (is_blank("method"), "method is required"),
        (F.col("latency_ms").isNull(), "latency_ms is required"),
        *_number_rules("request_size_bytes", "response_size_bytes"),
    ]
    return df.withColumn("reason", _first_reason(rules))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("reason").isNull()).drop("reason"), df.filter(F.col("reason").isNotNull())


def to_telemetry(valid: DataFrame) -> DataFrame:
    """Valid raw events in the shape of the stored telemetry table."""
    carried = [c for c in ("seq",) if c in valid.columns]
    return valid.select(
        *carried,
        parse_rfc3339("timestamp").alias("time"),
        "org_id",
        "api_id",
        "endpoint",
        "method",
        "status",
        "latency_ms",
        F.coalesce("request_size_bytes", F.lit(0)).alias("request_size"),
        F.coalesce("response_size_bytes", F.lit(0)).alias("response_size"),
        "schema_hash",
        "schema_version",
    )


def batch_verdicts(raw: DataFrame, max_events: int = MAX_EVENTS_PER_REQUEST) -> DataFrame:
    """One row per request (``batch_id``, ``pos`` from 0): size, distinct-org check and first error.

    A request is taken whole or not at all. Plain min/max aggregates combine before the shuffle.
    """
    checked = validate_strict(raw)
    bad_at = F.min(F.when(F.col("reason").isNotNull(), F.struct("pos", "reason")))
    per_batch = checked.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("events"),
        bad_at.alias("bad"),
        (F.min("org_id") == F.max("org_id")).alias("single_org"),
    )
    reason = F.when(F.col("events") > max_events, F.lit("too many events")).when(
        F.col("bad").isNotNull(), F.format_string("event[%d]: %s", F.col("bad.pos"), F.col("bad.reason"))
    )
    return per_batch.select("batch_id", "events", F.coalesce("single_org", F.lit(False)).alias("single_org"), reason.alias("reason"))


def reject_batches(raw: DataFrame, max_events: int = MAX_EVENTS_PER_REQUEST) -> tuple[DataFrame, DataFrame]:
    """(events of accepted requests, rejected requests with their reason)."""
    verdicts = batch_verdicts(raw, max_events)
    bad = verdicts.filter(F.col("reason").isNotNull())
    return raw.join(bad.select("batch_id"), "batch_id", "left_anti"), bad


def reject_array_batches(requests: DataFrame, max_events: int = MAX_EVENTS_PER_REQUEST) -> tuple[DataFrame, DataFrame]:
    """The same for requests that arrive as ``(batch_id, events array<struct>)`` rows: no shuffle at all."""
    n = F.coalesce(F.size("events"), F.lit(0))
    shape = F.when(n < 1, "at least one event is required").when(n > max_events, "too many events")
    shaped = requests.withColumn("reason", shape)
    wrong_shape = shaped.filter(F.col("reason").isNotNull()).select("batch_id", "reason")
    events = shaped.filter(F.col("reason").isNull()).select("batch_id", F.posexplode("events").alias("pos", "event"))
    flat = events.select("batch_id", "pos", "event.*")
    ok, bad = reject_batches(flat, max_events)
    return ok, wrong_shape.unionByName(bad.select("batch_id", "reason"))
