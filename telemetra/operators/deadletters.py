"""Dead-letter records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Schema headers and topic suffixes of the two dead-letter kinds.
INVALID_SCHEMA = "dlq.invalid-payload.v1"
PROCESSING_SCHEMA = "dlq.processing-failure.v1"
INVALID_SUFFIX = ".dlq"
PROCESSING_SUFFIX = ".processing-failure.dlq"


def dlq_invalid(bad: DataFrame) -> DataFrame:
    """One record per invalid payload; ``bad`` has topic, offset, reason and the payload text (or null).

    An ``arrival`` order, if there is one, goes along.
    """
    return bad.select(
        F.concat("topic", F.lit(INVALID_SUFFIX)).alias("topic"),
        F.lit(INVALID_SCHEMA).alias("schema"),
        F.col("topic").alias("source_topic"),
        F.col("offset").alias("source_offset"),
        F.col("reason").alias("failure_reason"),
        F.col("payload").alias("original_payload"),
        *[c for c in ("arrival",) if c in bad.columns],
    )


def dlq_processing(envelope: DataFrame, reason: str) -> DataFrame:
    """One record per message whose processing failed, with the raw bytes kept as base64."""
    return envelope.select(
        F.concat("topic", F.lit(PROCESSING_SUFFIX)).alias("topic"),
        F.lit(PROCESSING_SCHEMA).alias("schema"),
        F.col("topic").alias("source_topic"),
        F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"),
        F.lit(reason).alias("failure_reason"),
        F.regexp_replace(F.base64(F.coalesce("value", F.lit(b""))), "\\s", "").alias("payload_base64"),
    )


def as_messages(records: DataFrame) -> DataFrame:
    """Dead letters as sink rows: topic, schema and a JSON value. An invalid payload is embedded as text."""
    body = [c for c in records.columns if c not in ("topic", "schema")]
    return records.select("topic", "schema", F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("value"))
