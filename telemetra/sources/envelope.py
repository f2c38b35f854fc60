"""Message envelopes: packing events into compressed JSON arrays and decoding them again."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.operators.validation import split_valid, validate_lenient
from telemetra.schemas import ENVELOPE, LENIENT_EVENT

# Raw topic, headers of a packed message, events per message.
RAW_TOPIC = "telemetry.raw"
BATCH_HEADERS = {"content-encoding": "gzip", "content-type": "application/json", "schema": "telemetry.raw.batch.v1"}
BATCH_EVENTS = 500

EVENT_FIELDS = LENIENT_EVENT.replace(", request_size int, response_size int", "")


# A message holds many events, so messages reach Python a hundred at a time (a plain function's batch), not 10,000.


def _pack(value):
    return None if value is None else gzip.compress(bytes(value), mtime=0)


def publish_batches(
    events: DataFrame, seq: str = "seq", batch: int = BATCH_EVENTS, topic: str = RAW_TOPIC, partitions: int = 1
) -> DataFrame:
    """Packs events, in arrival order, into one gzip JSON array per ``batch`` arrival numbers.

    A group holds at most ``batch`` rows, whatever the endpoint mix. Messages go to ``partitions`` in turn, each with
    offsets of its own.
    """
    names = [c for c in events.columns if c != seq]
    grouped = events.groupBy(F.floor(F.col(seq) / batch).cast("bigint").alias("offset")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(seq).alias("_seq"), *names))).alias("rows")
    )
    body = F.to_json(F.transform("rows", lambda r: F.struct(*[r[n].alias(n) for n in names])))
    plain = grouped.select("offset", F.encode(body, "utf-8").alias("value"))
    headers = F.array(
        *[F.struct(F.lit(k).alias("key"), F.encode(F.lit(v), "utf-8").alias("value")) for k, v in BATCH_HEADERS.items()]
    )

    packed = plain.withColumn("value", F.udf(_pack, "binary", useArrow=False)("value"))
    return packed.select(
        F.lit(topic).alias("topic"),
        (F.col("offset") % partitions).cast("int").alias("partition"),
        F.floor(F.col("offset") / partitions).cast("bigint").alias("offset"),
        headers.alias("headers"),
        "value",
    )


ARRIVAL = ["batch", "partition", "offset", "pos"]


def arrival(batch: int | Column = 0) -> Column:
    """The order in which items came: (batch, partition, offset, pos) as one comparable value.

    Items of different partitions have no order of their own; the batch that brought them comes first, then the
    partition's number, so that no two items are equal. ``pos`` is null for a message that could not be read.
    """
    number = batch if isinstance(batch, Column) else F.lit(batch)
    return F.struct(number.cast("bigint").alias("batch"), *[F.col(c).cast("bigint").alias(c) for c in ARRIVAL[1:]])


def arrival_fields(df: DataFrame, seq: str = "seq") -> list[Column]:
    """The four numbers of an arrival order; a plain number counts as the offset."""
    if isinstance(df.schema[seq].dataType, T.StructType):
        return [F.col(f"{seq}.{c}").alias(c) for c in ARRIVAL]
    return [(F.col(seq).cast("bigint") if c == "offset" else F.lit(0).cast("bigint")).alias(c) for c in ARRIVAL]


def _unsnappy(data: bytes) -> bytes:
    """A raw snappy block. Its length stands in front, seven bits a byte; Arrow's codec wants to be told it."""
    size = shift = 0
    for byte in data:
        size |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            break
    if size > 64 * len(data):  # beyond what the format can hold, so nothing is allocated for it
        raise ValueError("snappy length does not fit the data")
    return pa.decompress(data, decompressed_size=size, codec="snappy", asbytes=True)


def _decompress(value, coding):
    """Text of a message, or what is wrong with it."""
    try:
        if coding == "gzip" or bytes(value[:2]) == b"\x1f\x8b":
            return gzip.decompress(bytes(value)).decode("utf-8"), None
        if coding == "snappy":
            return _unsnappy(bytes(value)).decode("utf-8"), None
        return bytes(value).decode("utf-8"), None
    except UnicodeDecodeError as exc:
        return None, f"JSON decode failed: {exc}"
    except Exception as exc:  # any codec fault makes this one message corrupt
        return None, f"Decompression failed: {exc}"


def decode_items(envelope: DataFrame) -> DataFrame:
    """One row per array item (``pos``, ``item`` text) and one per corrupt message (``error``)."""
    lower = F.transform("headers", lambda h: F.struct(F.lower(h["key"]).alias("k"), F.decode(h["value"], "utf-8").alias("v")))
    coding = F.try_element_at(F.filter(lower, lambda h: h["k"] == "content-encoding"), F.lit(-1))["v"]
    present = envelope.filter(F.col("value").isNotNull()).select(
        "topic", "partition", "offset", "value", F.lower(coding).alias("coding")
    )
    # once a message: Spark neither repeats nor moves what it takes for not deterministic
    decompressed = F.udf(_decompress, "body string, error string", useArrow=False).asNondeterministic()
    text = present.select("topic", "partition", "offset", decompressed("value", "coding").alias("text")).select(
        "topic", "partition", "offset", "text.*"
    )
    # parsed once as a variant: says whether the text is JSON, and whether it is an array
    v = text.withColumn("v", F.try_parse_json("body"))
    kind = F.schema_of_variant("v")
    fault = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("v").isNull(), "JSON decode failed")
        .when(~F.startswith(kind, F.lit("ARRAY")), "Expected JSON array, got single object or other type")
    )
    # items of a good message and the one row of a corrupt one come from the same pass
    wrong = F.array(F.when(F.startswith("fault", F.lit("Expected")), F.col("body")))
    found = F.when(F.col("fault").isNull(), F.from_json("body", "array<string>")).otherwise(wrong)
    rows = v.withColumn("fault", fault).select("topic", "partition", "offset", "fault", F.posexplode(found).alias("pos", "item"))
    return rows.select(
        "topic", "partition", "offset", F.when(F.col("fault").isNull(), F.col("pos")).alias("pos"), "item", F.col("fault").alias("error")
    )


def checked_messages(envelope: DataFrame) -> DataFrame:
    """The items of messages with the first rule each breaks in ``reason``; only bad ones keep their ``payload``.
    Extra fields are ignored, types must fit."""
    items = decode_items(envelope)
    event = F.when(F.col("error").isNull(), F.from_json("item", LENIENT_EVENT))
    parsed = items.select("topic", "partition", "offset", "pos", F.col("item").alias("payload"), "error", event.alias("event"))
    checked = validate_lenient(parsed.select(*parsed.columns[:-1], "event.*"))
    checked = checked.withColumn("reason", F.coalesce("error", "reason")).drop("error")
    return checked.withColumn("payload", F.when(F.col("reason").isNotNull(), F.col("payload")))


def split_messages(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, invalid payloads with reason)."""
    ok, bad = split_valid(checked)
    return ok.drop("payload"), bad.select("topic", "partition", "offset", "pos", "payload", "reason")


def decode_messages(envelope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, invalid payloads with reason), each from a decoding of its own."""
    return split_messages(checked_messages(envelope))


def lag_by_partition(consumed: DataFrame, log_ends: DataFrame) -> DataFrame:
    """Lag per (topic, partition): the log's end offset minus the last consumed one, never negative."""
    at = ["topic", "partition"]
    done = consumed.groupBy(*at).agg(F.max("offset").alias("offset"))
    lag = F.greatest(F.lit(0).cast("bigint"), F.col("high") - F.coalesce("offset", F.lit(-1)) - 1)
    return log_ends.join(done, at, "left").select(*at, lag.alias("lag"))


def read_envelopes(spark, path: str, streaming: bool = False, max_files: int = 1000) -> DataFrame:
    """Message files with the envelope columns; the checkpoint of the reading query is the commit."""
    if streaming:
        return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", max_files).parquet(path)
    return spark.read.schema(ENVELOPE).parquet(path)


def read_kafka(spark, servers: str, topic: str = RAW_TOPIC, **options: str) -> DataFrame:
    """The same columns from Kafka. Needs the Spark Kafka package on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option("subscribe", topic).option("startingOffsets", "latest").option("includeHeaders", "true")
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load().select("topic", "partition", "offset", "headers", "value")
