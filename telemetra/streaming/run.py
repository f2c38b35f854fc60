"""Streaming jobs from messages to telemetry, ticks, predictions and alerts.

Two queries share a store folder. The first decodes messages, routes bad ones, stores telemetry and writes
the ticks its events touch. The second keeps feature history as state, scores and upserts. Every write is
keyed by the micro-batch number and replaces itself, so a batch that runs again changes nothing.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telemetra.functions.scalars import from_micros, minute_index
from telemetra.operators import deadletters, retention, timing, validation
from telemetra.operators.live import DEFAULT_RETENTION
from telemetra.operators.predictions import alerts, label_risk, prediction_rows, run_metrics
from telemetra.operators.serving_features import base_features
from telemetra.schemas import ALERT, ENDPOINT_KEY
from telemetra.session import holds_data, matching, materialize, remove
from telemetra.sources import envelope
from telemetra.sources.tables import read_predictions, upsert_predictions, with_date
from telemetra.streaming.state import BASE, TICK_SCHEMA, start_stateful, stream_live, with_stream_history

# Attempts and waits of a failing batch, and the alert message header.
ATTEMPTS = 3
FIRST_WAIT_S, MAX_WAIT_S = 0.1, 30.0
ALERT_TOPIC, ALERT_SCHEMA = "alerts", "alerts.failure-risk.v1"
# what each job counts: events, messages and ticks that came, and what became of them
COUNTERS = {
    "publish": ["received", "published"],
    "ingest": ["received", "decoded", "stored", "late", "invalid", "corrupt", "failed"],
    "alert": ["received", "stored", "published"],
}
LOOKBACK = dt.timedelta(minutes=16)
# what the carried state spans: the look-back of an event that is just not late
STATE_SPAN = LOOKBACK + timing.LATE_AFTER
STATE_COLUMNS = ["time", *ENDPOINT_KEY, "status", "latency_ms", "schema_hash", "seq"]


@dataclass(frozen=True)
class Store:
    """Folders of one deployment."""

    root: str

    def at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def write_batch(df: DataFrame, path: str, batch_id: int, *above: str) -> None:
    """Writes the rows of one micro-batch under ``batch=`` (below the ``above`` columns, if any).

    Running the batch again replaces them.
    """
    (
        df.withColumn("batch", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*above, "batch")
        .parquet(path)
    )


def read_folders(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    """Only these folders of a table, so that no listing grows with the number of batches ever run."""
    return spark.read.option("basePath", root).parquet(*folders)


def hours_since(spark: SparkSession, root: str, since: dt.datetime) -> list[str]:
    """Folders of the hours from ``since`` on; there are as many as hours are retained."""
    first = f"date={since.date().isoformat()}/hour={since.hour:02d}"
    names = ["/".join(p.split("/")[-2:]) for p in matching(spark, f"{root}/date=*/hour=*")]
    return [f"{root}/{n}" for n in names if n >= first]


def whole_minute(t: dt.datetime) -> dt.datetime:
    return t.replace(second=0, microsecond=0)


def state_folders(spark: SparkSession, store: Store) -> dict[int, str]:
    """The kept states by batch: two or three folders."""
    return {int(p.rsplit("=", 1)[1]): p for p in matching(spark, store.at("recent/batch=*"))}


def recent_events(spark: SparkSession, fresh: DataFrame, store: Store, batch_id: int) -> DataFrame | None:
    """The events that the ticks of a batch need; None for a batch without events.

    A state of narrow events, the last 46 minutes before the newest one, is carried from batch to batch: batch n reads
    the state before it and its own rows, and writes its state, so what a batch opens does not grow with the number of
    batches. Events older than the state reaches (possible without a lateness limit, or when the state is gone) are
    served from the stored hours. The last two states stay, as the last batch may run again.
    """
    seen = fresh.agg(F.min("time").alias("oldest"), F.max("time").alias("newest")).first()
    if seen["oldest"] is None:
        return None
    needed = whole_minute(seen["oldest"]) - LOOKBACK
    kind = fresh.schema["time"].dataType
    since = lambda df, t: df.filter(F.col("time") >= F.lit(t).cast(kind))
    columns = [c for c in STATE_COLUMNS if c in fresh.columns]
    known = state_folders(spark, store)
    before = max((b for b in known if b < batch_id), default=None)
    old, newest = None, seen["newest"]
    if before is not None:
        old = spark.read.parquet(known[before])
        reaches = old.agg(F.max("time").alias("t")).first()["t"]
        newest = max(newest, reaches)
        if needed < whole_minute(reaches) - STATE_SPAN:
            old = None
    keep_from = whole_minute(newest) - STATE_SPAN
    if old is not None:
        events = old.unionByName(fresh.select(*columns))
    else:
        root, first = store.at("telemetry"), min(needed, keep_from)
        events = since(read_folders(spark, root, hours_since(spark, root, first)).filter(~F.col("is_late")), first).select(*columns)
    kept = store.at(f"recent/batch={batch_id}")
    state = since(events, keep_from).repartition(*ENDPOINT_KEY, minute_index("time"))
    state.write.mode("overwrite").parquet(kept)
    for b in sorted({*known, batch_id})[:-2]:
        remove(spark, store.at(f"recent/batch={b}"))
    if needed >= keep_from and batch_id in state_folders(spark, store):  # a batch run again may be older than the kept ones
        events = spark.read.schema(state.schema).parquet(kept)
    return since(events, needed)


def touched_ticks(spark: SparkSession, fresh: DataFrame, store: Store, batch_id: int) -> DataFrame | None:
    """Ticks that a batch of stored events creates or changes, computed by the batch operator.

    Reads the recent events of the touched endpoints only. Events that were late when they arrived stay out, whichever
    batch brought them.
    """
    touched = fresh.groupBy(*ENDPOINT_KEY).agg(F.min(minute_index("time")).alias("since"))
    recent = recent_events(spark, fresh, store, batch_id)
    if recent is None:
        return None
    recent = recent.join(touched.select(*ENDPOINT_KEY), list(ENDPOINT_KEY), "left_semi")
    changed = base_features(recent).join(touched, list(ENDPOINT_KEY)).filter(F.col("minute") >= F.col("since"))
    return changed.select(*ENDPOINT_KEY, "minute", "now_us", "events", *BASE)


def store_events(events: DataFrame, store: Store, batch_id: int, late_after: dt.timedelta | None = timing.LATE_AFTER) -> dict:
    """Appends telemetry, then writes the ticks of the events that are not late. Returns counters.

    ``is_late`` is settled on arrival and stored with the row, so a later batch cannot count a late event.
    """
    spark = events.sparkSession
    seen = Observation(f"stored-{batch_id}")
    late = F.lit(False) if late_after is None else timing.is_late(F.current_timestamp(), late_after)
    judged = events.withColumn("is_late", late)
    counted = with_date(judged.observe(seen, F.count(F.lit(1)).alias("stored"), F.count_if("is_late").alias("late")))
    hourly = counted.withColumn("hour", F.date_format("time", "HH"))
    # a write in folders sorts what a task holds, so tasks are cut to a size that does not follow the files that came
    sized = hourly.hint("rebalance", *ENDPOINT_KEY, "time")
    write_batch(sized, store.at("telemetry"), batch_id, "date", "hour")
    counters = dict(seen.get)
    if not counters["stored"]:
        return counters
    own = read_folders(spark, store.at("telemetry"), [store.at(f"telemetry/date=*/hour=*/batch={batch_id}")])
    ticks = touched_ticks(spark, own.filter(~F.col("is_late")), store, batch_id)
    if ticks is not None:
        write_batch(ticks, store.at("ticks"), batch_id)
    return counters


def forget_batch(spark: SparkSession, store: Store, batch_id: int) -> None:
    """Removes what a batch that is set aside had already stored, so that its replay does not double it."""
    for table in ("telemetry/date=*/hour=*", "ticks", "dlq", "recent"):
        for folder in matching(spark, store.at(f"{table}/batch={batch_id}")):
            remove(spark, folder)


def delete_api(spark: SparkSession, store: Store, org_id: str, api_id: str) -> dict[str, int]:
    """Deletes an api's telemetry and predictions, also from the state that later ticks read. Returns both counts.

    Run it between batches: it rewrites the partitions that hold the api. Predictions are counted as read, one a minute.
    """
    path = store.at("predictions")
    gone = (F.col("org_id") == org_id) & (F.col("api_id") == api_id)
    predicted = read_predictions(spark, path, org_id).filter(gone).count() if holds_data(spark, path) else 0
    for folder in state_folders(spark, store).values():
        rest = materialize(retention.without_api(spark.read.parquet(folder), org_id, api_id), "state")
        rest.write.mode("overwrite").parquet(folder)
    if predicted:
        retention.delete_api(spark, path, org_id, api_id)
    root = store.at("telemetry")
    return {"telemetry": retention.delete_api(spark, root, org_id, api_id) if holds_data(spark, root) else 0, "predictions": predicted}


def attempt(work: Callable[[], object], attempts: int = ATTEMPTS) -> None:
    """Runs ``work``, again after growing waits when it fails; the last failure is raised."""
    wait = FIRST_WAIT_S
    for n in range(1, attempts + 1):
        try:
            work()
            return
        except Exception:
            if n == attempts:
                raise
            time.sleep(wait)
            wait = min(wait * 2, MAX_WAIT_S)


def publish(events: DataFrame, store: Store, path: str, batch_id: int, **packing) -> dict:
    """Packs a batch of events into messages, written as files below ``path``, and counts both. A replay replaces itself."""
    came, went = Observation(f"received-{batch_id}"), Observation(f"published-{batch_id}")
    counted = events.observe(came, F.count(F.lit(1)).alias("received"))
    packed = envelope.publish_batches(counted, **packing).observe(went, F.count(F.lit(1)).alias("published"))
    write_batch(packed, path, batch_id)
    return write_counters(events.sparkSession, store, "publish", batch_id, came.get | went.get)


def write_counters(spark: SparkSession, store: Store, job: str, batch_id: int, counted: dict) -> dict:
    """One row of counters a batch; those not counted are 0, and a batch that runs again replaces its row."""
    row = spark.range(1).select(*[F.lit(int(counted.get(c) or 0)).cast("bigint").alias(c) for c in COUNTERS[job]])
    write_batch(row, store.at(f"metrics/{job}"), batch_id)
    return counted


def read_counters(spark: SparkSession, store: Store) -> DataFrame:
    """(job, counter, value): totals over all batches of all runs on this store."""
    out = spark.createDataFrame([], "job string, counter string, value bigint")
    for job, names in COUNTERS.items():
        if holds_data(spark, store.at(f"metrics/{job}")):
            schema = ", ".join(f"{c} bigint" for c in names)
            rows = spark.read.schema(schema).parquet(store.at(f"metrics/{job}"))
            sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
            out = out.unionAll(sums.unpivot([], names, "counter", "value").select(F.lit(job), "counter", "value"))
    return out


def start_ingest(
    messages: DataFrame,
    store: Store,
    checkpoint: str,
    late_after: dt.timedelta | None = timing.LATE_AFTER,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Message stream to telemetry, ticks, dead letters and counters."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def work() -> None:
            came = Observation(f"came-{batch_id}")
            counted = batch.observe(came, F.count(F.lit(1)).alias("received"))
            # decoded once, read by the valid and the invalid branch
            checked = materialize(envelope.checked_messages(counted), "decoded", decoded)
            ok, bad = envelope.split_messages(checked)
            ok, bad = ok.withColumn("seq", envelope.arrival(batch_id)), bad.withColumn("arrival", envelope.arrival(batch_id))
            seen = Observation(f"invalid-{batch_id}")
            corrupt = F.count_if(F.col("original_payload").isNull())
            dead = deadletters.dlq_invalid(bad).observe(seen, F.count(F.lit(1)).alias("invalid"), corrupt.alias("corrupt"))
            write_batch(dead, store.at("dlq"), batch_id)
            counters = store_events(validation.to_telemetry(ok), store, batch_id, late_after) | seen.get | came.get
            counters |= {"decoded": counters["stored"] + counters["invalid"] - counters["corrupt"]}
            write_counters(spark, store, "ingest", batch_id, counters)

        decoded = store.at(f"decoded/batch={batch_id}")
        try:
            attempt(work)
        except Exception as exc:
            # the batch is set aside whole, as raw messages, and the stream goes on
            forget_batch(spark, store, batch_id)
            write_batch(deadletters.dlq_processing(batch, str(exc)), store.at("dlq_processing"), batch_id)
            came = batch.count()
            write_counters(batch.sparkSession, store, "ingest", batch_id, {"received": came, "failed": came})
        finally:
            remove(spark, decoded)

    writer = messages.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def read_ticks(spark: SparkSession, store: Store, max_files: int = 1000) -> DataFrame:
    """The tick log as a stream; ``batch`` comes from its folders."""
    schema = f"{TICK_SCHEMA}, batch bigint"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(store.at("ticks"))


def start_scoring(
    ticks: DataFrame,
    store: Store,
    checkpoint: str,
    scorer: Callable[[DataFrame], DataFrame],
    threshold: float = 0.8,
    model_hash: str = "",
    trigger: dict | None = None,
    time_type: str = "timestamp",
) -> StreamingQuery:
    """Tick stream to features, predictions and alerts. ``scorer`` adds ``risk_score`` (and ``top_features``)."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.withColumnRenamed("batch", "version"), store.at("features"), batch_id)
        stored = read_folders(batch.sparkSession, store.at("features"), [store.at(f"features/batch={batch_id}")])
        rows = stored.withColumn("time", from_micros("now_us", time_type)).withColumn("seq", F.col("version"))
        scored = label_risk(scorer(rows))
        new = materialize(prediction_rows(scored, model_hash), "scored", store.at(f"scored/batch={batch_id}"))
        upsert_predictions(new, store.at("predictions"), version=batch_id)
        seen = Observation(f"alerts-{batch_id}")
        sent = alert_messages(alerts(new, threshold)).observe(seen, F.count(F.lit(1)).alias("published"))
        write_batch(sent, store.at("alerts"), batch_id)
        write_batch(run_metrics(new, threshold), store.at("metrics/scoring"), batch_id)
        write_counters(batch.sparkSession, store, "alert", batch_id, {"received": stored.count(), "stored": new.count()} | seen.get)
        remove(batch.sparkSession, store.at(f"scored/batch={batch_id}"))

    features = with_stream_history(ticks)
    writer = features.writeStream.outputMode("update").foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return start_stateful(ticks.sparkSession, writer.trigger(**(trigger or {"processingTime": "2 seconds"})))


def start_live(
    events: DataFrame,
    store: Store,
    checkpoint: str,
    retention_minutes: int = DEFAULT_RETENTION,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Telemetry stream (with ``seq``) to live endpoint states; each batch holds the endpoints it touched."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, store.at("live"), batch_id)

    writer = stream_live(events, retention_minutes).writeStream.outputMode("update").foreachBatch(on_batch)
    writer = writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"}))
    return start_stateful(events.sparkSession, writer)


def alert_messages(rows: DataFrame) -> DataFrame:
    """Alerts as sink rows: topic, schema header and JSON value."""
    return rows.select(
        F.lit(ALERT_TOPIC).alias("topic"), F.lit(ALERT_SCHEMA).alias("schema"), F.to_json(F.struct(*rows.columns)).alias("value")
    )


def parse_alerts(messages: DataFrame) -> DataFrame:
    """Alert messages back to rows; malformed ones are skipped."""
    parsed = messages.select(F.from_json(F.col("value").cast("string"), ALERT).alias("a"))
    return parsed.filter(F.col("a.org_id").isNotNull()).select("a.*")


def read_alerts(spark: SparkSession, store: Store) -> DataFrame:
    """The alert messages as a stream of rows."""
    schema = "topic string, schema string, value string, batch bigint"
    return parse_alerts(spark.readStream.schema(schema).parquet(store.at("alerts")))
