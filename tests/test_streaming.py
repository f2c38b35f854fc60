import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from telemetra.operators import retention
from telemetra.operators.live import live_state
from telemetra.operators.serving_features import base_features, serving_features
from telemetra.plans.queries import fixture_risk
from telemetra.schemas import ENDPOINT_KEY, FEATURES
from telemetra.sources import carrier, envelope, tables
from telemetra.streaming import run
from telemetra.streaming.state import BASE

ONCE = {"availableNow": True}


def messages(spark, sf):
    raw = carrier.raw_events(spark, sf).drop("batch_id", "pos")
    return envelope.publish_batches(raw, "seq", 250)


def ingest(spark, source, store):
    stream = envelope.read_envelopes(spark, source, streaming=True, max_files=1)
    run.start_ingest(stream, store, store.at("cp/ingest"), late_after=None, trigger=ONCE).awaitTermination()


def score(spark, store):
    ticks = run.read_ticks(spark, store)
    run.start_scoring(ticks, store, store.at("cp/score"), fixture_risk, threshold=0.55, trigger=ONCE).awaitTermination()


@pytest.fixture(scope="module")
def streamed(spark, sf, tmp_path_factory):
    """Two runs over one checkpoint: the second starts where the first stopped."""
    root = tmp_path_factory.mktemp("stream")
    source, store = str(root / "in"), run.Store(str(root / "store"))
    m = messages(spark, sf).cache()
    for half in (F.col("offset") < 2, F.col("offset") >= 2):
        m.filter(half).coalesce(1).write.mode("append").parquet(source)
        ingest(spark, source, store)
        score(spark, store)
    return m, store


def test_stream_equals_batch(spark, sf, streamed):
    m, store = streamed
    ok, bad = envelope.decode_messages(m)
    events = spark.read.parquet(store.at("telemetry"))
    assert events.count() == ok.count()
    assert spark.read.parquet(store.at("dlq")).count() == bad.count()
    want = {tuple(r[k] for k in (*ENDPOINT_KEY, "time")): r for r in serving_features(events.drop("batch", "date", "hour")).collect()}
    rows = spark.read.parquet(store.at("features")).withColumn("time", F.timestamp_micros("now_us")).collect()
    newest = {}
    for r in sorted(rows, key=lambda r: (r["version"], r["batch"])):
        newest[tuple(r[k] for k in (*ENDPOINT_KEY, "minute"))] = r
    assert len(newest) == len(want)
    for r in newest.values():
        w = want[tuple(r[k] for k in (*ENDPOINT_KEY, "time"))]
        assert r["is_warmed_up"] == w["is_warmed_up"]
        for name in FEATURES:
            assert r[name] == pytest.approx(w[name], abs=1e-9), name


def test_predictions_are_one_per_minute(spark, streamed):
    _, store = streamed
    p = tables.read_predictions(spark, store.at("predictions"))
    assert p.count() == p.select(*ENDPOINT_KEY, "time").distinct().count() > 0
    assert p.filter("second(time) <> 0").count() == 0


def test_alerts_round_trip_and_counters(spark, streamed):
    _, store = streamed
    stored = spark.read.parquet(store.at("alerts"))
    broken = stored.limit(1).withColumn("value", F.lit("{oops"))
    rows = run.parse_alerts(stored.unionByName(broken)).collect()
    assert len(rows) == stored.count() > 0 and all(r["risk_score"] >= 0.55 for r in rows)
    assert json.loads(stored.first()["value"])["severity"] == "high"
    counters = spark.read.parquet(store.at("metrics/ingest")).agg(F.sum("stored"), F.sum("invalid")).first()
    assert counters[0] == spark.read.parquet(store.at("telemetry")).count()
    assert counters[1] == spark.read.parquet(store.at("dlq")).count()


def test_counters_survive_restarts_and_failures(spark, streamed, tmp_path, monkeypatch):
    m, store = streamed
    ok, bad = envelope.decode_messages(m)
    got = {(r["job"], r["counter"]): r["value"] for r in run.read_counters(spark, store).collect()}
    assert got["ingest", "received"] == m.count() and got["ingest", "stored"] == ok.count() and got["ingest", "invalid"] == bad.count()
    assert got["alert", "published"] == spark.read.parquet(store.at("alerts")).count() > 0
    assert got["alert", "received"] == spark.read.parquet(store.at("features")).count() and got["ingest", "failed"] == 0
    other = run.Store(str(tmp_path / "other"))
    monkeypatch.setattr(run, "store_events", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("store is down")))
    m.write.parquet(str(tmp_path / "in"))
    run.start_ingest(envelope.read_envelopes(spark, str(tmp_path / "in"), streaming=True), other, other.at("cp"), trigger=ONCE).awaitTermination()
    lost = {r["counter"]: r["value"] for r in run.read_counters(spark, other).collect()}
    assert lost["received"] == lost["failed"] == m.count() and lost["stored"] == 0
    assert run.read_counters(spark, run.Store(str(tmp_path / "none"))).isEmpty()


def test_a_repeated_batch_changes_nothing(spark, streamed):
    _, store = streamed
    telemetry = spark.read.parquet(store.at("telemetry"))
    before = (telemetry.count(), spark.read.parquet(store.at("ticks")).count())
    rows = [r.asDict() for r in telemetry.filter("batch = 1").drop("batch", "date", "hour").collect()]
    schema = telemetry.drop("batch", "date", "hour").schema
    run.store_events(spark.createDataFrame(rows, schema), store, 1, late_after=None)
    assert (spark.read.parquet(store.at("telemetry")).count(), spark.read.parquet(store.at("ticks")).count()) == before


def test_failing_batches_are_set_aside_whole(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(run, "store_events", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("store is down")))
    source, store = str(tmp_path / "in"), run.Store(str(tmp_path / "store"))
    m = messages(spark, sf)
    m.write.parquet(source)
    stream = envelope.read_envelopes(spark, source, streaming=True)
    run.start_ingest(stream, store, store.at("cp"), trigger=ONCE).awaitTermination()
    rows = spark.read.parquet(store.at("dlq_processing")).collect()
    assert len(rows) == m.count() and all("store is down" in r["failure_reason"] for r in rows)


def test_late_events_are_stored_without_ticks(spark, sf, tmp_path):
    store = run.Store(str(tmp_path / "store"))
    t = carrier.telemetry(spark, sf).drop("props").withColumn("time", F.col("time").cast("timestamp"))
    counters = run.store_events(t, store, 0)  # the test data is years old
    assert counters["late"] == counters["stored"] == t.count()
    assert not (tmp_path / "store" / "ticks").exists()


def test_late_events_stay_out_of_later_ticks(spark, sf, tmp_path):
    """A batch after late ones gives the ticks of a store that never saw them."""
    now = dt.datetime.now(dt.timezone.utc)
    one = carrier.telemetry(spark, sf).drop("props").orderBy("seq").limit(1)

    def event(minutes, status, seq):
        row = one.withColumn("time", F.lit(now - dt.timedelta(minutes=minutes)).cast("timestamp"))
        return row.withColumn("status", F.lit(status).cast("int")).withColumn("seq", F.lit(seq).cast("bigint"))

    both, alone = run.Store(str(tmp_path / "both")), run.Store(str(tmp_path / "alone"))
    assert run.store_events(event(31, 500, 1).unionByName(event(31, 500, 2)), both, 0)["late"] == 2
    for store in (both, alone):
        assert run.store_events(event(29, 200, 3), store, 1)["late"] == 0
    ticks = [spark.read.parquet(s.at("ticks")).collect() for s in (both, alone)]
    assert ticks[0] and ticks[0] == ticks[1]


def test_stream_goes_on_after_an_api_is_deleted(spark, sf, tmp_path):
    store = run.Store(str(tmp_path / "store"))
    t = carrier.telemetry(spark, sf).drop("props").withColumn("time", F.col("time").cast("timestamp"))
    run.store_events(t, store, 0, late_after=None)
    root = store.at("telemetry")
    first = t.select("org_id", "api_id").first()
    hit = t.filter((F.col("org_id") == first[0]) & (F.col("api_id") == first[1])).count()
    hours = run.hours_since(spark, root, dt.datetime(2000, 1, 1))
    assert retention.delete_api(spark, root, *first) == hit
    assert set(run.hours_since(spark, root, dt.datetime(2000, 1, 1))) <= set(hours)
    run.store_events(t.filter("seq < 50"), store, 1, late_after=None)
    left = spark.read.parquet(root)
    assert left.count() == t.count() - hit + t.filter("seq < 50").count()
    assert retention.partition_columns(spark, root) == ["date", "hour", "batch"]


def test_a_batch_set_aside_leaves_nothing_stored(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(run, "touched_ticks", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("no ticks")))
    source, store = str(tmp_path / "in"), run.Store(str(tmp_path / "store"))
    m = messages(spark, sf)
    m.write.parquet(source)
    stream = envelope.read_envelopes(spark, source, streaming=True)
    run.start_ingest(stream, store, store.at("cp"), late_after=None, trigger=ONCE).awaitTermination()
    assert spark.read.parquet(store.at("dlq_processing")).count() == m.count()
    assert not list((tmp_path / "store").rglob("telemetry/**/*.parquet")) and not list((tmp_path / "store").rglob("dlq/**/*.parquet"))


def test_what_a_batch_opens_does_not_grow(spark, sf, tmp_path):
    """Ten minutes a batch, one event far behind: ticks equal the batch operator's, states stay two and of one size."""
    store = run.Store(str(tmp_path / "store"))
    t = carrier.telemetry(spark, sf).drop("props").withColumn("time", F.col("time").cast("timestamp")).orderBy("seq").limit(400).cache()
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    shift = F.expr("make_dt_interval(0, 0, seq % 10, seq % 60)")
    files, sent = [], []
    for batch in range(8):
        own = t.filter(F.col("seq") % 8 == batch).withColumn("time", (F.lit(start + dt.timedelta(minutes=10 * batch)) + shift).cast("timestamp"))
        if batch == 6:  # older than the state reaches
            own = own.withColumn("time", F.when(F.col("seq") < 50, F.lit(start).cast("timestamp")).otherwise(F.col("time")))
        rows = spark.createDataFrame(own.collect(), own.schema)
        sent.append(rows)
        run.store_events(rows, store, batch, late_after=None)
        states = run.state_folders(spark, store)
        assert len(states) <= 2 and max(states) == batch
        files.append(len(spark.read.parquet(states[batch]).inputFiles()))
        if batch in (5, 7):
            span = spark.read.parquet(states[batch]).agg(F.min("time"), F.max("time")).first()
            assert span[1] - span[0] <= run.STATE_SPAN + dt.timedelta(minutes=1)
    assert max(files[5:]) <= max(files[:6]) + 1
    whole = sent[0]
    for rows in sent[1:]:
        whole = whole.unionByName(rows)
    want = {(r["endpoint"], r["method"], r["org_id"], r["api_id"], r["minute"]): r for r in base_features(whole).collect()}
    newest = {}
    for r in sorted(spark.read.parquet(store.at("ticks")).collect(), key=lambda r: r["batch"]):
        newest[r["endpoint"], r["method"], r["org_id"], r["api_id"], r["minute"]] = r
    assert set(newest) == set(want)
    for k, r in newest.items():
        assert all(r[c] == pytest.approx(want[k][c], abs=1e-9) for c in ("events", *BASE)), k


def test_a_deleted_api_is_in_no_later_tick(spark, sf, tmp_path):
    store = run.Store(str(tmp_path / "store"))
    t = carrier.telemetry(spark, sf).drop("props").withColumn("time", F.col("time").cast("timestamp"))
    run.store_events(t, store, 0, late_after=None)
    first = t.select("org_id", "api_id").first()
    hit = t.filter((F.col("org_id") == first[0]) & (F.col("api_id") == first[1])).count()
    assert run.delete_api(spark, store, *first) == {"telemetry": hit, "predictions": 0}
    last = t.filter((F.col("org_id") == first[0]) & (F.col("api_id") == first[1])).orderBy(F.desc("time")).limit(1)
    again = spark.createDataFrame(last.collect(), last.schema)
    run.store_events(again, store, 1, late_after=None)
    assert [r["events"] for r in spark.read.parquet(store.at("ticks/batch=1")).collect()] == [1]


def test_two_partitions_have_one_order(spark, sf, tmp_path):
    """Equal times in two partitions: ties, "last" and dead letters follow (batch, partition, offset, pos)."""
    source, store = str(tmp_path / "in"), run.Store(str(tmp_path / "store"))
    raw = carrier.raw_events(spark, sf).drop("batch_id", "pos").withColumn("timestamp", F.concat(F.substring("timestamp", 1, 16), F.lit(":07.000000Z")))
    m = envelope.publish_batches(raw, "seq", 100, partitions=2).cache()
    assert {(r["partition"], r["offset"]) for r in m.collect()} == {(n % 2, n // 2) for n in range(m.count())}
    for half in (F.col("offset") < 2, F.col("offset") >= 2):
        m.filter(half).coalesce(1).write.mode("append").parquet(source)
        ingest(spark, source, store)
    stored = spark.read.parquet(store.at("telemetry"))
    assert stored.select("seq").distinct().count() == stored.count() > 0
    assert {r["partition"] for r in stored.select("seq.partition").distinct().collect()} == {0, 1}
    dead = spark.read.parquet(store.at("dlq"))
    assert dead.select("arrival").distinct().count() == dead.count() > 0
    both = stored.groupBy(*ENDPOINT_KEY, "time").agg(F.countDistinct("seq.partition").alias("n")).filter("n = 2").count()
    assert both > 0  # equal times do meet
    rows = [r.asDict() for r in stored.select(*ENDPOINT_KEY, "seq", "status", "latency_ms").collect()]
    want = {}
    for r in sorted(rows, key=lambda r: tuple(r["seq"])):
        want[tuple(r[k].strip() for k in ENDPOINT_KEY)] = (r["latency_ms"], r["status"])
    live = {tuple(r[k] for k in ENDPOINT_KEY): (r["last_latency"], r["last_status"]) for r in live_state(stored).collect()}
    assert live == want
    table = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 2).parquet(store.at("telemetry"))
    run.start_live(table, store, store.at("cp/live"), trigger=ONCE).awaitTermination()
    seen = spark.read.parquet(store.at("live"))
    last = seen.groupBy(*ENDPOINT_KEY).agg(F.max_by(F.struct("last_latency", "last_status"), "requests").alias("s")).collect()
    assert {tuple(r[k] for k in ENDPOINT_KEY): tuple(r["s"]) for r in last} == want
    # the stream's ticks follow the same order as the batch operator over the stored events
    ticks = {}
    for r in sorted(spark.read.parquet(store.at("ticks")).collect(), key=lambda r: r["batch"]):
        ticks[tuple(r[k] for k in (*ENDPOINT_KEY, "minute"))] = r
    for r in base_features(stored.drop("batch")).collect():
        own = ticks.pop(tuple(r[k] for k in (*ENDPOINT_KEY, "minute")))
        assert all(own[c] == pytest.approx(r[c], abs=1e-9) for c in BASE)
    assert not ticks


def test_a_batch_is_decoded_once(spark, sf, tmp_path, monkeypatch):
    log, whole = str(tmp_path / "log"), envelope._decompress

    def logged(value, coding):
        with open(log, "a") as f:
            f.write("x\n")
        return whole(value, coding)

    monkeypatch.setattr(envelope, "_decompress", logged)
    source, store = str(tmp_path / "in"), run.Store(str(tmp_path / "store"))
    m = messages(spark, sf)
    m.write.parquet(source)
    ingest(spark, source, store)
    with open(log) as f:
        assert len(f.readlines()) == m.count()
    assert not any((tmp_path / "store" / "decoded").glob("*"))


def test_stored_events_are_cut_to_size(spark, sf, tmp_path):
    """However few tasks bring the events of a batch, more write them (and sort them by folder)."""
    store, name = run.Store(str(tmp_path / "store")), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        run.store_events(carrier.telemetry(spark, sf).drop("props").coalesce(1), store, 0, late_after=None)
    finally:
        spark.conf.set(name, "true")
    assert len(list((tmp_path / "store" / "telemetry").glob("date=*/hour=00/batch=0/*.parquet"))) > 1
