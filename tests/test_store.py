import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from telemetra.operators import predictions, retention
from telemetra.schemas import ENDPOINT_KEY
from telemetra.sources import carrier, tables


def prediction(spark, rows):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, d, 10, m, s), "o", "a", "/x", "GET", risk, seq) for d, m, s, risk, seq in rows],
        "time timestamp, org_id string, api_id string, endpoint string, method string, risk_score double, seq bigint",
    )
    scored = predictions.label_risk(df).withColumn("is_warmed_up", F.lit(True))
    return predictions.prediction_rows(scored)


def stored(spark, path):
    rows = tables.read_predictions(spark, path).orderBy("time").collect()
    return [(r["time"].day, r["time"].minute, r["time"].second, r["risk_score"], r["prediction"]) for r in rows]


def test_upsert_keeps_highest_risk_and_last_rest(spark, tmp_path):
    path = str(tmp_path / "p")
    tables.upsert_predictions(prediction(spark, [(1, 0, 5, 0.9, 1), (1, 1, 5, 0.2, 1), (2, 0, 0, 0.5, 1)]), path)
    batch = [(1, 0, 59, 0.1, 1), (1, 1, 0, 0.6, 1), (1, 1, 1, 0.3, 2), (1, 2, 0, 0.75, 1)]
    assert tables.upsert_predictions(prediction(spark, batch), path) == 1
    want = [
        (1, 0, 0, 0.9, "normal"),
        (1, 1, 0, 0.6, "normal"),
        (1, 2, 0, 0.75, "high_failure_risk"),
        (2, 0, 0, 0.5, "degraded"),
    ]
    assert stored(spark, path) == want
    tables.upsert_predictions(prediction(spark, batch), path)
    assert stored(spark, path) == want


def test_writes_add_and_compaction_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "p")
    batches = [[(1, 0, 5, 0.9, 1), (1, 1, 5, 0.2, 1), (2, 0, 0, 0.5, 1)], [(1, 0, 59, 0.1, 1), (1, 1, 0, 0.6, 1)], [(1, 1, 3, 0.4, 1), (3, 0, 0, 0.7, 1)]]
    for n, batch in enumerate(batches):
        tables.upsert_predictions(prediction(spark, batch), path, version=n)
    day = dt.date(2024, 1, 1)
    assert tables.versions(spark, path, day) == [0, 2, 4]  # each write left the others alone
    want = stored(spark, path)
    assert want == [(1, 0, 0, 0.9, "normal"), (1, 1, 0, 0.6, "degraded"), (2, 0, 0, 0.5, "degraded"), (3, 0, 0, 0.7, "high_failure_risk")]
    written = {f: f.stat().st_mtime_ns for f in (tmp_path / "p").rglob("version=0/*.parquet")}
    tables.upsert_predictions(prediction(spark, batches[2]), path, version=2)  # a replay
    assert stored(spark, path) == want and all(f.stat().st_mtime_ns == t for f, t in written.items())
    assert tables.compact_predictions(spark, path, upto=1) == [day]
    assert tables.versions(spark, path, day) == [3, 4] and stored(spark, path) == want
    tables.upsert_predictions(prediction(spark, batches[0]), path, version=0)  # an old batch runs again after compaction
    assert stored(spark, path) == want
    for _ in range(2):
        tables.compact_predictions(spark, path)
        assert tables.versions(spark, path, day) == [5] and stored(spark, path) == want
    assert [r["time"].day for r in tables.read_predictions(spark, path, "o", since=dt.date(2024, 1, 2), until=dt.date(2024, 1, 2)).collect()] == [2]
    plan = tables.read_predictions(spark, path, "o", since=dt.date(2024, 1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "date#" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(org_id,o)" in plan


def test_compaction_stopped_half_way(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    for n, batch in enumerate([[(1, 0, 5, 0.9, 1)], [(1, 0, 6, 0.3, 1), (1, 1, 0, 0.6, 1)]]):
        tables.upsert_predictions(prediction(spark, batch), path, version=n)
    want = stored(spark, path)
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(tables, "remove", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        tables.compact_predictions(spark, path)
    assert stored(spark, path) == want and len(tables.versions(spark, path, dt.date(2024, 1, 1))) == 3
    tables.compact_predictions(spark, path)
    assert stored(spark, path) == want and tables.versions(spark, path, dt.date(2024, 1, 1)) == [3]


def test_upsert_refuses_a_broken_table(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(3).write.parquet(path)
    with pytest.raises(AnalysisException):
        tables.upsert_predictions(prediction(spark, [(1, 0, 5, 0.9, 1)]), path)
    assert spark.read.parquet(path).count() == 3


def test_alert_boundary(spark):
    df = prediction(spark, [(1, 0, 0, 0.7999999, 1), (1, 1, 0, 0.8, 1)])
    rows = predictions.alerts(df).collect()
    assert [r["risk_score"] for r in rows] == [0.8] and rows[0]["severity"] == "high"


def test_reads_prune_dates_and_push_the_tenant(spark, tmp_path, sf):
    path = str(tmp_path / "t")
    t = carrier.telemetry(spark, sf).drop("props")
    tables.append_telemetry(t, path)
    tables.append_telemetry(t.withColumn("time", F.col("time") - F.expr("interval 10 days")), path)
    df = tables.read_telemetry(spark, path, "00000000-0000-4000-8000-000000000001", carrier.AS_OF, 24)
    plan = df.select("latency_ms")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(org_id" in plan
    assert "schema_hash" not in plan.split("ReadSchema")[1]
    assert df.count() == t.filter(F.col("org_id").endswith("1")).count()


def test_delete_api_and_retention(spark, tmp_path, sf):
    path = str(tmp_path / "t")
    t = carrier.telemetry(spark, sf).drop("props")
    only = t.withColumn("time", F.col("time") - F.expr("interval 100 days")).filter("api_id like '%1'")
    tables.append_telemetry(t.unionByName(only), path)
    org, api = "00000000-0000-4000-8000-000000000001", "00000000-0000-4000-9000-000000000001"
    hit = t.filter((F.col("org_id") == org) & (F.col("api_id") == api)).count()
    assert retention.delete_api(spark, path, org, api) == 2 * hit
    left = spark.read.parquet(path)
    assert left.count() == t.count() - hit and left.select("date").distinct().count() == 1
    assert retention.delete_api(spark, path, org, api) == 0
    assert retention.apply_retention(spark, path, dt.datetime(2024, 3, 1)) == []
    assert len(retention.apply_retention(spark, path, dt.datetime(2024, 6, 1))) == 1


def test_catalog_newest_first_and_csv(spark, tmp_path, sf):
    carrier.apis(spark, sf).write.parquet(str(tmp_path / "apis"))
    rows = tables.read_catalog(spark, str(tmp_path / "apis")).limit(5).collect()
    assert [r["created_at"] for r in rows] == sorted((r["created_at"] for r in rows), reverse=True)
    text = "timestamp,window_duration_minutes,p50_latency\n2024-01-01 00:00:00,1,3.5\n"
    (tmp_path / "m.csv").write_text(text)
    row = tables.read_minutes_csv(spark, str(tmp_path / "m.csv")).first()
    assert row["p50_latency"] == 3.5 and row["label"] is None


def test_groups_of_a_hot_endpoint_stay_small(spark):
    """The newest-three filter runs before the shuffle."""
    df = prediction(spark, [(1, m % 60, 0, 0.5, m) for m in range(60)])
    plan = predictions.prediction_groups(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert set(ENDPOINT_KEY) <= set(df.columns)
