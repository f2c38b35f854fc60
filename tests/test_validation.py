import pytest
from pyspark.sql import functions as F

from telemetra.operators import validation as v
from telemetra.schemas import RAW_EVENT

UUID = "00000000-0000-4000-8000-000000000001"
GOOD = {
    "timestamp": "2024-01-01T10:00:00Z",
    "org_id": UUID,
    "api_id": UUID,
    "endpoint_id": None,
    "endpoint": "/v1/x",
    "method": "GET",
    "status": 200,
    "latency_ms": 5,
    "request_size_bytes": None,
    "response_size_bytes": 0,
    "schema_hash": None,
    "schema_version": None,
    "client_region": None,
}
CASES = [
    ({}, None),
    ({"timestamp": "2024-01-01T10:00:00.123456+05:30"}, None),
    ({"timestamp": None}, "timestamp is required"),
    ({"timestamp": "2024-01-01 10:00"}, "timestamp must be RFC3339"),
    ({"timestamp": "2024-13-01T10:00:00Z"}, "timestamp must be RFC3339"),
    ({"org_id": "abc"}, "org_id must be a valid uuid"),
    ({"org_id": " "}, "org_id is required"),
    ({"api_id": ""}, "api_id is required"),
    ({"endpoint_id": "x"}, "endpoint_id must be a valid uuid"),
    ({"endpoint": " "}, "endpoint is required"),
    ({"endpoint": "e" * 255}, None),
    ({"endpoint": "e" * 256}, "endpoint length must be < 256"),
    ({"endpoint": "é" * 200}, "endpoint length must be < 256"),
    ({"method": ""}, "method is required"),
    ({"method": "get"}, "method must be uppercase"),
    ({"status": 99}, "status must be a valid HTTP status"),
    ({"status": 600}, "status must be a valid HTTP status"),
    ({"latency_ms": -1}, "latency_ms must be >= 0"),
    ({"request_size_bytes": -1}, "request_size_bytes must be >= 0"),
    ({"response_size_bytes": -1}, "response_size_bytes must be >= 0"),
    ({"status": 99, "api_id": "x"}, "api_id must be a valid uuid"),
]


def frame(spark, rows):
    names = [c.split()[0] for c in RAW_EVENT.split(", ")]
    return spark.createDataFrame([tuple({**GOOD, **r}[n] for n in names) for r in rows], RAW_EVENT)


def test_strict_first_rule_wins(spark):
    df = frame(spark, [c for c, _ in CASES]).coalesce(1).withColumn("i", F.monotonically_increasing_id())
    got = [r["reason"] for r in v.validate_strict(df).orderBy("i").collect()]
    assert got == [reason for _, reason in CASES]


def test_lenient_repairs(spark):
    df = frame(spark, [{"org_id": f" {UUID} ", "method": " get ", "endpoint": " /a "}])
    df = df.withColumn("request_size", F.lit(7)).withColumn("response_size", F.lit(8))
    row = v.validate_lenient(df).first()
    assert (row["reason"], row["org_id"], row["method"], row["endpoint"]) == (None, UUID, "GET", "/a")
    assert row["request_size_bytes"] == 7 and row["response_size_bytes"] == 0


def test_array_requests(spark):
    one = f"named_struct({', '.join(repr(k) + ', ' + lit(x) for k, x in GOOD.items())})"
    df = spark.sql(
        f"SELECT 1 AS batch_id, array({one}, {one}) AS events "
        f"UNION ALL SELECT 2, array() UNION ALL SELECT 3, array_repeat({one}, 4)"
    )
    ok, bad = v.reject_array_batches(df, max_events=3)
    assert ok.count() == 2
    assert {r["batch_id"]: r["reason"] for r in bad.collect()} == {
        2: "at least one event is required",
        3: "too many events",
    }


def lit(x):
    if x is None:
        return "cast(null as string)"
    return repr(x) if isinstance(x, str) else str(x)


def test_reasons_name_the_event(spark):
    rows = frame(spark, [{}, {"status": 1}, {"method": "x"}]).coalesce(1)
    rows = rows.withColumn("batch_id", F.lit(9)).withColumn("pos", F.monotonically_increasing_id().cast("int"))
    verdict = v.batch_verdicts(rows).first()
    assert verdict["reason"] == "event[1]: status must be a valid HTTP status" and verdict["single_org"]
    ok, bad = v.reject_batches(rows)
    assert ok.count() == 0 and bad.count() == 1


@pytest.mark.parametrize("strict", [True, False])
def test_split(spark, strict):
    check = v.validate_strict if strict else v.validate_lenient
    ok, bad = v.split_valid(check(frame(spark, [{}, {"status": 1}])))
    assert ok.count() == 1 and bad.count() == 1
