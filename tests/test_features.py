import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from brute import brute_features
from telemetra.operators.serving_features import serving_features
from telemetra.operators.training_features import training_features
from telemetra.schemas import ENDPOINT_KEY

START = 1_704_067_200_000_000
SCHEMA = "seq bigint, us bigint, org_id string, api_id string, endpoint string, method string, status int, latency_ms int, schema_hash string"


def events_of(spark, streams):
    rows, seq = [], 0
    for name, events in streams.items():
        for us, status, lat, h in events:
            rows.append((seq, us, "o", "a", name, "GET", status, lat, h))
            seq += 1
    return spark.createDataFrame(rows, SCHEMA).withColumn("time", F.timestamp_micros("us"))


def minute(m, s=0.0):
    return START + int((m * 60 + s) * 1_000_000)


def streams():
    r = random.Random(7)
    out = {
        "one": [(minute(0, 1), 200, 5, None)],
        "null_breaks": [(minute(0, i), 200, 5, h) for i, h in enumerate(["A", None, "B", "", "A"])],
        "two_changes": [(minute(0, 1), 200, 5, "A"), (minute(0, 21), 200, 5, "B"), (minute(2, 1), 503, 9, "A")],
        # exactly one minute (five, fifteen) back still counts, a microsecond more does not
        "bounds": [
            (minute(0, 10), 500, 100, "A"),
            (minute(0, 10) + 1, 200, 50, "B"),
            (minute(1, 10), 200, 10, "A"),
            (minute(5, 10), 200, 10, "B"),
            (minute(5, 10) + 1, 200, 10, "B"),
            (minute(15, 10), 200, 30, "C"),
            (minute(15, 10) + 1, 500, 30, "A"),
        ],
        "warm": [(minute(i // 30, i % 30), 200, i, "h") for i in range(120)],
        "long": [(minute(2 * i, 3), 500 if i % 7 == 0 else 200, i % 50, f"h{i // 40}") for i in range(260)],
    }
    at = sorted(r.randrange(0, 40 * 60 * 1_000_000) for _ in range(700))
    out["dense"] = [
        (START + t, r.choice([200, 200, 404, 500]), r.randrange(300), r.choice(["x", "y", "z", None])) for t in at
    ]
    return out


@pytest.mark.parametrize("slot", [5, 20, 60])
def test_serving_features_equal_brute_force(spark, slot):
    data = streams()
    want = {(name, now): f for name, ev in data.items() for now, f in brute_features(ev).items()}
    rows = serving_features(events_of(spark, data), slot_seconds=slot).withColumn("now", F.unix_micros("time")).collect()
    assert len(rows) == len(want)
    for row in rows:
        for name, value in want[(row["endpoint"], row["now"])].items():
            assert row[name] == pytest.approx(value, abs=1e-9), (row["endpoint"], row["time"], name)


def test_aliases_and_types(spark):
    df = serving_features(events_of(spark, {"one": streams()["one"]}))
    row = df.first()
    assert row["latency_mean"] == row["p50_latency"] and row["latency_p95"] == row["p95_latency"]
    assert df.schema["time"].dataType.simpleString() == "timestamp"


def test_training_features_equal_pandas(spark):
    import pandas as pd

    r = random.Random(3)
    n = 400
    frame = pd.DataFrame(
        {
            "time": [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i) for i in range(n)],
            "p50_latency": [r.uniform(0, 3) for _ in range(n)],
            "p95_latency": [5.0] * 60 + [r.uniform(5, 90) for _ in range(n - 60)],
            "latency_variance": [r.uniform(0, 9) for _ in range(n)],
            "error_rate": [r.choice([0, 0, 0.1, 0.25]) for _ in range(n)],
            "traffic_rps": [r.uniform(1, 5) for _ in range(n)],
        }
    )
    past = frame.shift(1)
    want = pd.DataFrame(
        {
            "p95_latency_roll_mean_15": past.p95_latency.rolling(15, min_periods=5).mean().bfill(),
            "latency_variance_roll_std_15": past.latency_variance.rolling(15, min_periods=5).std().fillna(0),
            "error_rate_roll_mean_15": past.error_rate.rolling(15, min_periods=5).mean().bfill(),
            "error_rate_acceleration": frame.error_rate.diff().diff().shift(1).fillna(0),
            "traffic_utilization_proxy": (past.traffic_rps.rolling(10, min_periods=4).mean() / 2000).bfill(),
            "p95_to_p50_ratio": (past.p95_latency / past.p50_latency.clip(lower=1)).bfill(),
            "error_rate_ewm": past.error_rate.ewm(alpha=0.3, adjust=False).mean().bfill(),
            "p95_latency_roll_max_15": past.p95_latency.rolling(15, min_periods=5).max().bfill(),
        }
    )
    spread = past.p95_latency.rolling(30, min_periods=10)
    want["latency_p95_zscore"] = ((past.p95_latency - spread.mean()) / spread.std().clip(lower=1)).fillna(0)
    high = (past.error_rate > frame.error_rate.quantile(0.8)).astype(float)
    want["error_high_streak"] = high.rolling(10, min_periods=3).sum().fillna(0)
    df = spark.createDataFrame(frame).withColumn("k", F.lit("s"))
    got = training_features(df, ["k"]).toPandas().sort_values("time").reset_index(drop=True)
    for c in want.columns:
        assert (got[c] - want[c]).abs().max() < 1e-9, c


def test_training_features_need_a_key(spark):
    with pytest.raises(ValueError):
        training_features(spark.range(1), [])


def test_plan_shuffles_events_once(spark):
    """Events are dealt by slot, states by key; five exchanges in all, and windows over events see one slot."""
    from telemetra.operators.serving_features import slot_states

    events = events_of(spark, {"one": streams()["one"]})
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = serving_features(events)._jdf.queryExecution().executedPlan().toString()
        slots = slot_states(events, 20)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) <= 5 and plan.count("Exchange") == len(dealt)
    assert ", ".join(ENDPOINT_KEY).split(",")[0] in plan
    windows = [line for line in slots.splitlines() if "lead(" in line and "Window" in line]
    assert windows and all("slot" in line for line in windows)


def test_schema_minutes_equal_a_plain_loop(spark):
    """Ties in time, missing hashes, empty minutes and changes across slots and minutes."""
    from telemetra.operators.training_features import schema_minutes

    r = random.Random(4)
    start = dt.datetime(2024, 1, 1, 5)
    rows = [
        (k, start + dt.timedelta(seconds=r.choice([r.randrange(0, 400), 60, 119, 120])), r.choice(["a", "b", "b", "", None]), r.choice([200, 500]), n)
        for k in ("x", "y") for n in range(300)
    ]
    df = spark.createDataFrame(rows, "k string, time timestamp_ntz, schema_hash string, status int, seq long")
    want: dict = {}
    for key in ("x", "y"):
        before = None
        for _, time, own, status, _ in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1], x[4])):
            own = own or None
            cell = want.setdefault((key, time.replace(second=0)), {"ch": 0, "br": 0, "seen": []})
            changed = own is not None and before is not None and own != before
            cell["ch"] += changed
            cell["br"] += changed and status >= 500
            cell["seen"] += [own] if own else []
            before = own
    for seconds in (20, 60):
        got = schema_minutes(df, ["k"], seconds).collect()
        assert len(got) == len(want)
        for g in got:
            w = want[g["k"], g["time"]]
            shares = [w["seen"].count(x) / len(w["seen"]) for x in set(w["seen"])]
            assert (g["schema_fields_added"], g["schema_fields_removed"]) == (w["ch"], max(0, w["ch"] - 1))
            assert (g["schema_breaking_changes"], g["recent_deploy"]) == (int(w["br"] > 0), int(w["ch"] > 0))
            assert g["schema_entropy"] == pytest.approx(-sum(p * math.log2(p) for p in shares))
    assert schema_minutes(df.limit(0), ["k"]).count() == 0


def test_files_without_folders_are_series(spark, tmp_path):
    from telemetra.sources.tables import read_training_csv

    for name in ("a", "b"):
        lines = [f"2024-01-01 00:{m:02d}:00,1,{m}.5,{m}.75,{m + 1}.0,1.0,0,0.1,0,2.5,0,0,0,0,0.0,0,0,0" for m in range(8)]
        (tmp_path / f"{name}.csv").write_text("header" + "," * 17 + "\n" + "\n".join(lines) + "\n")
    frame, series = read_training_csv(spark, str(tmp_path))
    rows = training_features(frame, series).collect()
    assert series == ["series"] and sorted({r["series"] for r in rows}) == ["a.csv", "b.csv"] and len(rows) == 16
