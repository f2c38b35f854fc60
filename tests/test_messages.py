import gzip
import json

import pyarrow as pa
from pyspark.sql import functions as F

from telemetra.operators import deadletters
from telemetra.schemas import ENVELOPE
from telemetra.sources import envelope
from test_validation import GOOD

GZIP = [("content-encoding", b"gzip")]


def body(*events):
    return json.dumps(list(events)).encode()


def snappy(data):
    return pa.compress(data, codec="snappy", asbytes=True)


def test_decode_cases(spark):
    good, bad = {**GOOD, "extra": {"a": [1]}}, {**GOOD, "status": 7}
    messages = [
        (GZIP, gzip.compress(body(good, good))),
        ([], gzip.compress(body(good))),
        ([], body(good, bad)),
        ([], None),
        (GZIP, b"\x1f\x8bbroken"),
        ([], b"{not json"),
        ([], json.dumps(good).encode()),
        ([("Content-Encoding", b"SNAPPY")], b"x"),
        (None, body(good)),
        ([], body(3)),
        ([("content-encoding", b"snappy")], snappy(body(*[good] * 40))),
        ([("content-encoding", b"snappy")], b"\xff\xff\xff\xff\x0f"),  # claims four gigabytes
    ]
    rows = [("telemetry.raw", 0, i, h, v) for i, (h, v) in enumerate(messages)]
    ok, bad_rows = envelope.decode_messages(spark.createDataFrame(rows, ENVELOPE))
    counts = {r["offset"]: r["count"] for r in ok.groupBy("offset").count().collect()}
    assert counts == {0: 2, 1: 1, 2: 1, 8: 1, 10: 40}
    reasons = {(r["offset"], r["pos"]): r["reason"] for r in bad_rows.collect()}
    assert reasons[(2, 1)] == "status must be a valid HTTP status"
    assert reasons[(4, None)].startswith("Decompression failed")
    assert reasons[(5, None)] == "JSON decode failed"
    assert reasons[(6, None)].startswith("Expected JSON array")
    assert reasons[(7, None)].startswith("Decompression failed")
    assert set(reasons) == {(2, 1), (4, None), (5, None), (6, None), (7, None), (9, 0), (11, None)}


def test_packing_keeps_order_and_size(spark):
    df = spark.range(1201).select(F.col("id").alias("seq"), F.lit("/x").alias("endpoint"), F.col("id").alias("n"))
    packed = envelope.publish_batches(df, "seq").collect()
    assert sorted(r["offset"] for r in packed) == [0, 1, 2]
    for r in packed:
        numbers = [e["n"] for e in json.loads(gzip.decompress(bytes(r["value"])))]
        assert numbers == list(range(r["offset"] * 500, min(1201, r["offset"] * 500 + 500)))
        assert {h["key"]: bytes(h["value"]).decode() for h in r["headers"]} == envelope.BATCH_HEADERS


def test_dead_letter_messages(spark):
    df = spark.createDataFrame([("telemetry.raw", 3, 5, None, bytes(range(90)))], ENVELOPE)
    row = deadletters.as_messages(deadletters.dlq_processing(df, "boom")).first()
    value = json.loads(row["value"])
    assert row["topic"] == "telemetry.raw.processing-failure.dlq" and row["schema"] == "dlq.processing-failure.v1"
    assert value["source_partition"] == 3 and value["failure_reason"] == "boom"
    import base64

    assert base64.b64decode(value["payload_base64"]) == bytes(range(90))


def test_lag(spark):
    done = spark.createDataFrame([("t", 0, 4), ("t", 0, 9), ("t", 1, 20)], "topic string, partition int, offset bigint")
    ends = spark.createDataFrame([("t", 0, 12), ("t", 1, 21), ("t", 2, 5)], "topic string, partition int, high bigint")
    got = {r["partition"]: r["lag"] for r in envelope.lag_by_partition(done, ends).collect()}
    assert got == {0: 2, 1: 0, 2: 5}


def test_messages_pass_python_once_in_small_batches(spark, capsys):
    messages = spark.createDataFrame([("t", 0, n, [], body(GOOD, {**GOOD, "status": 7})) for n in range(3)], ENVELOPE)
    ok, bad = envelope.decode_messages(messages)
    for df in (ok, bad):
        df.explain()
        plan = capsys.readouterr().out
        # frames of up to 10,000 messages were decompressed at once, and again for each kind of fault
        assert "MapInPandas" not in plan and plan.count("BatchEvalPython") == 1
