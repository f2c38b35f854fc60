import hashlib
import json

from pyspark.sql import functions as F

from telemetra.functions.jsontools import canonical_hash, shape_hash, shape_json
from telemetra.operators import contracts, inventory, tenants

SHAPES = {
    "null": {"type": "null"},
    "true": {"type": "boolean"},
    "1": {"type": "integer"},
    "1.0": {"type": "number"},
    '"s"': {"type": "string"},
    "oops": {"type": "string"},
    "[]": {"type": "array", "items": {"type": "null"}},
    "[1, 2]": {"type": "array", "items": {"type": "integer"}},
    '[1, "a", 2]': {"type": "array", "items": {"anyOf": [{"type": "integer"}, {"type": "string"}]}},
    '{"b": {"é": null}, "a": 1}': {
        "type": "object",
        "required": ["a", "b"],
        "properties": {
            "a": {"type": "integer"},
            "b": {"type": "object", "required": ["é"], "properties": {"é": {"type": "null"}}},
        },
    },
}


def test_shapes_and_hashes(spark):
    df = spark.createDataFrame([(k,) for k in SHAPES], "t string")
    for r in df.select("t", shape_json("t").alias("s")).collect():
        assert json.loads(r["s"]) == SHAPES[r["t"]], r["t"]
    text = '{"é": 1.0, "a": [1e3, 2]}'
    want = hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert spark.createDataFrame([(text,)], "t string").select(canonical_hash("t").alias("h")).first()["h"] == want


def test_batch_of_nulls_alone(spark):
    df = spark.range(0, 5, 1, 1).selectExpr("cast(null as string) AS t")
    assert [r["h"] for r in df.select(shape_hash("t").alias("h")).collect()] == [None] * 5
    # one batch holds no contract at all: every response is missing, and no body is hashed
    seen = spark.range(0, 5, 1, 1).selectExpr("id AS seq", "'o' AS org_id", "'get' AS method", "'/a' AS url", "'{}' AS body")
    ends = spark.createDataFrame([("e", "o", "GET", "/b")], "id string, org_id string, method string, path string")
    held = spark.createDataFrame([], "org_id string, endpoint_id string, schema_hash string, created_at timestamp_ntz")
    out = contracts.contract_verdict(seen, ends, held).collect()
    assert [(r["status"], r["observed_hash"]) for r in out] == [("missing", None)] * 5


def spec(spark, doc):
    return spark.createDataFrame([("s", "o", "a", json.dumps(doc))], "id string, org_id string, api_id string, raw_spec string")


def test_spec_operations(spark):
    def answer(**codes):
        return {"responses": {c.strip("_"): {"content": m} for c, m in codes.items()}}

    number, text = {"type": "number"}, {"type": "string"}
    doc = {
        "paths": {
            "/users": {
                "get": answer(_500={"application/json": {"schema": text}}, _200={"application/json": {"schema": number}}),
                "post": answer(default={"text/plain": {"schema": text}}),
                "trace": answer(_200={"application/json": {"schema": text}}),
                "HEAD": {},
            },
            "/users/{id}": {"get": {"responses": {"200": {"content": {}}, "201": {"content": {"application/json": {"schema": number}}}}}},
            "/list": [1],
            "/none": {"put": "x", "options": {"responses": []}},
        }
    }
    ops = contracts.spec_operations(spec(spark, doc)).collect()
    got = {(r["path"], r["method"]): json.loads(r["schema"]) if r["schema"] else None for r in ops}
    assert got == {
        ("/users", "GET"): number,
        ("/users", "POST"): text,
        ("/users", "HEAD"): None,
        ("/users/{id}", "GET"): number,
        ("/none", "PUT"): None,
        ("/none", "OPTIONS"): None,
    }
    assert contracts.spec_operations(spec(spark, {"paths": 3})).count() == 0


def test_spec_is_read_once_for_all_operations(spark, capsys):
    # each level of a document used to be a parse of its own, several for every operation
    schema = {"type": "array", "items": {"enum": [1, 1.5, "é"]}}
    media = {"text/plain": 3, "application/xml": {"schema": schema}, "a/b": {"schema": {"type": "null"}}}
    doc = {"paths": {"/a": {"parameters": [], "Get": {"responses": {"200": "x", "404": {"content": media}}}}, "/b": {"put": {"responses": {"200": {"content": {"x/y": {"schema": {}}}}}}}}}
    rows = spec(spark, doc).unionByName(spark.createDataFrame([("n", "o", "a", None), ("t", "o", "a", '{"paths": {"/a"')], "id string, org_id string, api_id string, raw_spec string"))
    ops = contracts.spec_operations(rows)
    ops.explain()
    assert capsys.readouterr().out.count("from_json(") == 1
    want = hashlib.sha256(json.dumps(schema, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    got = [(r["spec_id"], r["path"], r["pos"], r["method"], r["schema_hash"]) for r in ops.collect()]
    assert sorted(got) == [("s", "/a", 1, "GET", want), ("s", "/b", 0, "PUT", None)]


def test_quota(spark):
    orgs = spark.createDataFrame([("1", "free"), ("2", "PRO"), ("3", "business"), ("4", None), ("5", "odd")], "id string, plan string")
    apis = spark.createDataFrame([(f"a{i}", o) for i, o in enumerate("12345")], "id string, org_id string")
    flags = spark.createDataFrame(
        [("pro", "api_quota", True, 1), ("free", "api_quota", False, 9), ("odd", "api_quota", True, 2)],
        "plan string, feature_key string, enabled boolean, limit int",
    )
    got = {r["org_id"]: (r["api_limit"], r["under_quota"]) for r in tenants.quota_status(orgs, apis, flags).collect()}
    assert got == {"1": (1, False), "2": (1, False), "3": (None, True), "4": (1, False), "5": (2, True)}


def test_reconcile_partitions_the_union(spark):
    base = {"org_id": "o", "api_id": "a", "base_url": "https://h", "method": "GET"}
    rows = [{**base, "path": p, "interval_seconds": s} for p, s in (("/a", 1), ("/b", 2), ("/c", 90))]
    desired = inventory.clean_targets(spark.createDataFrame(rows[:2]))
    active = inventory.clean_targets(spark.createDataFrame([{**rows[1], "interval_seconds": 3}, rows[2]]))
    got = {r["target_key"]: r["action"] for r in inventory.reconcile(desired, active).collect()}
    assert got == {"o|a|GET|/a": "added", "o|a|GET|/b": "changed", "o|a|GET|/c": "removed"}
    prints = {r["path"]: r["fingerprint"] for r in inventory.fingerprint(active).collect()}
    assert "|1m30s|5s|" in prints["/c"]


def test_reconcile_moves_no_fingerprint_texts(spark, capsys):
    rows = [{"org_id": "o", "api_id": "a", "base_url": "https://h", "path": p, "headers": {"x": "y" * n}} for p, n in (("/a", 500), ("/b", 9))]
    desired = inventory.clean_targets(spark.createDataFrame(rows))
    longer = F.when(F.col("path") == "/a", F.concat("body", F.lit("z"))).otherwise(F.col("body"))
    out = inventory.reconcile(desired, desired.withColumn("body", longer))
    out.explain()
    assert capsys.readouterr().out.count("sha2(") == 2  # both sides come to the join as marks of 16 bytes
    assert sorted(r["action"] for r in out.collect()) == ["changed", "unchanged"]


def test_static_targets_are_all_or_nothing(spark):
    good = '[{"org_id": "o", "api_id": "a", "base_url": "b", "path": "/p", "headers": {"X": "1"}}]'
    bad = '[{"org_id": "o", "api_id": "a", "base_url": "b", "path": "/p"}, {"org_id": "o"}]'
    df = spark.createDataFrame([(good,), (bad,), ("nope",), (None,)], "targets string")
    rows = inventory.static_targets(df).collect()
    assert len(rows) == 1 and rows[0]["method"] == "GET" and rows[0]["schema_version"] == "active-poll.v1"
