"""Maps the test tables onto the telemetry model, so every operator can run on them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.datetime(2024, 1, 1, 1, 12)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as telemetry: 30 days squeezed into 72 minutes, ids spread over 3 orgs and 6 apis."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    shifted = start + F.expr("(unix_micros(cast(ts as timestamp)) - unix_micros(timestamp'2024-01-01 00:00:00')) div 600")
    status = (
        F.when((F.col("event_type") == "error") & (k % 2 == 0), 503)
        .when(k % 10 == 3, 500)
        .when(k % 10 == 7, 404)
        .otherwise(200)
    )
    return e.select(
        F.col("event_id").alias("seq"),
        F.timestamp_micros(shifted).cast("timestamp_ntz").alias("time"),
        _uuid("8000", F.col("user_id") % 3).alias("org_id"),
        _uuid("9000", F.col("user_id") % 6).alias("api_id"),
        F.concat(F.lit("/v1/"), "event_type").alias("endpoint"),
        F.when(k % 4 == 0, "POST").otherwise("GET").alias("method"),
        status.alias("status"),
        F.floor("value").cast("int").alias("latency_ms"),
        (k * 10).alias("request_size"),
        (k * 100).alias("response_size"),
        F.when(k % 25 != 0, F.concat(F.lit("h"), (F.expr("event_id div 700") % 3).cast("string"))).alias("schema_hash"),
        F.lit("v1").alias("schema_version"),
        F.col("props"),
    )


def _uuid(family: str, c):
    return F.concat(F.lit(f"00000000-0000-4000-{family}-"), F.lpad(c.cast("string"), 12, "0"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry in its wire form, one request per 50 events. Every third request is clean; in the others one
    kind of fault after the other is woven in along the event number."""
    t = telemetry(spark, sf_dir)
    n = F.when(F.expr("(seq div 50) % 3 = 0"), F.lit(0).cast("bigint")).otherwise(F.col("seq") % 40)

    def broken(column, *cases):
        chain = None
        for number, value in cases:
            chain = F.when(n == number, value) if chain is None else chain.when(n == number, value)
        return chain.otherwise(column)

    stamp = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return t.select(
        "seq",
        F.expr("seq div 50").alias("batch_id"),
        (F.col("seq") % 50).cast("int").alias("pos"),
        broken(stamp, (1, F.lit("")), (2, F.lit("2024-01-01 10:00"))).alias("timestamp"),
        broken(F.col("org_id"), (3, F.lit("abc")), (15, F.lit("abc")), (17, F.concat(F.lit(" "), "org_id"))).alias("org_id"),
        broken(F.col("api_id"), (4, F.lit(""))).alias("api_id"),
        F.when(n == 5, F.lit("x")).alias("endpoint_id"),
        broken(F.col("endpoint"), (6, F.lit(" ")), (7, F.repeat(F.lit("é"), 200))).alias("endpoint"),
        broken(F.col("method"), (8, F.lit(" ")), (9, F.lit("get")), (16, F.lit(" post "))).alias("method"),
        broken(F.col("status"), (10, F.lit(99)), (11, F.lit(600)), (15, F.lit(99))).alias("status"),
        broken(F.col("latency_ms"), (12, F.lit(-1))).alias("latency_ms"),
        broken(F.col("request_size"), (13, F.lit(-1)), (18, F.lit(None))).alias("request_size_bytes"),
        broken(F.col("response_size"), (14, F.lit(-1)), (18, F.lit(None))).alias("response_size_bytes"),
        "schema_hash",
        "schema_version",
        F.lit(None).cast("string").alias("client_region"),
    )


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`customer` as organisations; the market segment stands for the plan."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    plan = (
        F.when(F.col("c_mktsegment") == "BUILDING", "free")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "Pro")
        .when(F.col("c_mktsegment") == "MACHINERY", "business")
        .when(F.col("c_mktsegment") == "FURNITURE", "trial")
    )
    return c.select(_uuid("8000", F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"), plan.alias("plan"))


def apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as apis of their customer's organisation."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    suffix = F.when(F.col("o_orderkey") % 3 == 0, ":8443").when(F.col("o_orderkey") % 3 == 1, "/").otherwise("")
    return o.select(
        _uuid("9000", F.col("o_orderkey")).alias("id"),
        _uuid("8000", F.col("o_custkey")).alias("org_id"),
        F.concat(F.lit("Api "), "o_orderpriority").alias("name"),
        F.concat(F.lit("https://Api"), (F.col("o_orderkey") % 50).cast("string"), F.lit(".example.com"), suffix).alias("base_url"),
        F.col("o_orderdate").alias("created_at"),
    )


PATHS = ["/items/{id}", "/status", "/empty", "/items/{id}/parts", "/orders/{oid}/items", "/users", "/users/{id}"]


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as endpoints of their order's api; the line number picks the path, the return flag the method."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    path = F.element_at(F.array(*[F.lit(p) for p in PATHS]), F.col("l_linenumber"))
    q = F.col("l_quantity").cast("int")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        F.format_string("%d-%d-%d-%d-%d", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents).alias("id"),
        _uuid("9000", F.col("l_orderkey")).alias("api_id"),
        _uuid("8000", F.col("o_custkey")).alias("org_id"),
        path.alias("path"),
        F.when(F.col("l_returnflag") == "A", "GET").when(F.col("l_returnflag") == "N", "POST").otherwise("PUT").alias("method"),
        F.when(q % 5 == 0, F.lit(False)).when(q % 5 != 1, F.lit(True)).alias("monitoring_enabled"),
        F.when(q % 4 != 0, q - 10).alias("poll_interval_seconds"),
        F.when(q % 7 != 0, q * 250).alias("timeout_ms"),
        F.when(
            q % 3 == 0, F.create_map(F.lit("X-Tenant "), F.col("l_shipdate").cast("date").cast("string"), F.lit("accept"), F.lit("json"))
        ).alias("poll_headers_json"),
        F.col("l_shipdate").alias("created_at"),
    )


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`nation` as feature flags: one enabled quota, one disabled, the others for other features."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.col("n_nationkey")
    return n.select(
        key.alias("id"),
        F.when(key == 1, "pro").when(key == 2, "free").otherwise("trial").alias("plan"),
        F.when(key <= 2, "api_quota").otherwise("other").alias("feature_key"),
        (key != 2).alias("enabled"),
        (key + 7).alias("limit"),
    )


SCHEMA_ITEM = '{"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}'
SCHEMA_LIST = '{"type": "array", "items": {"type": "integer"}}'


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OpenAPI text per api, covering the code and media fallbacks and operations that must be skipped."""
    body = (
        '{"openapi": "3.0.0", "paths": {'
        '"/items/{id}": {"get": {"responses": {"404": {"content": {"application/json": {"schema": {"type": "null"}}}},'
        ' "200": {"content": {"text/plain": {"schema": {"type": "string"}}, "application/json": {"schema": ' + SCHEMA_ITEM + "}}}}},"
        ' "trace": {"responses": {}}, "parameters": []},'
        ' "/status": {"Post": {"responses": {"default": {"content": {"text/plain": 3, "application/xml": {"schema": '
        + SCHEMA_LIST + "}}}}}},"
        ' "/empty": {"put": {"responses": {"200": {"content": {"application/json": {"schema": {}}}}}}, "get": {}},'
        ' "/odd": "none", "/orders/%s": {"delete": {"responses": {"500": "x", "418": {"content": {"application/json": {"schema": '
        '{"type": "string"}}}}}}}}}'
    )
    a = apis(spark, sf_dir)
    head, tail = body.split("%s")
    number = F.substring("id", -12, 12)
    return a.select(
        F.concat(F.lit("spec-"), "id").alias("id"),
        "org_id",
        F.col("id").alias("api_id"),
        F.concat(F.lit(head), number, F.lit(tail)).alias("raw_spec"),
    )


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as observed responses of the telemetry organisations, bodies of several JSON shapes."""
    t = telemetry(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    ks = k.cast("string")
    url = (
        F.when(k % 6 == 0, F.concat(F.lit("https://api.example.com/items/"), ks, F.lit("?x=1")))
        .when(k % 6 == 1, F.concat(F.lit("/items/"), ks, F.lit("/")))
        .when(k % 6 == 2, F.lit("status"))
        .when(k % 6 == 3, F.concat(F.lit("/items/"), ks, F.lit("/parts")))
        .when(k % 6 == 4, F.lit("/users/me"))
        .otherwise(F.concat(F.lit("/v2/"), ks))
    )
    body = (
        F.when(k % 7 == 0, F.lit("[1, 2]"))
        .when(k % 7 == 1, F.lit('[1, "a", 2.5, 1]'))
        .when(k % 7 == 2, F.lit(None))
        .when(k % 7 == 3, F.lit("not json"))
        .otherwise(F.col("props"))
    )
    return t.select("seq", "org_id", F.lower("method").alias("method"), url.alias("url"), body.alias("body"))


def observed_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint templates of the telemetry organisations: the distinct (org, method) of the events times fixed paths."""
    t = telemetry(spark, sf_dir).select("org_id", "method").distinct()
    templates = ["/items/{id}", "/items/7", "/status/", "/items/{id}/parts", "/users/{uid}", "/{any}/me"]
    rows = t.select("*", F.posexplode(F.array(*[F.lit(p) for p in templates])).alias("n", "path"))
    return rows.select(
        F.concat_ws(":", "org_id", "method", F.col("n").cast("string")).alias("id"), "org_id", "method", "path"
    )


def observed_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two contracts per template but the last; the newer one declares an item, a list or something else."""
    from telemetra.functions.jsontools import canonical_hash

    e = observed_endpoints(spark, sf_dir)
    n = F.substring("id", -1, 1).cast("int")
    schema = F.when(n % 3 == 0, SCHEMA_ITEM).when(n % 3 == 1, SCHEMA_LIST).otherwise('{"type": "string"}')
    both = e.filter(n < 5).select(
        "org_id", F.col("id").alias("endpoint_id"), schema.alias("schema"), F.explode(F.array(F.lit(1), F.lit(2))).alias("v")
    )
    text = F.when(F.col("v") == 2, F.col("schema")).otherwise('{"type": "null"}')
    return both.select(
        "org_id",
        "endpoint_id",
        canonical_hash(text).alias("schema_hash"),
        F.when(F.col("v") == 2, F.lit("2024-02-01")).otherwise("2024-01-01").cast("timestamp_ntz").alias("created_at"),
    )


#: a small model over minutes: tree, weight, id, left, right, feature, threshold, cover, prediction
MODEL_FEATURES = ("p50_latency", "p95_latency", "error_rate", "traffic_rps")
MODEL_NODES = [
    (0, 0.8, 0, 1, 4, 1, 120.25, 100.0, 0.0), (0, 0.8, 1, 2, 3, 2, 0.34, 60.0, 0.0), (0, 0.8, 2, -1, -1, -1, 0.0, 45.0, -0.9),
    (0, 0.8, 3, -1, -1, -1, 0.0, 15.0, 0.3), (0, 0.8, 4, 5, 6, 1, 180.75, 40.0, 0.0), (0, 0.8, 5, -1, -1, -1, 0.0, 30.0, 0.2),
    (0, 0.8, 6, 7, 8, 3, 0.025, 10.0, 0.0), (0, 0.8, 7, -1, -1, -1, 0.0, 6.0, 0.7), (0, 0.8, 8, -1, -1, -1, 0.0, 4.0, 1.1),
    (1, 0.5, 0, 1, 2, 2, 0.12, 100.0, 0.0), (1, 0.5, 1, -1, -1, -1, 0.0, 70.0, -0.6), (1, 0.5, 2, 3, 4, 0, 95.5, 30.0, 0.0),
    (1, 0.5, 3, -1, -1, -1, 0.0, 12.0, 0.4), (1, 0.5, 4, 5, 6, 2, 0.55, 18.0, 0.0), (1, 0.5, 5, -1, -1, -1, 0.0, 11.0, 0.8),
    (1, 0.5, 6, -1, -1, -1, 0.0, 7.0, 1.3),
    (2, 0.3, 0, 1, 2, 3, 0.04, 100.0, 0.0), (2, 0.3, 1, -1, -1, -1, 0.0, 55.0, 0.5), (2, 0.3, 2, -1, -1, -1, 0.0, 45.0, -0.2),
]


def model_nodes(spark: SparkSession) -> DataFrame:
    kinds = "tree int, weight double, id int, left int, right int, feature int, threshold double, cover double, prediction double"
    return spark.createDataFrame(MODEL_NODES, kinds)
