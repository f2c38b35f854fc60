"""Endpoint inventory: poll targets, reconciliation, counts, search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.scalars import contains_ci

# Defaults of a poll target.
DEFAULT_INTERVAL_S = 30
DEFAULT_TIMEOUT_MS = 5_000
DEFAULT_BACKOFF_S = 300
DEFAULT_METHOD = "GET"
STORED_SCHEMA_VERSION = "active-poll.v2"
STATIC_SCHEMA_VERSION = "active-poll.v1"

TARGET_COLUMNS = [
    "name",
    "endpoint_id",
    "org_id",
    "api_id",
    "base_url",
    "path",
    "method",
    "interval_seconds",
    "timeout_ms",
    "headers",
    "body",
    "client_region",
    "schema_version",
    "max_backoff_seconds",
]
STATIC_TARGET = (
    "array<struct<name:string,org_id:string,api_id:string,base_url:string,path:string,method:string,"
    "interval_seconds:int,timeout_ms:int,headers:map<string,string>,body:string,client_region:string,"
    "schema_version:string>>"
)


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def _positive(name: str, default: int) -> Column:
    return F.when(F.col(name) > 0, F.col(name)).otherwise(F.lit(default))


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    """A column newer tables have and older ones lack."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def clean_targets(targets: DataFrame) -> DataFrame:
    """Trims, fills defaults and drops targets without organisation, api, base url or path."""
    df = targets
    kinds = {"interval_seconds": "int", "timeout_ms": "int", "max_backoff_seconds": "int", "headers": "map<string,string>"}
    for name in TARGET_COLUMNS:
        df = df.withColumn(name, _optional(df, name, kinds.get(name, "string")))
    for name in TARGET_COLUMNS:
        if name not in kinds and name != "body":
            df = df.withColumn(name, _text(name))
    df = df.filter((F.col("org_id") != "") & (F.col("api_id") != "") & (F.col("base_url") != "") & (F.col("path") != ""))
    method = F.when(F.col("method") == "", DEFAULT_METHOD).otherwise(F.upper("method"))
    version = F.when(F.col("schema_version") == "", STORED_SCHEMA_VERSION).otherwise(F.col("schema_version"))
    return df.select(
        F.when(F.col("name") == "", F.col("path")).otherwise(F.col("name")).alias("name"),
        "endpoint_id",
        "org_id",
        "api_id",
        "base_url",
        "path",
        method.alias("method"),
        _positive("interval_seconds", DEFAULT_INTERVAL_S).alias("interval_seconds"),
        _positive("timeout_ms", DEFAULT_TIMEOUT_MS).alias("timeout_ms"),
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        F.coalesce("body", F.lit("")).alias("body"),
        "client_region",
        version.alias("schema_version"),
        _positive("max_backoff_seconds", DEFAULT_BACKOFF_S).alias("max_backoff_seconds"),
    )


def poll_targets(endpoints: DataFrame, apis: DataFrame) -> DataFrame:
    """Monitored endpoints with their api's base url. Columns an older endpoints table lacks count as null."""
    e = endpoints.select(
        F.col("id").alias("endpoint_id"),
        "org_id",
        "api_id",
        "path",
        "method",
        "created_at",
        F.coalesce(_optional(endpoints, "monitoring_enabled", "boolean"), F.lit(True)).alias("monitoring_enabled"),
        _optional(endpoints, "poll_interval_seconds", "int").alias("interval_seconds"),
        _optional(endpoints, "timeout_ms", "int").alias("timeout_ms"),
        _optional(endpoints, "poll_headers_json", "map<string,string>").alias("headers"),
    ).filter("monitoring_enabled")
    a = apis.select(F.col("id").alias("api_id"), "base_url")
    return clean_targets(e.join(a, "api_id"))


def static_targets(configs: DataFrame, column: str = "targets") -> DataFrame:
    """Targets from JSON array texts. A row whose array is not valid or misses required fields gives none."""
    parsed = configs.withColumn("_t", F.from_json(F.trim(column), STATIC_TARGET))

    def complete(t: Column) -> Column:
        def given(name: str) -> Column:
            return F.trim(F.coalesce(t[name], F.lit(""))) != ""

        return given("org_id") & given("api_id") & given("base_url") & given("path")

    whole = parsed.filter(F.col("_t").isNotNull() & F.forall("_t", complete))
    flat = whole.select(F.explode("_t").alias("t")).select("t.*")
    flat = flat.withColumn("schema_version", F.coalesce(F.nullif(F.trim("schema_version"), F.lit("")), F.lit(STATIC_SCHEMA_VERSION)))
    return clean_targets(flat)


def target_key() -> Column:
    by_id = F.concat_ws("|", "org_id", "api_id", "endpoint_id")
    by_path = F.concat_ws("|", "org_id", "api_id", "method", "path")
    return F.when(F.col("endpoint_id") != "", by_id).otherwise(by_path)


def merge_targets(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Union by target key. A primary row wins; within one side the key's last row by fingerprint does."""
    both = primary.withColumn("_p", F.lit(1)).unionByName(secondary.withColumn("_p", F.lit(0)))
    keyed = fingerprint(both)
    best = Window.partitionBy("target_key").orderBy(F.desc("_p"), F.desc("fingerprint"))
    return keyed.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") == 1).drop("_rn", "_p")


def go_duration(ms: Column) -> Column:
    """Durations as text: 500ms, 1.5s, 30s, 5m0s, 1h0m0s."""
    total = ms.cast("bigint")
    hours, minutes = F.floor(total / 3_600_000), F.floor(total / 60_000) % 60
    seconds = F.format_string("%.3f", (total % 60_000) / F.lit(1000.0))
    seconds = F.concat(F.regexp_replace(seconds, "[.]?0+$", ""), F.lit("s"))
    seconds = F.when(total % 60_000 == 0, "0s").otherwise(seconds)
    return (
        F.when(total == 0, "0s")
        .when(total < 1000, F.concat(total.cast("string"), F.lit("ms")))
        .when(total < 60_000, seconds)
        .when(total < 3_600_000, F.concat(minutes.cast("string"), F.lit("m"), seconds))
        .otherwise(F.concat(hours.cast("string"), F.lit("h"), minutes.cast("string"), F.lit("m"), seconds))
    )


def fingerprint(targets: DataFrame) -> DataFrame:
    """Adds ``target_key`` and ``fingerprint``: every setting joined by ``|``, headers lower-cased and sorted."""
    pairs = F.transform(
        F.map_entries("headers"), lambda h: F.concat(F.lower(F.trim(h["key"])), F.lit("="), F.trim(h["value"]))
    )
    parts = [
        "name",
        "endpoint_id",
        "org_id",
        "api_id",
        "base_url",
        "path",
        "method",
        go_duration(F.col("interval_seconds") * 1000),
        go_duration(F.col("timeout_ms")),
        "body",
        "client_region",
        "schema_version",
        go_duration(F.col("max_backoff_seconds") * 1000),
        F.concat_ws(";", F.array_sort(pairs)),
    ]
    return targets.withColumn("target_key", target_key()).withColumn("fingerprint", F.concat_ws("|", *parts))


def reconcile(desired: DataFrame, active: DataFrame) -> DataFrame:
    """(target_key, action): added, removed, changed or unchanged.

    Fingerprints are long texts and only compared, so 128 bits of their SHA-256 travel instead.
    """
    mark = F.substring(F.unhex(F.sha2("fingerprint", 256)), 1, 16)
    d = fingerprint(desired).select("target_key", mark.alias("want"))
    a = fingerprint(active).select("target_key", mark.alias("have"))
    action = (
        F.when(F.col("have").isNull(), "added")
        .when(F.col("want").isNull(), "removed")
        .when(F.col("have") != F.col("want"), "changed")
        .otherwise("unchanged")
    )
    return d.join(a, "target_key", "full_outer").select("target_key", action.alias("action"))


def sort_status(status: DataFrame) -> DataFrame:
    """Target status list: last polled first, then by key."""
    return status.orderBy(F.desc("last_polled_at"), "target_key")


def api_endpoint_counts(apis: DataFrame, endpoints: DataFrame) -> DataFrame:
    n = endpoints.groupBy("api_id").agg(F.count(F.lit(1)).alias("endpoints"))
    a = apis.select(F.col("id").alias("api_id"), "org_id", "name", "base_url")
    return a.join(n, "api_id", "left").withColumn("endpoints", F.coalesce("endpoints", F.lit(0)).cast("bigint"))


def endpoints_per_api(apis: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Total endpoints over max(apis, 1)."""
    parts = apis.select(F.lit(1).alias("a"), F.lit(0).alias("e")).unionAll(endpoints.select(F.lit(0), F.lit(1)))
    sums = parts.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("e"), F.lit(0)).alias("e"))
    return sums.select((F.col("e") / F.greatest(F.col("a"), F.lit(1))).alias("endpoints_per_api"))


def api_tree(apis: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Each api with its endpoints as a nested list ordered by path and method.

    The nested row is the result format; its length is the endpoint count of one api in the catalog.
    """
    items = F.array_sort(F.collect_list(F.struct("path", "method", F.col("id").alias("endpoint_id"))))
    nested = endpoints.groupBy("api_id").agg(items.alias("endpoints"))
    a = apis.select(F.col("id").alias("api_id"), "org_id", "name", "base_url")
    none = F.array().cast("array<struct<path:string,method:string,endpoint_id:string>>")
    return a.join(nested, "api_id", "left").withColumn("endpoints", F.coalesce("endpoints", none))


def search(df: DataFrame, q: str, columns: Sequence[str] = ("name", "base_url")) -> DataFrame:
    """Rows where any of the columns contains the text, case-insensitive; an empty text keeps all."""
    if not q.strip():
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(contains_ci(c, q), F.lit(False))
    return df.filter(hit)


def duplicate_endpoints(endpoints: DataFrame) -> DataFrame:
    """Endpoints that share (api, path, method) with another id. Counted by aggregate and join, not by a self product."""
    at = ["api_id", "path", "method"]
    repeated = endpoints.groupBy(*at).agg(F.count(F.lit(1)).alias("definitions")).filter(F.col("definitions") > 1)
    return endpoints.join(repeated, at).select("id", *at, "definitions")


def members(memberships: DataFrame, users: DataFrame, org_id: str) -> DataFrame:
    """Members of one organisation with their user record."""
    m = memberships.filter(F.col("org_id") == org_id)
    u = users.select(F.col("id").alias("user_id"), "email", "name", "provider")
    return m.join(u, "user_id").select("user_id", "org_id", "role", "email", "name", "provider")
