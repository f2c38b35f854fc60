"""OpenAPI documents, contracts and verdicts on observed responses, as table jobs."""

from __future__ import annotations

import datetime as dt
import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.jsontools import digest, shape_hash
from telemetra.functions.urls import normalise_path

# Operations of a path, order of preferred response codes, preferred media type.
METHODS = ["get", "post", "put", "patch", "delete", "head", "options"]
CODES = ["200", "201", "202", "default"]
MEDIA = "application/json"

_OPERATIONS = "array<struct<path:string,pos:int,method:string,schema:string,schema_hash:string>>"


def _object(value) -> dict:
    return value if isinstance(value, dict) else {}


def response_schema(operation: dict) -> dict:
    """Response schema of an operation: the preferred codes first, then the others as they stand. A response counts by
    its JSON media, else by its first object media; empty if none promises anything."""
    responses = _object(operation.get("responses"))
    for code in [*(c for c in CODES if c in responses), *(c for c in responses if c not in CODES)]:
        content = _object(_object(responses[code]).get("content"))
        media = content.get(MEDIA)
        if not isinstance(media, dict):
            media = next((m for m in content.values() if isinstance(m, dict)), {})
        if isinstance(media.get("schema"), dict):
            return media["schema"]
    return {}


_plain = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


@lru_cache(maxsize=4096)  # texts of schemas; a worker keeps that many
def _hash(schema: str) -> str:
    return digest(json.loads(schema))


def _operations(paths: str | None) -> list[tuple]:
    """(path, pos, METHOD, schema, schema_hash) of the operations below the paths of one document."""
    out = []
    try:
        for path, item in _object(json.loads(paths or "null")).items():
            for pos, (verb, operation) in enumerate(_object(item).items()):
                if verb.lower() in METHODS:
                    # an empty schema object promises nothing
                    schema = response_schema(_object(operation))
                    text = _plain(schema) if schema else None
                    out.append((path, pos, verb.upper(), text, text and _hash(text)))
    except (ValueError, RecursionError):
        return []
    return out


def spec_operations(specs: DataFrame) -> DataFrame:
    """One row per (spec, path, METHOD) with the response schema text and its hash (null when there is none).

    A document is read twice: its paths are cut out, and one pass over them finds all operations.
    """
    paths = F.from_json("raw_spec", "paths string")["paths"]
    # once a document: Spark neither repeats nor moves what it takes for not deterministic. Documents may be large, so
    # they reach Python a hundred at a time (a plain function's batch)
    found = F.udf(_operations, _OPERATIONS, useArrow=False).asNondeterministic()
    rows = specs.select(F.col("id").alias("spec_id"), "org_id", "api_id", found(paths).alias("operations"))
    return rows.select("spec_id", "org_id", "api_id", F.inline("operations"))


def new_endpoints(ops: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Operations of a spec that the inventory does not list yet."""
    at = ["org_id", "api_id", "path", "method"]
    return ops.select(*at).distinct().join(endpoints.select(*at), at, "left_anti")


def synced_operations(ops: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(org, endpoint, hash) for operations with a schema and a known endpoint; the later spelling of a method wins."""
    at = ["org_id", "api_id", "path", "method"]
    best = ops.filter(F.col("schema_hash").isNotNull()).groupBy(*at).agg(F.max_by("schema_hash", "pos").alias("schema_hash"))
    known = endpoints.select(F.col("id").alias("endpoint_id"), *at)
    return best.join(known, at).select("org_id", "endpoint_id", "schema_hash")


def synced_counts(ops: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(org, api, synced) for every api with operations: to how many of its endpoints a sync gives a contract."""
    at = ["org_id", "api_id", "path", "method"]
    promised = ops.groupBy(*at).agg(F.max("schema_hash").isNotNull().alias("promised"))
    met = promised.join(endpoints.select(*at, F.col("id").alias("endpoint_id")), at, "left")
    synced = F.count_if(F.col("promised") & F.col("endpoint_id").isNotNull())
    return met.groupBy("org_id", "api_id").agg(synced.alias("synced"))


def sync_contracts(ops: DataFrame, endpoints: DataFrame, contracts: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Contract table after a sync: the newest contract of each endpoint takes the new hash, missing ones are added."""
    at = ["org_id", "endpoint_id"]
    synced = synced_operations(ops, endpoints).withColumnRenamed("schema_hash", "new_hash")
    newest = Window.partitionBy(*at).orderBy(F.desc("created_at"), F.desc("schema_hash"))
    stored = contracts.select(*at, "schema_hash", "created_at").withColumn("_rn", F.row_number().over(newest))
    renewed = F.coalesce(F.col("_rn"), F.lit(1)) == 1
    now = F.lit(as_of).cast(contracts.schema["created_at"].dataType)
    return stored.join(synced, at, "full_outer").select(
        *at,
        F.when(renewed, F.coalesce("new_hash", "schema_hash")).otherwise(F.col("schema_hash")).alias("schema_hash"),
        F.when(F.col("_rn").isNull(), now).otherwise(F.col("created_at")).alias("created_at"),
    )


def _segments(path: Column) -> Column:
    return F.split(path, "/")


def _is_placeholder(segment: Column) -> Column:
    return F.startswith(segment, F.lit("{")) & F.endswith(segment, F.lit("}"))


def match_paths(paths: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Best endpoint template for each (org_id, method, path).

    Templates with the same placeholder positions form one mask. A path is rewritten once per mask in use
    for its (organisation, method, length) and then found by equality, so nothing is compared pairwise.
    Fewest placeholders win, then the template text, then the endpoint id.
    """
    segs = _segments(normalise_path("path"))
    t = endpoints.select(
        "org_id",
        "method",
        F.col("id").alias("endpoint_id"),
        F.col("path").alias("template"),
        segs.alias("segs"),
    ).select(
        "*",
        F.size("segs").alias("length"),
        F.array_join(F.transform("segs", lambda s: F.when(_is_placeholder(s), "1").otherwise("0")), "").alias("mask"),
        F.array_join(F.transform("segs", lambda s: F.when(_is_placeholder(s), "{}").otherwise(s)), "/").alias("form"),
        F.size(F.filter("segs", _is_placeholder)).alias("open"),
    )
    form = ["org_id", "method", "mask", "form"]
    first = Window.partitionBy(*form).orderBy("template", "endpoint_id")
    forms = t.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1)
    masks = t.select("org_id", "method", "length", "mask").distinct()
    wanted = paths.select("org_id", "method", "path").distinct()
    masked = F.array_join(
        F.transform(
            _segments(normalise_path("path")),
            lambda s, i: F.when(F.substr(F.col("mask"), i + 1, F.lit(1)) == "1", "{}").otherwise(s),
        ),
        "/",
    )
    tries = (
        wanted.withColumn("length", F.size(_segments(normalise_path("path"))))
        .join(masks, ["org_id", "method", "length"])
        .withColumn("form", masked)
    )
    hits = tries.join(forms.select(*form, "open", "template", "endpoint_id"), form)
    best = F.min(F.struct("open", "template", "endpoint_id")).alias("b")
    return hits.groupBy("org_id", "method", "path").agg(best).select(
        "org_id", "method", "path", F.col("b.endpoint_id").alias("endpoint_id"), F.col("b.template").alias("template")
    )


def newest_contracts(contracts: DataFrame) -> DataFrame:
    return contracts.groupBy("org_id", "endpoint_id").agg(
        F.max(F.struct("created_at", "schema_hash")).alias("c")
    ).select("org_id", "endpoint_id", F.col("c.schema_hash").alias("contract_hash"))


def contract_verdict(observed: DataFrame, endpoints: DataFrame, contracts: DataFrame) -> DataFrame:
    """Adds status (missing, valid, warning), endpoint_id, path, contract_hash and observed_hash to each response.

    ``observed`` has org_id, method, url and body (JSON text; a null body is JSON null). Bodies without a
    contract are never parsed.
    """
    seen = observed.withColumn("method", F.upper("method")).withColumn("path", normalise_path("url"))
    at = ["org_id", "method", "path"]
    # contracts meet the distinct paths first, so the responses themselves take part in one join only
    matched = match_paths(seen, endpoints).join(newest_contracts(contracts), ["org_id", "endpoint_id"], "left")
    out = seen.join(matched, at, "left")
    has = F.col("contract_hash").isNotNull()
    out = out.withColumn("observed_hash", shape_hash(F.when(has, F.coalesce("body", F.lit("null")))))
    status = F.when(~has, "missing").when(F.col("observed_hash") == F.col("contract_hash"), "valid").otherwise("warning")
    return out.withColumn("status", status).withColumn("path", F.coalesce("template", "path")).drop("template")
