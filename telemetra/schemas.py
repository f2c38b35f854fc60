"""Declared schemas of the data model."""

from __future__ import annotations

ENDPOINT_KEY = ["org_id", "api_id", "endpoint", "method"]

RAW_EVENT = (
    "timestamp string, org_id string, api_id string, endpoint_id string, endpoint string, method string, "
    "status int, latency_ms int, request_size_bytes int, response_size_bytes int, "
    "schema_hash string, schema_version string, client_region string"
)

# The lenient reader also takes the two short size names.
LENIENT_EVENT = RAW_EVENT + ", request_size int, response_size int"

ENVELOPE = (
    "topic string, partition int, offset bigint, "
    "headers array<struct<key:string,value:binary>>, value binary"
)

TELEMETRY = (
    "time timestamp, org_id string, api_id string, endpoint string, method string, status int, "
    "latency_ms int, request_size int, response_size int, schema_hash string, schema_version string"
)

TOP_FEATURES = (
    "array<struct<feature:string,name:string,value:double,contribution:double,abs_contribution:double>>"
)

PREDICTIONS = (
    "time timestamp, org_id string, api_id string, endpoint string, method string, risk_score double, "
    f"prediction string, confidence double, top_features {TOP_FEATURES}, feature_values map<string,double>, "
    "model_version string, feature_schema_version string, model_hash string, is_warmed_up boolean"
)

MINUTES = (
    "timestamp timestamp, window_duration_minutes int, p50_latency double, p90_latency double, "
    "p95_latency double, latency_variance double, latency_delta double, error_rate double, "
    "error_rate_delta double, traffic_rps double, traffic_delta double, schema_fields_added int, "
    "schema_fields_removed int, schema_breaking_changes int, schema_entropy double, "
    "schema_entropy_delta double, recent_deploy int, label int"
)

ALERT = (
    "org_id string, api_id string, endpoint string, method string, risk_score double, "
    "prediction string, severity string, timestamp string"
)

# Feature names in model order, the two older names, and the older model's list.
FEATURES = [
    "p50_latency",
    "p90_latency",
    "p95_latency",
    "latency_variance",
    "latency_delta",
    "error_rate",
    "error_rate_delta",
    "traffic_rps",
    "traffic_delta",
    "schema_fields_added",
    "schema_fields_removed",
    "schema_breaking_changes",
    "schema_entropy",
    "schema_entropy_delta",
    "recent_deploy",
    "p95_latency_roll_mean_15",
    "latency_variance_roll_std_15",
    "error_rate_roll_mean_15",
    "error_rate_acceleration",
    "traffic_utilization_proxy",
    "p95_to_p50_ratio",
    "latency_p95_zscore",
    "error_rate_ewm",
    "p95_latency_roll_max_15",
    "error_high_streak",
]
FEATURE_ALIASES = {"latency_mean": "p50_latency", "latency_p95": "p95_latency"}
LEGACY_FEATURES = [
    "latency_mean",
    "latency_p95",
    "latency_variance",
    "latency_delta",
    "error_rate",
    "error_rate_delta",
    "traffic_rps",
    "traffic_delta",
    "schema_fields_added",
    "schema_fields_removed",
    "schema_breaking_changes",
]
