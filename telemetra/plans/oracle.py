"""The same answers in SQL, for checking: plain window and range-join forms over whole tables."""

from __future__ import annotations

from telemetra.sources.carrier import MODEL_FEATURES, MODEL_NODES, PATHS, SCHEMA_ITEM, SCHEMA_LIST

# Digits kept of a double: engines may differ in the last bits. One feature is tiny and keeps more.
DIGITS = {"*": 6, "traffic_utilization_proxy": 9}

K = "org_id, api_id, endpoint, method"


def R(expr: str, alias: str | None = None, digits: int | None = None) -> str:
    digits = digits or DIGITS.get(alias or expr, DIGITS["*"])
    return f"round({expr}, {digits}) + 0.0 AS {alias or expr}"


TEL = f"""tel AS (
  SELECT event_id AS seq, user_id, props, k,
         TIMESTAMP '2024-01-01' + to_microseconds(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) // 600) AS time,
         printf('00000000-0000-4000-8000-%012d', user_id % 3) AS org_id,
         printf('00000000-0000-4000-9000-%012d', user_id % 6) AS api_id,
         '/v1/' || event_type AS endpoint,
         CASE WHEN k % 4 = 0 THEN 'POST' ELSE 'GET' END AS method,
         CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 503 WHEN k % 10 = 3 THEN 500
              WHEN k % 10 = 7 THEN 404 ELSE 200 END AS status,
         CAST(floor(value) AS INTEGER) AS latency_ms, k * 10 AS request_size, k * 100 AS response_size,
         CASE WHEN k % 25 <> 0 THEN 'h' || CAST((event_id // 700) % 3 AS VARCHAR) END AS schema_hash
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

AS_OF = "TIMESTAMP '2024-01-01 01:12:00'"

STATS = f"""stats AS (
  SELECT org_id, endpoint, method, count(*) AS request_count,
         avg(CASE WHEN status >= 500 THEN 1.0::double ELSE 0.0::double END) AS error_rate,
         quantile_cont(latency_ms, 0.95) AS p95_latency
  FROM tel WHERE time >= {AS_OF} - INTERVAL 24 HOUR GROUP BY ALL)"""

RAW = f"""raw AS (
  SELECT seq, batch_id, pos,
    CASE n WHEN 1 THEN '' WHEN 2 THEN '2024-01-01 10:00' ELSE strftime(time, '%Y-%m-%dT%H:%M:%S.%fZ') END AS timestamp,
    CASE n WHEN 3 THEN 'abc' WHEN 15 THEN 'abc' WHEN 17 THEN ' ' || org_id ELSE org_id END AS org_id,
    CASE n WHEN 4 THEN '' ELSE api_id END AS api_id,
    CASE n WHEN 5 THEN 'x' END AS endpoint_id,
    CASE n WHEN 6 THEN ' ' WHEN 7 THEN repeat('é', 200) ELSE endpoint END AS endpoint,
    CASE n WHEN 8 THEN ' ' WHEN 9 THEN 'get' WHEN 16 THEN ' post ' ELSE method END AS method,
    CASE n WHEN 10 THEN 99 WHEN 11 THEN 600 WHEN 15 THEN 99 ELSE status END AS status,
    CASE n WHEN 12 THEN -1 ELSE latency_ms END AS latency_ms,
    CASE n WHEN 13 THEN -1 WHEN 18 THEN NULL ELSE request_size END AS request_size_bytes,
    CASE n WHEN 14 THEN -1 WHEN 18 THEN NULL ELSE response_size END AS response_size_bytes,
    schema_hash
  FROM (SELECT *, seq // 50 AS batch_id, CAST(seq % 50 AS INTEGER) AS pos,
               CASE WHEN (seq // 50) % 3 = 0 THEN 0 ELSE seq % 40 END AS n FROM tel))"""

_UUID = "'^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$'"
_STAMP = "'^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?(Z|[+-]\\d{2}:\\d{2})$'"
_NUMBERS = """WHEN coalesce(status, 0) NOT BETWEEN 100 AND 599 THEN 'status must be a valid HTTP status'
    WHEN latency_ms < 0 THEN 'latency_ms must be >= 0'
    WHEN request_size_bytes < 0 THEN 'request_size_bytes must be >= 0'
    WHEN response_size_bytes < 0 THEN 'response_size_bytes must be >= 0'"""
STRICT = f"""strict AS (SELECT *, CASE
    WHEN trim(timestamp) = '' THEN 'timestamp is required'
    WHEN NOT regexp_matches(timestamp, {_STAMP}) THEN 'timestamp must be RFC3339'
    WHEN trim(org_id) = '' THEN 'org_id is required'
    WHEN NOT regexp_matches(org_id, {_UUID}) THEN 'org_id must be a valid uuid'
    WHEN trim(api_id) = '' THEN 'api_id is required'
    WHEN NOT regexp_matches(api_id, {_UUID}) THEN 'api_id must be a valid uuid'
    WHEN coalesce(trim(endpoint_id), '') <> '' AND NOT regexp_matches(trim(endpoint_id), {_UUID})
      THEN 'endpoint_id must be a valid uuid'
    WHEN trim(endpoint) = '' THEN 'endpoint is required'
    WHEN strlen(endpoint) >= 256 THEN 'endpoint length must be < 256'
    WHEN trim(method) = '' THEN 'method is required'
    WHEN upper(method) <> method THEN 'method must be uppercase'
    {_NUMBERS} END AS reason FROM raw)"""
LENIENT = f"""trimmed AS (SELECT * REPLACE (trim(org_id) AS org_id, trim(api_id) AS api_id, trim(endpoint) AS endpoint,
      upper(trim(method)) AS method, coalesce(request_size_bytes, 0) AS request_size_bytes,
      coalesce(response_size_bytes, 0) AS response_size_bytes) FROM raw),
  lenient AS (SELECT *, CASE
    WHEN NOT regexp_matches(timestamp, {_STAMP}) THEN 'timestamp must be RFC3339'
    WHEN NOT regexp_matches(org_id, {_UUID}) THEN 'org_id must be a valid uuid'
    WHEN NOT regexp_matches(api_id, {_UUID}) THEN 'api_id must be a valid uuid'
    WHEN endpoint = '' THEN 'endpoint is required'
    WHEN method = '' THEN 'method is required'
    {_NUMBERS} END AS reason FROM trimmed)"""
VERDICTS = """verdicts AS (SELECT batch_id, count(*) AS events,
    arg_min('event[' || pos || ']: ' || reason, pos) FILTER (reason IS NOT NULL) AS reason,
    min(org_id) = max(org_id) AS single_org FROM strict GROUP BY batch_id)"""

ORGS = """orgs AS (SELECT printf('00000000-0000-4000-8000-%012d', c_custkey) AS id, c_name AS name,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'free' WHEN 'AUTOMOBILE' THEN 'Pro' WHEN 'MACHINERY' THEN 'business'
      WHEN 'FURNITURE' THEN 'trial' END AS plan FROM customer)"""
APIS = """apis AS (SELECT printf('00000000-0000-4000-9000-%012d', o_orderkey) AS id, o_orderkey AS n,
    printf('00000000-0000-4000-8000-%012d', o_custkey) AS org_id, 'Api ' || o_orderpriority AS name,
    'https://Api' || (o_orderkey % 50) || '.example.com'
      || CASE o_orderkey % 3 WHEN 0 THEN ':8443' WHEN 1 THEN '/' ELSE '' END AS base_url, o_orderdate AS created_at
    FROM orders)"""
_PATH_LIST = "[" + ", ".join(f"'{p}'" for p in PATHS) + "]"
EPS = f"""eps AS (SELECT printf('%d-%d-%d-%d-%d', l_orderkey, l_partkey, l_suppkey, l_linenumber,
      CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
    printf('00000000-0000-4000-9000-%012d', l_orderkey) AS api_id,
    printf('00000000-0000-4000-8000-%012d', o_custkey) AS org_id,
    {_PATH_LIST}[l_linenumber] AS path,
    CASE l_returnflag WHEN 'A' THEN 'GET' WHEN 'N' THEN 'POST' ELSE 'PUT' END AS method,
    CASE WHEN q % 5 = 0 THEN false WHEN q % 5 <> 1 THEN true END AS monitoring_enabled,
    CASE WHEN q % 4 <> 0 THEN q - 10 END AS poll_interval_seconds, CASE WHEN q % 7 <> 0 THEN q * 250 END AS timeout_ms,
    q % 3 = 0 AS has_headers, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, l_shipdate AS created_at
  FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem) JOIN orders ON l_orderkey = o_orderkey)"""
TARGETS = f"""targets AS (SELECT e.path AS name, e.id AS endpoint_id, e.org_id, e.api_id, a.base_url, e.path, e.method,
    CASE WHEN poll_interval_seconds > 0 THEN poll_interval_seconds ELSE 30 END AS interval_seconds,
    CASE WHEN timeout_ms > 0 THEN timeout_ms ELSE 5000 END AS timeout_ms, has_headers, day,
    'active-poll.v2' AS schema_version, 300 AS max_backoff_seconds
  FROM eps e JOIN apis a ON a.id = e.api_id WHERE coalesce(monitoring_enabled, true))"""


def _duration(ms: str) -> str:
    """Only the ranges that occur: under a minute, and whole minutes beyond."""
    return f"""CASE WHEN {ms} < 1000 THEN ({ms}) || 'ms'
      WHEN {ms} < 60000 THEN regexp_replace(printf('%.3f', ({ms}) / 1000.0), '\\.?0+$', '') || 's'
      ELSE (({ms}) // 60000) || 'm' || CASE WHEN ({ms}) % 60000 = 0 THEN '0' ELSE
        regexp_replace(printf('%.3f', (({ms}) % 60000) / 1000.0), '\\.?0+$', '') END || 's' END"""


FP = f"""fp AS (SELECT *, CASE WHEN endpoint_id <> '' THEN org_id || '|' || api_id || '|' || endpoint_id
      ELSE org_id || '|' || api_id || '|' || method || '|' || path END AS target_key,
    concat_ws('|', name, endpoint_id, org_id, api_id, base_url, path, method, {_duration('interval_seconds * 1000')},
      {_duration('timeout_ms')}, '', '', schema_version, '5m0s',
      CASE WHEN has_headers THEN 'accept=json;x-tenant=' || day ELSE '' END) AS fingerprint FROM targets)"""

FEAT = f"""
t AS (SELECT {K}, seq, epoch_us(time) AS us, epoch_us(time) // 60000000 AS minute, status >= 500 AS err,
             latency_ms AS lat, nullif(schema_hash, '') AS h FROM tel),
p AS (SELECT *, lag(h) OVER w AS ph, lag(us) OVER w AS pus FROM t WINDOW w AS (PARTITION BY {K} ORDER BY us, seq)),
tk AS (SELECT {K}, minute, max(us) AS now FROM t GROUP BY ALL),
w1 AS (SELECT {K}, tk.minute, now, quantile_cont(lat, 0.5) AS p50_latency, quantile_cont(lat, 0.9) AS p90_latency,
         quantile_cont(lat, 0.95) AS p95_latency, var_pop(lat) AS latency_variance, count(*) AS c1,
         avg(CASE WHEN err THEN 1.0::double ELSE 0.0::double END) AS error_rate
       FROM tk JOIN t USING ({K}) WHERE us BETWEEN now - 60000000 AND now GROUP BY ALL),
w5 AS (SELECT {K}, tk.minute, avg(lat) AS m5, count(*) AS c5, avg(CASE WHEN err THEN 1.0::double ELSE 0.0::double END) AS e5
       FROM tk JOIN t USING ({K}) WHERE us BETWEEN now - 300000000 AND now GROUP BY ALL),
w15 AS (SELECT {K}, tk.minute, coalesce(entropy(h) FILTER (h IS NOT NULL), 0) AS schema_entropy,
          count(*) FILTER (ph <> h AND pus >= now - 900000000) AS ch,
          count(*) FILTER (ph <> h AND pus >= now - 900000000 AND err) AS br
        FROM tk JOIN p USING ({K}) WHERE us BETWEEN now - 900000000 AND now GROUP BY ALL),
base AS (SELECT *, c1 / 60.0::double AS traffic_rps FROM w1 JOIN w5 USING ({K}, minute) JOIN w15 USING ({K}, minute)),
hist AS (SELECT *,
    lag(schema_entropy) OVER w AS prev_entropy, lag(p95_latency) OVER w AS prev_p95,
    avg(p95_latency) OVER w15r AS p95m, stddev_pop(latency_variance) OVER w15r AS vs, avg(error_rate) OVER w15r AS erm,
    max(p95_latency) OVER w15r AS p95x, avg(traffic_rps) OVER w10r AS trm,
    avg(p95_latency) OVER w30r AS zm, stddev_pop(p95_latency) OVER w30r AS zs,
    max(p95_latency) OVER w30r > min(p95_latency) OVER w30r AS varies,
    lag(error_rate, 1) OVER w AS e1, lag(error_rate, 2) OVER w AS e2, lag(error_rate, 3) OVER w AS e3,
    list(error_rate) OVER wall AS es, quantile_cont(error_rate, 0.8) OVER wall AS q80,
    sum(n_events) OVER (PARTITION BY {K} ORDER BY minute) AS so_far
  FROM base JOIN (SELECT {K}, minute, count(*) AS n_events FROM t GROUP BY ALL) USING ({K}, minute)
  WINDOW w AS (PARTITION BY {K} ORDER BY minute),
    w10r AS (PARTITION BY {K} ORDER BY minute ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
    w15r AS (PARTITION BY {K} ORDER BY minute ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING),
    w30r AS (PARTITION BY {K} ORDER BY minute ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
    wall AS (PARTITION BY {K} ORDER BY minute ROWS BETWEEN 180 PRECEDING AND 1 PRECEDING)),
feat AS (SELECT {K}, make_timestamp(now) AS time,
    p50_latency, p90_latency, p95_latency, CASE WHEN c1 > 1 THEN latency_variance ELSE 0 END AS latency_variance,
    p50_latency - m5 AS latency_delta, error_rate, error_rate - e5 AS error_rate_delta, traffic_rps,
    traffic_rps - c5 / 300.0::double AS traffic_delta,
    ch::double AS schema_fields_added, greatest(0, ch - 1)::double AS schema_fields_removed,
    CASE WHEN br > 0 THEN 1.0::double ELSE 0.0::double END AS schema_breaking_changes, schema_entropy,
    coalesce(schema_entropy - prev_entropy, 0) AS schema_entropy_delta,
    CASE WHEN ch > 0 THEN 1.0::double ELSE 0.0::double END AS recent_deploy,
    coalesce(p95m, p95_latency) AS p95_latency_roll_mean_15, coalesce(vs, 0) AS latency_variance_roll_std_15,
    coalesce(erm, error_rate) AS error_rate_roll_mean_15,
    coalesce((e1 - e2) - (e2 - e3), 0) AS error_rate_acceleration,
    coalesce(trm, traffic_rps) / 2000.0::double AS traffic_utilization_proxy,
    p95_latency / greatest(p50_latency, 1) AS p95_to_p50_ratio,
    CASE WHEN varies THEN (prev_p95 - zm) / zs ELSE 0 END AS latency_p95_zscore,
    CASE WHEN coalesce(len(es), 0) = 0 THEN 0 ELSE list_reduce(es, lambda a, x: 0.3::double * x + 0.7::double * a) END AS error_rate_ewm,
    coalesce(p95x, p95_latency) AS p95_latency_roll_max_15,
    CASE WHEN coalesce(len(es), 0) >= 3 THEN len(list_filter(es[greatest(len(es) - 9, 1):], lambda x: x > q80))::double
      ELSE 0.0::double END AS error_high_streak,
    p50_latency AS latency_mean, p95_latency AS latency_p95, so_far >= 100 AS is_warmed_up FROM hist)"""


def _minutes(key: str, above: float, name: str) -> str:
    return f"""{name} AS (SELECT {key}, date_trunc('minute', time) AS time, quantile_cont(latency_ms, 0.5) AS p50_latency,
      quantile_cont(latency_ms, 0.9) AS p90_latency, quantile_cont(latency_ms, 0.95) AS p95_latency,
      var_pop(latency_ms) AS latency_variance,
      avg(CASE WHEN status >= 500 THEN 1.0::double ELSE 0.0::double END) AS error_rate,
      count(*) / 60.0::double AS traffic_rps,
      CASE WHEN count(*) FILTER (status >= 500) / count(*)::double > {above} THEN 1 ELSE 0 END AS label
    FROM tel GROUP BY ALL)"""


S = "org_id, endpoint"
MIN = _minutes(S, 0.25, "m")
_RISK = "round(least(1.0::double, 0.6::double * error_rate + 0.4::double * least(p95_latency / 400.0::double, 1.0::double)), 9)"


def _label(r: str) -> str:
    return f"CASE WHEN {r} < 0.4 THEN 'normal' WHEN {r} < 0.7 THEN 'degraded' ELSE 'high_failure_risk' END"


PRED = f"""{_minutes(K, 0.0, 'km')}, pred AS (SELECT *, {_label('risk_score')} AS prediction,
    greatest(risk_score, 1 - risk_score) AS confidence FROM (
      SELECT {K}, time + INTERVAL 17 SECOND AS time, {_RISK} AS risk_score, error_rate, p95_latency,
        traffic_rps * 60 >= 3 AS is_warmed_up FROM km))"""
SCORED = f"""{_minutes(K, 0.25, 'km')}, scored AS (SELECT *,
    round(0.7::double * least(p95_latency / 250.0::double, 1.0::double)
      + 0.3::double * least(error_rate * 1.5::double, 1.0::double), 4) AS score FROM km)"""

SCHEMA_MIN = f"""sp AS (SELECT {S}, date_trunc('minute', time) AS minute, status >= 500 AS err, nullif(schema_hash, '') AS h,
    lag(nullif(schema_hash, '')) OVER (PARTITION BY {S} ORDER BY time, seq) AS ph FROM tel),
sm AS (SELECT {S}, minute AS time, (count(*) FILTER (ph <> h))::int AS schema_fields_added,
    greatest(count(*) FILTER (ph <> h) - 1, 0)::int AS schema_fields_removed,
    (count(*) FILTER (ph <> h AND err) > 0)::int AS schema_breaking_changes,
    coalesce(entropy(h) FILTER (h IS NOT NULL), 0) AS schema_entropy, (count(*) FILTER (ph <> h) > 0)::int AS recent_deploy
  FROM sp GROUP BY {S}, minute)"""

TRAIN = f"""q AS (SELECT quantile_cont(error_rate, 0.8) AS q80 FROM m),
tr AS (SELECT *, row_number() OVER w AS rn, coalesce(lag(error_rate) OVER w > q80, false)::int AS high,
    CASE WHEN count(*) OVER r15 >= 5 THEN avg(p95_latency) OVER r15 END AS a1,
    CASE WHEN count(*) OVER r15 >= 5 THEN stddev_samp(latency_variance) OVER r15 END AS a2,
    CASE WHEN count(*) OVER r15 >= 5 THEN avg(error_rate) OVER r15 END AS a3,
    lag(error_rate, 1) OVER w AS e1, lag(error_rate, 2) OVER w AS e2, lag(error_rate, 3) OVER w AS e3,
    CASE WHEN count(*) OVER r10 >= 4 THEN avg(traffic_rps) OVER r10 / 2000.0::double END AS a5,
    lag(p95_latency) OVER w / greatest(lag(p50_latency) OVER w, 1) AS a6,
    CASE WHEN count(*) OVER r30 >= 10 THEN (lag(p95_latency) OVER w - avg(p95_latency) OVER r30)
      / greatest(stddev_samp(p95_latency) OVER r30, 1) END AS a7,
    list(error_rate) OVER (PARTITION BY {S} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS es,
    CASE WHEN count(*) OVER r15 >= 5 THEN max(p95_latency) OVER r15 END AS a9
  FROM m, q WINDOW w AS (PARTITION BY {S} ORDER BY time),
    r10 AS (PARTITION BY {S} ORDER BY time ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
    r15 AS (PARTITION BY {S} ORDER BY time ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING),
    r30 AS (PARTITION BY {S} ORDER BY time ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
tr2 AS (SELECT *, CASE WHEN coalesce(len(es), 0) > 0
      THEN list_reduce(es, lambda a, x: 0.3::double * x + 0.7::double * a) END AS a8 FROM tr),
train AS (SELECT {S}, time,
    first_value(a1 IGNORE NULLS) OVER f AS p95_latency_roll_mean_15, coalesce(a2, 0) AS latency_variance_roll_std_15,
    first_value(a3 IGNORE NULLS) OVER f AS error_rate_roll_mean_15,
    coalesce((e1 - e2) - (e2 - e3), 0) AS error_rate_acceleration,
    first_value(a5 IGNORE NULLS) OVER f AS traffic_utilization_proxy,
    first_value(a6 IGNORE NULLS) OVER f AS p95_to_p50_ratio, coalesce(a7, 0) AS latency_p95_zscore,
    first_value(a8 IGNORE NULLS) OVER f AS error_rate_ewm, first_value(a9 IGNORE NULLS) OVER f AS p95_latency_roll_max_15,
    CASE WHEN rn >= 3 THEN (sum(high) OVER (PARTITION BY {S} ORDER BY time ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))::double
      ELSE 0.0::double END AS error_high_streak
  FROM tr2 WINDOW f AS (PARTITION BY {S} ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""

_ITEM_HASH = "sha256('{\"properties\":{\"k\":{\"type\":\"integer\"}},\"required\":[\"k\"],\"type\":\"object\"}')"
_LIST_HASH = "sha256('{\"items\":{\"type\":\"integer\"},\"type\":\"array\"}')"
_STRING_HASH = "sha256('{\"type\":\"string\"}')"
_NULL_HASH = "sha256('{\"type\":\"null\"}')"
_MIXED_HASH = "sha256('{\"items\":{\"anyOf\":[{\"type\":\"integer\"},{\"type\":\"string\"},{\"type\":\"number\"}]},\"type\":\"array\"}')"

OPS = f"""ops AS (SELECT 'spec-' || a.id AS spec_id, a.org_id, a.id AS api_id, o.path, o.method, o.schema_hash
  FROM apis a, LATERAL (VALUES ('/items/{{id}}', 'GET', {_ITEM_HASH}), ('/status', 'POST', {_LIST_HASH}),
    ('/empty', 'PUT', NULL), ('/empty', 'GET', NULL),
    ('/orders/' || printf('%012d', a.n), 'DELETE', {_STRING_HASH})) o(path, method, schema_hash))"""

OBS = """obs AS (SELECT seq, org_id, method, k, props,
    CASE k % 6 WHEN 0 THEN '/items/' || k WHEN 1 THEN '/items/' || k WHEN 2 THEN '/status'
      WHEN 3 THEN '/items/' || k || '/parts' WHEN 4 THEN '/users/me' ELSE '/v2/' || k END AS path FROM tel),
oe AS (SELECT org_id || ':' || method || ':' || n AS id, org_id, method, path, rx, n, open
  FROM (SELECT DISTINCT org_id, method FROM tel),
  (VALUES (0, '/items/{id}', '^/items/[^/]+$', 1), (1, '/items/7', '^/items/7$', 0), (2, '/status/', '^/status$', 0),
    (3, '/items/{id}/parts', '^/items/[^/]+/parts$', 1), (4, '/users/{uid}', '^/users/[^/]+$', 1),
    (5, '/{any}/me', '^/[^/]+/me$', 1)) v(n, path, rx, open)),
hit AS (SELECT seq, obs.path, oe.path AS template, oe.id AS endpoint_id, n,
    row_number() OVER (PARTITION BY seq ORDER BY open, oe.path, oe.id) AS rn
  FROM obs JOIN oe ON obs.org_id = oe.org_id AND obs.method = oe.method AND regexp_matches(obs.path, rx))"""

_URL = """SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme,
    lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host,
    regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages"""


NODES = f"""nodes(tree, weight, id, l, r, feature, threshold, cover, prediction) AS (VALUES
    {", ".join("(" + ", ".join(f"{v}::double" if isinstance(v, float) else str(v) for v in row) + ")" for row in MODEL_NODES)})"""
# the definition: a leaf's value for every set of known features, weighed over the sets without a feature
SHAPLEY = f"""long AS (SELECT time, {S}, unnest(range({len(MODEL_FEATURES)})) AS feature, unnest([{", ".join(MODEL_FEATURES)}]) AS x FROM m),
anc AS (SELECT tree, id AS leaf, id AS node FROM nodes WHERE l < 0
  UNION ALL SELECT anc.tree, leaf, n.id FROM anc JOIN nodes n ON n.tree = anc.tree AND anc.node IN (n.l, n.r)),
steps AS (SELECT anc.tree, leaf, p.feature, p.threshold, p.l = c.id AS goes_left, c.cover / p.cover AS share
  FROM anc JOIN nodes c ON c.tree = anc.tree AND c.id = anc.node JOIN nodes p ON p.tree = anc.tree AND anc.node IN (p.l, p.r)),
box AS (SELECT *, row_number() OVER (PARTITION BY tree, leaf ORDER BY feature) - 1 AS bit, count(*) OVER (PARTITION BY tree, leaf) AS d
  FROM (SELECT tree, leaf, feature, max(threshold) FILTER (NOT goes_left) AS low, min(threshold) FILTER (goes_left) AS high,
    product(share) AS cover FROM steps GROUP BY 1, 2, 3)),
inside AS (SELECT time, {S}, tree, leaf, feature, bit, d, cover,
    CASE WHEN (low IS NULL OR x > low) AND (high IS NULL OR x <= high) THEN 1.0::double ELSE 0.0::double END AS hit
  FROM long JOIN box USING (feature)),
game AS (SELECT time, {S}, tree, leaf, k, product(CASE WHEN (k >> bit) & 1 = 1 THEN hit ELSE cover END) AS v
  FROM (SELECT *, unnest(range(1 << d)) AS k FROM inside) GROUP BY ALL),
parts AS (SELECT i.time, {", ".join("i." + c for c in S.split(", "))}, i.feature, sum(2 * n.weight * n.prediction * (b.v - a.v)
      * factorial(bit_count(a.k)::int) * factorial((i.d - 1 - bit_count(a.k))::int) / factorial(i.d::int)) AS part
  FROM inside i JOIN nodes n ON n.tree = i.tree AND n.id = i.leaf
  JOIN game a ON a.time = i.time AND {" AND ".join(f"a.{c} = i.{c}" for c in S.split(", "))} AND a.tree = i.tree AND a.leaf = i.leaf AND (a.k >> i.bit) & 1 = 0
  JOIN game b ON b.time = i.time AND {" AND ".join(f"b.{c} = i.{c}" for c in S.split(", "))} AND b.tree = i.tree AND b.leaf = i.leaf AND b.k = a.k + (1 << i.bit)
  GROUP BY ALL),
wide AS (SELECT time, {S}, {", ".join(f"sum(part) FILTER (feature = {i}) AS by_{n}" for i, n in enumerate(MODEL_FEATURES))}, sum(part) AS parts,
    arg_max(feature, abs(part)) AS top FROM parts GROUP BY ALL),
base AS (SELECT sum(2 * weight * prediction * reach) AS base_score
  FROM (SELECT tree, leaf, product(share) AS reach FROM steps GROUP BY 1, 2) s JOIN nodes n ON n.tree = s.tree AND n.id = s.leaf)"""
WALK = f"""walk AS (SELECT time, {S}, [{", ".join(MODEL_FEATURES)}] AS x, tree, 0 AS node FROM m, (SELECT DISTINCT tree FROM nodes)
  UNION ALL SELECT time, {S}, x, walk.tree, CASE WHEN x[feature + 1] <= threshold THEN l ELSE r END
    FROM walk JOIN nodes ON nodes.tree = walk.tree AND id = node WHERE l >= 0),
risk AS (SELECT time, {S}, 1 / (1 + exp(-sum(2 * weight * prediction))) AS risk_score
  FROM walk JOIN nodes ON nodes.tree = walk.tree AND id = node WHERE l < 0 GROUP BY ALL)"""


def _train(*names: str) -> str:
    return f"WITH {TEL}, {MIN}, {TRAIN} SELECT time, {S}, {', '.join(R(n) for n in names)} FROM train"


def oracle_sql() -> dict[str, str]:
    from telemetra.plans.queries import GROUPS, TRAIN_GROUPS

    sql: dict[str, str] = {}

    # --- dashboard aggregates
    sql["endpoint_stats"] = f"""WITH {TEL}, {STATS} SELECT org_id, endpoint, method, request_count,
        {R('error_rate')}, {R('p95_latency')}, error_rate > 0.05 AS alarm FROM stats"""
    sql["tenant_summary"] = f"""WITH {TEL} SELECT org_id, count(*) AS request_count,
        {R('avg(CASE WHEN status >= 500 THEN 1.0::double ELSE 0.0::double END)', 'error_rate')},
        {R('quantile_cont(latency_ms, 0.95)', 'p95_latency')} FROM tel
        WHERE time >= {AS_OF} - INTERVAL 24 HOUR GROUP BY org_id"""
    sql["kpi_strip"] = f"""WITH {TEL}, {STATS} SELECT org_id, sum(request_count)::bigint AS total_requests,
        {R('avg(error_rate)', 'avg_error_rate')}, {R('avg(p95_latency)', 'avg_p95_latency')} FROM stats GROUP BY org_id"""
    sql["health_label"] = f"""WITH {TEL}, {STATS} SELECT org_id, endpoint, method,
        CASE WHEN error_rate * 100 > 4 OR p95_latency > 700 THEN 'Degraded'
             WHEN error_rate * 100 > 2 OR p95_latency > 450 THEN 'Warning' ELSE 'Healthy' END AS health FROM stats"""
    sql["hourly_rollup"] = f"""WITH {TEL} SELECT org_id, date_trunc('hour', time) AS hour,
        {R('avg(latency_ms)', 'avg_latency')},
        {R('avg(CASE WHEN status >= 500 THEN 1.0::double ELSE 0.0::double END)', 'error_rate')},
        count(*) AS request_count FROM tel GROUP BY ALL"""
    sql["outcome_flags"] = f"""WITH {TEL} SELECT seq, status >= 500 AS is_server_error,
        NOT (status BETWEEN 200 AND 499) AS is_live_error,
        CASE WHEN seq % 2 = 0 THEN status IN (200, 404) ELSE status < 500 END AS is_poll_ok FROM tel"""

    # --- validation
    sql["validate_strict"] = f"WITH {TEL}, {RAW}, {STRICT} SELECT seq, coalesce(reason, 'ok') AS reason FROM strict"
    sql["validate_lenient"] = f"""WITH {TEL}, {RAW}, {LENIENT} SELECT seq, method, request_size_bytes, response_size_bytes,
        coalesce(reason, 'ok') AS reason FROM lenient"""
    sql["request_reject"] = f"""WITH {TEL}, {RAW}, {STRICT}, {VERDICTS}
        SELECT batch_id, events, coalesce(reason, 'ok') AS reason FROM verdicts"""
    sql["accepted_requests"] = f"""WITH {TEL}, {RAW}, {STRICT}, {VERDICTS} SELECT seq, org_id, status,
        coalesce(request_size_bytes, 0) AS request_size FROM raw
        WHERE batch_id IN (SELECT batch_id FROM verdicts WHERE reason IS NULL)"""
    sql["single_org_batches"] = f"""WITH {TEL}, {RAW} SELECT b AS batch_id, count(*) AS events, min(org_id) = max(org_id) AS single_org
        FROM (SELECT *, batch_id * 10 + CASE WHEN batch_id % 2 = 0
            THEN coalesce(TRY_CAST(right(org_id, 1) AS INTEGER), 0) + 1 ELSE 0 END AS b FROM raw) GROUP BY b"""
    sql["decoded_messages"] = f"""WITH {TEL}, {RAW}, {LENIENT} SELECT seq, org_id, endpoint, method, status, latency_ms,
        request_size_bytes AS request_size, schema_hash FROM lenient WHERE reason IS NULL"""
    sql["dlq_records"] = f"""WITH {TEL}, {RAW}, {LENIENT} SELECT 'telemetry.raw.dlq' AS topic,
        'dlq.invalid-payload.v1' AS schema, seq // 500 AS source_offset, reason AS failure_reason,
        CAST(seq % 500 AS VARCHAR) AS pos FROM lenient WHERE reason IS NOT NULL"""
    sql["dlq_processing"] = f"""WITH {TEL} SELECT 'telemetry.raw.processing-failure.dlq' AS topic,
        'dlq.processing-failure.v1' AS schema, 'telemetry.raw' AS source_topic, 0 AS source_partition,
        seq AS source_offset, 'telemetry write failed' AS failure_reason, base64(encode(props)) AS payload_base64 FROM tel"""
    sql["stream_lag"] = f"""WITH {TEL} SELECT 'telemetry.raw' AS topic, CAST(seq % 8 AS INTEGER) AS partition,
        greatest(0, max(seq // 8 + 3) - coalesce(max(seq // 8) FILTER (status < 500), -1) - 1) AS lag FROM tel GROUP BY ALL"""

    # --- tenants
    paying = "SELECT id FROM orgs WHERE lower(plan) IN ('pro', 'business')"
    sql["known_orgs"] = f"WITH {TEL}, {ORGS} SELECT seq, org_id FROM tel WHERE org_id IN ({paying})"
    sql["unknown_orgs"] = f"WITH {TEL}, {ORGS} SELECT seq, org_id FROM tel WHERE org_id NOT IN ({paying})"
    sql["quota_check"] = f"""WITH {ORGS}, {APIS}, p AS (SELECT id AS org_id, lower(coalesce(plan, 'free')) AS plan FROM orgs),
        l AS (SELECT *, CASE plan WHEN 'pro' THEN 8 WHEN 'free' THEN 1 WHEN 'business' THEN NULL
          WHEN 'trial' THEN 7 ELSE 1 END::bigint AS api_limit FROM p)
        SELECT l.org_id, plan, api_limit, count(apis.id) AS apis,
          api_limit IS NULL OR count(apis.id) < api_limit AS under_quota
        FROM l LEFT JOIN apis ON apis.org_id = l.org_id GROUP BY l.org_id, plan, api_limit"""

    # --- live state and timing
    state = f"""state AS (SELECT {K}, count(*) AS requests, count(*) FILTER (status BETWEEN 200 AND 499) AS successes,
        count(*) FILTER (status NOT BETWEEN 200 AND 499) AS errors, arg_max(latency_ms, seq) AS last_latency,
        arg_max(status, seq) AS last_status, arg_max(time, seq) AS last_seen,
        count(*) FILTER (status NOT BETWEEN 200 AND 499) / count(*)::double AS error_rate, avg(latency_ms) AS avg_latency
      FROM tel GROUP BY ALL HAVING last_seen >= {AS_OF} - INTERVAL 30 MINUTE)"""
    shown = f"{K}, requests, successes, errors, last_latency, last_status, last_seen, {R('error_rate')}, {R('avg_latency')}"
    sql["live_state"] = f"WITH {TEL}, {state} SELECT {shown} FROM state"
    sql["live_state_filtered"] = f"""WITH {TEL}, {state} SELECT {shown} FROM state
        WHERE method = 'GET' AND contains(lower(endpoint), 'er') ORDER BY last_seen DESC, requests DESC, {K} LIMIT 100"""
    sql["late_events"] = f"WITH {TEL} SELECT seq, time FROM tel WHERE time < {AS_OF} - INTERVAL 30 MINUTE"
    arrival = """arr AS (SELECT * REPLACE ((seq + CASE WHEN seq % 10 = 0 THEN 400 ELSE 0 END) * 2
        + CASE WHEN seq % 10 = 0 THEN 1 ELSE 0 END AS seq) FROM tel)"""
    seen = f"max(time) OVER (PARTITION BY {K} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sql["out_of_order"] = f"WITH {TEL}, {arrival} SELECT seq, coalesce(time < {seen}, false) AS out_of_order FROM arr"
    sql["skew_metrics"] = f"""WITH {TEL}, {arrival}, f AS (SELECT *, coalesce(time < {seen}, false) AS o FROM arr
          WHERE time >= {AS_OF} - INTERVAL 30 MINUTE)
        SELECT (SELECT count(*) FROM f) AS total_events_processed,
          (SELECT count(*) FROM arr WHERE time < {AS_OF} - INTERVAL 30 MINUTE) AS late_events_dropped,
          (SELECT count(*) FROM f WHERE o) AS out_of_order_events"""

    # --- serving features
    for name, columns in GROUPS.items():
        picked = ", ".join(c if c == "is_warmed_up" else R(c) for c in columns)
        sql[name] = f"WITH {TEL}, {FEAT} SELECT time, {K}, {picked} FROM feat"
    sql["predictions_scored"] = f"""WITH {TEL}, {FEAT}, s AS (SELECT *, {_RISK} AS risk_score FROM feat)
        SELECT time, {K}, {R('risk_score')}, {_label('risk_score')} AS prediction,
          {R('greatest(risk_score, 1 - risk_score)', 'confidence')}, {R('error_rate_ewm', 'stored_ewm')}, 25 AS stored_values,
          '1.0' AS model_version, '2.0' AS feature_schema_version, is_warmed_up FROM s"""

    sql["stream_features"] = sql["feature_vector"]
    sql["stream_live"] = f"WITH {TEL}, {state.split('HAVING')[0]}) SELECT {shown} FROM state"

    sql["pipeline_counters"] = f"""WITH {TEL}, {RAW}, {LENIENT}, e AS (SELECT reason, seq // 100 AS m, seq // 100 % 10 = 9 AS torn FROM lenient),
        c AS (SELECT count(*) AS events, count(DISTINCT m) AS messages, count(*) FILTER (NOT torn) AS decoded,
          count(*) FILTER (NOT torn AND reason IS NULL) AS stored, count(DISTINCT m) FILTER (torn) AS corrupt FROM e)
        SELECT unnest(['publish', 'publish', 'ingest', 'ingest', 'ingest', 'ingest', 'ingest', 'ingest', 'ingest']) AS job,
          unnest(['received', 'published', 'received', 'decoded', 'stored', 'late', 'invalid', 'corrupt', 'failed']) AS counter,
          unnest([events, messages, messages, decoded, stored, 0, decoded - stored + corrupt, corrupt, 0])::bigint AS value FROM c"""

    # --- predictions
    b = "round(risk_score * 0.5::double + 0.2::double, 9)"
    sql["predictions_upsert"] = f"""WITH {TEL}, {PRED}, n AS (SELECT *, {b} AS b FROM pred)
        SELECT date_trunc('minute', time) AS time, {K},
          {R('greatest(risk_score, round(1 - risk_score, 9), b)', 'risk_score')}, {_label('b')} AS prediction,
          {R('greatest(b, 1 - b)', 'confidence')}, is_warmed_up FROM n"""
    sql["predictions_latest"] = f"""WITH {TEL}, {PRED} SELECT org_id, time, api_id, endpoint, method, {R('risk_score')},
        prediction, {R('confidence')} FROM pred
        QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY time DESC, api_id, endpoint, method) <= 100"""
    groups = """g AS (SELECT api_id, endpoint, count(*) AS total_events, avg(risk_score) AS avg_risk,
        greatest(max(risk_score), 0) AS max_risk, avg(confidence) AS avg_confidence,
        count(*) FILTER (risk_score >= 0.8) AS critical_events,
        count(*) FILTER (risk_score >= 0.5 AND risk_score < 0.8) AS warning_events,
        count(*) FILTER (risk_score < 0.5) AS stable_events FROM pred GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY api_id, endpoint ORDER BY time DESC, org_id, method) AS rn FROM pred),
      l AS (SELECT api_id, endpoint, max(time) FILTER (rn = 1) AS latest_at, max(prediction) FILTER (rn = 1) AS latest_prediction,
          max(confidence) FILTER (rn = 1) AS latest_confidence, max(risk_score) FILTER (rn = 3) AS third_risk,
          string_agg(method, ',' ORDER BY rn) AS recent_methods FROM r WHERE rn <= 3 GROUP BY ALL)"""
    sql["prediction_groups"] = f"""WITH {TEL}, {PRED}, {groups} SELECT api_id, endpoint, total_events, {R('avg_risk')}, {R('max_risk')},
        {R('avg_confidence')}, critical_events, warning_events, stable_events, latest_at, latest_prediction,
        {R('latest_confidence')}, recent_methods, {R('third_risk')}, 3 AS n_features FROM g JOIN l USING (api_id, endpoint)"""
    sql["prediction_groups_warning"] = f"""WITH {TEL}, {PRED}, {groups} SELECT api_id, endpoint, total_events, {R('max_risk')}, latest_at
        FROM g JOIN l USING (api_id, endpoint) WHERE max_risk >= 0.5 AND max_risk < 0.8"""
    sql["prediction_group_totals"] = f"""WITH {TEL}, {PRED}, {groups} SELECT sum(total_events)::bigint AS total_signals,
        count(*) FILTER (max_risk >= 0.8) AS critical_groups, {R('avg(avg_risk)', 'average_risk')} FROM g"""
    sql["alerts"] = f"""WITH {TEL}, {PRED} SELECT {K}, {R('risk_score')}, prediction, 'high' AS severity,
        strftime(time, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp FROM pred WHERE risk_score >= 0.6"""
    sql["risk_bands"] = f"""WITH {TEL}, {PRED} SELECT org_id, prediction,
        CASE WHEN risk_score >= 0.8 THEN 'critical' WHEN risk_score >= 0.5 THEN 'warning' ELSE 'stable' END AS band,
        count(*) AS n FROM pred GROUP BY ALL"""
    sql["run_metrics"] = f"""WITH {TEL}, {PRED} SELECT count(*) AS predictions_written, {R('min(risk_score)', 'risk_score_min')},
        {R('max(risk_score)', 'risk_score_max')}, {R('avg(risk_score)', 'risk_score_avg')},
        count(*) FILTER (risk_score >= 0.6) AS above_threshold_count, count(*) FILTER (is_warmed_up) AS warmed_up_predictions,
        count(*) FILTER (NOT is_warmed_up) AS cold_start_predictions FROM pred"""
    sql["top_features_read"] = f"""WITH {TEL}, {PRED} SELECT time, {K}, 0 AS pos, 'error_rate' AS name,
          {R('error_rate', 'value')}, {R('error_rate', 'contribution')} FROM pred
        UNION ALL SELECT time, {K}, 1, 'unknown', {R('p95_latency', 'value')}, 0.0 FROM pred"""
    sql["relative_age"] = f"""WITH {TEL}, a AS (SELECT seq, (epoch_us(time) // 1000000 * 40 - 39 * 1704067200::bigint) * 1000
            - epoch_ms(TIMESTAMP '2024-01-03 00:30:00') AS d FROM tel)
        SELECT seq, CAST(floor(d / CASE WHEN abs(d) < 3600000 THEN 60000.0::double WHEN abs(d) < 86400000 THEN 3600000.0::double
            ELSE 86400000.0::double END + 0.5::double) AS BIGINT) AS age_amount,
          CASE WHEN abs(d) < 3600000 THEN 'minute' WHEN abs(d) < 86400000 THEN 'hour' ELSE 'day' END AS age_unit FROM a"""

    # --- a model as a node table
    sql["node_scores"] = f"""WITH RECURSIVE {TEL}, {MIN}, {NODES}, {WALK} SELECT time, {S}, {R('risk_score')},
        {_label('risk_score')} AS prediction, {R('greatest(risk_score, 1 - risk_score)', 'confidence')} FROM risk"""
    sql["node_contributions"] = f"""WITH RECURSIVE {TEL}, {MIN}, {NODES}, {SHAPLEY} SELECT time, {S}, {R('base_score')},
        {', '.join(R(f'by_{n}') for n in MODEL_FEATURES)}, CASE WHEN 1 / (1 + exp(-base_score - parts)) >= 0.65
          THEN [{', '.join(f"'{n}'" for n in MODEL_FEATURES)}][top + 1] END AS top_factor FROM wide, base"""

    # --- training features and quality
    for name, columns in TRAIN_GROUPS.items():
        sql[name] = _train(*columns)
    sql["minute_frame"] = f"""WITH {TEL}, {MIN} SELECT {S}, time, {R('p50_latency')}, {R('p90_latency')}, {R('p95_latency')},
        {R('latency_variance')}, {R('error_rate')}, {R('traffic_rps')}, label FROM m"""
    delta = f"""d AS (SELECT *, coalesce(p95_latency - lag(p95_latency) OVER w, 0) AS latency_delta,
        coalesce(error_rate - lag(error_rate) OVER w, 0) AS error_rate_delta,
        coalesce(traffic_rps - lag(traffic_rps) OVER w, 0) AS traffic_delta
      FROM m WINDOW w AS (PARTITION BY {S} ORDER BY time))"""
    sql["schema_minutes"] = f"""WITH {TEL}, {SCHEMA_MIN} SELECT {S}, time, schema_fields_added, schema_fields_removed,
        schema_breaking_changes, {R('schema_entropy')}, recent_deploy FROM sm"""
    wide = f"""{SCHEMA_MIN}, {delta}, f AS (SELECT *, coalesce(schema_entropy - lag(schema_entropy) OVER (PARTITION BY {S} ORDER BY time), 0)
        AS schema_entropy_delta FROM d JOIN sm USING ({S}, time))"""
    sql["deltas"] = f"""WITH {TEL}, {MIN}, {wide} SELECT time, {S}, {R('latency_delta')}, {R('error_rate_delta')},
        {R('traffic_delta')}, {R('schema_entropy_delta')} FROM f"""
    sql["csv_training"] = f"""WITH {TEL}, {MIN}, {SCHEMA_MIN}, {TRAIN} SELECT time, {S}, {R('schema_entropy')}, recent_deploy,
        {R('p95_latency_roll_mean_15')}, {R('p95_to_p50_ratio')}, {R('error_rate_ewm')}, {R('error_high_streak')}
        FROM train JOIN sm USING ({S}, time)"""
    sql["bfill"] = f"""WITH {TEL}, {MIN}, g AS (SELECT *, CASE WHEN label = 1 THEN p95_latency END AS g FROM m)
        SELECT time, {S}, round(first_value(g IGNORE NULLS) OVER (PARTITION BY {S} ORDER BY time
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS gappy FROM g"""
    sql["quantile_repair"] = f"""WITH {TEL}, {MIN}, a AS (SELECT *, greatest(p90_latency, p50_latency * 1.15::double) AS n90 FROM m)
        SELECT time, {S}, {R('p50_latency')}, {R('n90', 'p90_latency')},
          {R('greatest(p95_latency, n90 * 1.18::double)', 'p95_latency')} FROM a"""
    sql["anomaly_starts"] = f"""WITH {TEL}, {MIN} SELECT time, {S} FROM m
        QUALIFY label = 1 AND coalesce(lag(label) OVER (PARTITION BY {S} ORDER BY time), 0) <> 1"""
    sql["max_gap"] = f"""WITH {TEL}, {MIN}, r AS (SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY time) AS rn,
          count(*) OVER (PARTITION BY {S}) AS rows FROM m),
        g AS (SELECT {S}, rows, rn - lag(rn) OVER (PARTITION BY {S} ORDER BY time) AS gap FROM r WHERE label = 1)
        SELECT {S}, max(gap) AS max_gap, rows, max(gap) > rows * 0.1 AS clustered FROM g GROUP BY {S}, rows"""
    sql["chunk_distribution"] = f"""WITH {TEL}, {MIN}, r AS (SELECT label, row_number() OVER (ORDER BY time, {S}) AS rn,
          count(*) OVER () // 10 AS size FROM m), c AS (SELECT label, (rn - 1) // size + 1 AS chunk FROM r)
        SELECT chunk, sum(label)::bigint AS anomalies, count(*) AS rows FROM c WHERE chunk <= 10 GROUP BY chunk"""
    sql["label_distribution"] = f"""WITH {TEL}, {MIN} SELECT count(*) AS rows, count(*) FILTER (label = 0) AS normal,
        count(*) FILTER (label = 1) AS downtime, {R('avg(label) * 100', 'downtime_pct')},
        avg(label) * 100 BETWEEN 7 AND 12 AS in_band FROM m"""
    one = "SELECT label, '{0}' AS \"column\", {0}::double AS v FROM f"
    names = ["latency_delta", "error_rate_delta", "traffic_delta", "schema_entropy_delta"]
    names += ["schema_fields_added", "schema_fields_removed", "schema_breaking_changes", "recent_deploy"]
    sql["class_stats"] = f"""WITH {TEL}, {MIN}, {wide}, u AS ({' UNION ALL '.join(one.format(n) for n in names)})
        SELECT label, "column", {R('avg(v)', 'mean')}, {R('stddev_samp(v)', 'std')}, {R('max(v)', 'max')},
          {R('avg(CASE WHEN v <> 0 THEN 1.0::double ELSE 0.0::double END)', 'nonzero_share')} FROM u GROUP BY ALL"""
    sql["correlations"] = f"""WITH {TEL}, {MIN} """ + " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", {R(f'corr({n}, label)', 'correlation')} FROM m"
        for n in ("traffic_rps", "p95_latency", "error_rate")
    )
    sql["coupling"] = f"""WITH {TEL}, {MIN} SELECT {R('corr(traffic_rps, p50_latency)', 'correlation')},
        corr(traffic_rps, p50_latency) > 0.15 AS coupled FROM m"""
    sql["skew"] = f"WITH {TEL}, {MIN} SELECT {R('skewness(p95_latency)', 'skewness')} FROM m"
    sql["constant_columns"] = f"""WITH {TEL}, {MIN}, u AS (UNPIVOT (SELECT stddev_samp(p50_latency) AS p50_latency,
          stddev_samp(p90_latency) AS p90_latency, stddev_samp(p95_latency) AS p95_latency,
          stddev_samp(latency_variance) AS latency_variance, stddev_samp(error_rate) AS error_rate,
          stddev_samp(traffic_rps) AS traffic_rps, stddev_samp(label) AS label, stddev_samp(3) AS schema_fields FROM m)
          ON COLUMNS(*) INTO NAME "column" VALUE s) SELECT "column" FROM u WHERE s = 0"""
    sql["describe_frame"] = f"WITH {TEL}, {MIN} " + " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", count({n}) AS count, {R(f'avg({n})', 'mean')}, {R(f'stddev_samp({n})', 'std')},
        {R(f'min({n})', 'min')}, {R(f'max({n})', 'max')}, {R(f'quantile_cont({n}, 0.25)', 'q25')},
        {R(f'quantile_cont({n}, 0.5)', 'q50')}, {R(f'quantile_cont({n}, 0.75)', 'q75')} FROM m"""
        for n in ("p50_latency", "error_rate", "traffic_rps")
    )
    columns = "seq time org_id api_id endpoint method status latency_ms request_size response_size schema_hash props".split()
    sql["null_counts"] = f"WITH {TEL} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM tel" for c in columns
    ) + " UNION ALL SELECT 'schema_version', 0"
    sql["overview"] = f"WITH {TEL} SELECT count(*) AS rows, min(time) AS first_time, max(time) AS last_time FROM tel"

    # --- evaluation
    by_time = f"ORDER BY time, {K}"
    sql["chrono_split"] = f"""WITH {TEL}, {SCORED} SELECT time, {K}, CASE WHEN row_number() OVER ({by_time})
        <= floor(count(*) OVER () * 0.75) THEN 'train' ELSE 'test' END AS split FROM scored"""
    sql["cv_folds"] = f"""WITH {TEL}, {SCORED}, r AS (SELECT time, row_number() OVER ({by_time}) AS rn, count(*) OVER () AS n FROM scored),
        f AS (SELECT r.*, fold, n - (6 - fold) * (n // 6) AS start, n // 6 AS size FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS fold))
        SELECT fold, CASE WHEN rn <= start THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(time) AS first_time,
          max(time) AS last_time FROM f WHERE rn <= start + size GROUP BY ALL"""
    sweep = """c AS (SELECT i / 100.0::double AS threshold, count(*) FILTER (label = 1 AND score >= i / 100.0::double) AS tp,
          count(*) FILTER (label = 0 AND score >= i / 100.0::double) AS fp, count(*) FILTER (label = 1) AS p
        FROM scored, (SELECT unnest(range(5, 96)) AS i) GROUP BY i),
      pr AS (SELECT threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::double ELSE 0 END AS precision,
          CASE WHEN p > 0 THEN tp / p::double ELSE 0 END AS recall FROM c),
      sw AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
          CASE WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END AS f2 FROM pr)"""
    swept = f"{R('threshold')}, {R('precision')}, {R('recall')}, {R('f1')}, {R('f2')}"
    sql["threshold_sweep"] = f"WITH {TEL}, {SCORED}, {sweep} SELECT {swept} FROM sw"
    sql["best_threshold"] = f"""WITH {TEL}, {SCORED}, {sweep} SELECT {swept} FROM sw
        ORDER BY sw.precision >= 0.40 DESC, sw.f1 DESC, sw.precision DESC, sw.recall DESC, sw.threshold LIMIT 1"""
    sql["confusion"] = f"""WITH {TEL}, {SCORED} SELECT label, CASE WHEN score >= 0.4 THEN 1 ELSE 0 END AS predicted,
        count(*) AS n FROM scored GROUP BY ALL"""
    sql["roc_auc"] = f"""WITH {TEL}, {SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score)
          + (count(*) OVER (PARTITION BY score) - 1) / 2.0::double AS rk FROM scored)
        SELECT round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::double)
          / (count(*) FILTER (label = 1)::double * count(*) FILTER (label = 0)), 6) + 0.0 AS roc_auc FROM r"""
    by_fold = f"""r AS (SELECT *, row_number() OVER (ORDER BY time, {K}) AS rn, count(*) OVER () AS n FROM scored),
        f AS (SELECT fold, label, score FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS fold)
          WHERE rn > n - (6 - fold) * (n // 6) AND rn <= n - (6 - fold) * (n // 6) + n // 6),
        k AS (SELECT fold, label, rank() OVER (PARTITION BY fold ORDER BY score)
          + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0::double AS rk FROM f)"""
    sql["auc_by_fold"] = f"""WITH {TEL}, {SCORED}, {by_fold} SELECT fold,
        round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::double)
          / nullif(count(*) FILTER (label = 1)::double * count(*) FILTER (label = 0), 0), 6) + 0.0 AS roc_auc FROM k GROUP BY fold"""
    curve = """s AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY score),
      cv AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
        sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s)"""
    sql["avg_precision"] = f"""WITH {TEL}, {SCORED}, {curve} SELECT {R('sum(pos * (tp / (tp + fp)::double)) / max(p)', 'average_precision')} FROM cv"""
    sql["roc_points"] = f"""WITH {TEL}, {SCORED}, {curve} SELECT {R('score')}, {R('tp / p::double', 'tpr')}, {R('fp / n::double', 'fpr')},
        {R('tp / (tp + fp)::double', 'precision')} FROM cv"""
    sql["precision_at_k"] = f"""WITH {TEL}, {SCORED}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, time, {K}) AS rn,
          count(*) OVER () AS n FROM scored)
        SELECT share, max(greatest(1, CAST(floor(n * share) AS BIGINT))) AS k,
          {R('avg(label)', 'precision')} FROM r, (SELECT unnest([0.005, 0.01, 0.02]::double[]) AS share)
        WHERE rn <= greatest(1, CAST(floor(n * share) AS BIGINT)) GROUP BY share"""
    sql["calibration"] = f"""WITH {TEL}, {SCORED}, q AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM scored),
        b AS (SELECT score, label, len(list_filter(cuts, lambda c: c < score)) AS bin FROM scored, q)
        SELECT bin, count(*) AS n, {R('avg(score)', 'mean_score')}, {R('avg(label)', 'positive_rate')} FROM b GROUP BY bin"""
    sql["score_hist"] = f"""WITH {TEL}, {SCORED}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM scored)
        SELECT label, CAST(least(floor((score - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM scored, e GROUP BY ALL"""
    sql["backtest_tail"] = f"""WITH {TEL}, {SCORED} SELECT time, {K}, {R('score')}, label FROM scored
        ORDER BY time DESC, org_id DESC, api_id DESC, endpoint DESC, method DESC LIMIT 2000"""
    four = ["p50_latency", "p95_latency", "traffic_rps", "error_rate"]
    cut = "quantile_cont({0}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])"
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", len(list_filter((SELECT {cut.format(f'round({c}, 6)')} FROM scored),
          lambda q: q < round({c}, 6))) AS bin, label FROM scored"""
        for c in four
    )
    sql["mutual_info"] = f"""WITH {TEL}, {SCORED}, u AS ({parts}),
        c AS (SELECT "column", bin, label, count(*)::double AS n FROM u GROUP BY ALL),
        x AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS t, sum(n) OVER (PARTITION BY "column", bin) AS nb,
          sum(n) OVER (PARTITION BY "column", label) AS nl FROM c),
        mi AS (SELECT "column", greatest(0, sum(n / t * ln(n * t / (nb * nl)))) AS mutual_info FROM x GROUP BY "column")
        SELECT "column", {R('mutual_info')}, {R('mutual_info / sum(mutual_info) OVER ()', 'share')},
          mutual_info / sum(mutual_info) OVER () > 0.30 AS dominates FROM mi"""
    sql["edge_rates"] = f"""WITH {TEL}, {SCORED} SELECT {R('avg((score < 0.4)::int) FILTER (label = 0)', 'tn_rate')},
        {R('avg((score >= 0.4)::int) FILTER (label = 0)', 'fp_rate')}, {R('avg((score >= 0.4)::int) FILTER (label = 1)', 'tp_rate')},
        {R('avg((score < 0.4)::int) FILTER (label = 1)', 'fn_rate')}, {R('avg(((score >= 0.4)::int = label)::int)', 'accuracy')},
        {R('avg(score) FILTER (label = 0)', 'normal_avg_score')}, {R('avg(score) FILTER (label = 1)', 'downtime_avg_score')} FROM scored"""
    sql["risk_report"] = f"""WITH {TEL}, {SCORED} SELECT time, {K}, {R('score', 'risk_score', 4)},
        CASE WHEN score >= 0.4 THEN 'DOWNTIME' ELSE 'NORMAL' END AS prediction,
        {R('CASE WHEN score >= 0.4 THEN score ELSE 1 - score END', 'confidence', 4)}, label AS true_label FROM scored"""

    sql["risk_report_factors"] = f"""WITH RECURSIVE {TEL}, {MIN}, {NODES}, {SHAPLEY}, r AS (SELECT *, 1 / (1 + exp(-base_score - parts)) AS risk
          FROM wide JOIN m USING (time, {S}), base)
        SELECT time, {S}, {R('risk', 'risk_score', 4)}, CASE WHEN risk >= 0.4 THEN 'DOWNTIME' ELSE 'NORMAL' END AS prediction,
          {R('CASE WHEN risk >= 0.4 THEN risk ELSE 1 - risk END', 'confidence', 4)}, label AS true_label,
          {', '.join(R(f'by_{n}') for n in MODEL_FEATURES)} FROM r"""

    # --- inventory
    listed = "org_id, api_id, base_url, path, method, interval_seconds, timeout_ms, schema_version, max_backoff_seconds"
    sql["poll_targets"] = f"""WITH {APIS}, {EPS}, {TARGETS} SELECT name, endpoint_id, {listed},
        CASE WHEN has_headers THEN 2 ELSE 0 END::bigint AS n_headers FROM targets"""
    static = """st AS (SELECT '/status' AS name, '' AS endpoint_id, org_id, id AS api_id, base_url, '/status' AS path, 'POST' AS method,
        30 AS interval_seconds, 5000 AS timeout_ms, false AS has_headers, '' AS day, 'active-poll.v1' AS schema_version,
        300 AS max_backoff_seconds FROM apis)"""
    sql["static_targets"] = f"""WITH {APIS}, {static} SELECT name, endpoint_id, {listed}, '' AS body, '' AS client_region FROM st"""
    both = TARGETS.replace("targets AS", "stored AS", 1)
    sql["targets_merged"] = f"""WITH {APIS}, {EPS}, {both}, {static},
        targets AS (SELECT *, 1 AS pri FROM st UNION ALL BY NAME SELECT * REPLACE ('' AS endpoint_id), 0 AS pri FROM stored), {FP}
        SELECT target_key, schema_version, interval_seconds, timeout_ms, fingerprint FROM fp
        QUALIFY row_number() OVER (PARTITION BY target_key ORDER BY pri DESC, fingerprint DESC) = 1"""
    sql["fingerprints"] = f"WITH {APIS}, {EPS}, {TARGETS}, {FP} SELECT target_key, fingerprint FROM fp"
    sql["targets_reconcile"] = f"""WITH {APIS}, {EPS}, {TARGETS}, {FP} SELECT target_key,
        CASE WHEN method <> 'PUT' AND path = '/empty' THEN 'added' WHEN method = 'PUT' THEN 'removed'
             WHEN path = '/users' THEN 'changed' ELSE 'unchanged' END AS action
        FROM fp WHERE method <> 'PUT' OR path <> '/empty'"""
    sql["api_endpoint_counts"] = f"""WITH {APIS}, {EPS} SELECT a.id AS api_id, a.org_id, a.name, a.base_url, count(e.id) AS endpoints
        FROM apis a LEFT JOIN eps e ON e.api_id = a.id GROUP BY ALL"""
    sql["endpoints_per_api"] = f"""WITH {APIS}, {EPS} SELECT round((SELECT count(*) FROM eps)
        / greatest((SELECT count(*) FROM apis), 1)::double, 6) + 0.0 AS endpoints_per_api"""
    sql["api_tree"] = f"""WITH {APIS}, {EPS} SELECT a.id AS api_id, a.org_id,
        coalesce(string_agg(e.path || ' ' || e.method || ' ' || e.id, ';' ORDER BY e.path, e.method, e.id), '') AS endpoints
        FROM apis a LEFT JOIN eps e ON e.api_id = a.id GROUP BY a.id, a.org_id"""
    sql["inventory_search"] = f"""WITH {APIS} SELECT id, name, base_url FROM apis
        WHERE lower(name) LIKE '%api4%' OR lower(base_url) LIKE '%api4%'"""
    sql["endpoint_search"] = f"WITH {EPS} SELECT id, api_id, path, method FROM eps WHERE lower(path) LIKE '%items%'"
    sql["duplicate_endpoints"] = f"""WITH {EPS} SELECT id, api_id, path, method, definitions FROM (
        SELECT *, count(*) OVER (PARTITION BY api_id, path, method) AS definitions FROM eps) WHERE definitions > 1"""
    sql["org_members"] = """SELECT s_suppkey AS user_id, s_nationkey AS org_id,
        CASE WHEN s_acctbal > 5000 THEN 'owner' ELSE 'member' END AS role, lower(s_name) || '@example.com' AS email,
        s_name AS name, 'password' AS provider FROM supplier WHERE s_nationkey = 3"""

    # --- contracts
    sql["spec_operations"] = f"WITH {APIS}, {OPS} SELECT spec_id, path, method, schema_hash FROM ops"
    sql["new_endpoints"] = f"""WITH {APIS}, {EPS}, {OPS} SELECT org_id, api_id, path, method FROM ops o
        WHERE NOT EXISTS (SELECT 1 FROM eps e WHERE e.org_id = o.org_id AND e.api_id = o.api_id AND e.path = o.path AND e.method = o.method)"""
    sql["contract_sync"] = f"""WITH {APIS}, {EPS}, {OPS}, s AS (SELECT e.org_id, e.id AS endpoint_id, e.method, o.schema_hash, e.created_at
          FROM eps e LEFT JOIN ops o ON e.org_id = o.org_id AND e.api_id = o.api_id AND e.path = o.path AND e.method = o.method)
        SELECT org_id, endpoint_id, coalesce(schema_hash, 'old') AS schema_hash, created_at FROM s WHERE method <> 'POST'
        UNION ALL SELECT org_id, endpoint_id, schema_hash, TIMESTAMP '2024-01-01' FROM s WHERE method = 'POST' AND schema_hash IS NOT NULL"""
    sql["contract_sync_count"] = f"""WITH {APIS}, {EPS}, {OPS} SELECT o.org_id, o.api_id,
        count(e.id) FILTER (o.schema_hash IS NOT NULL) AS synced FROM ops o LEFT JOIN eps e ON e.org_id = o.org_id
          AND e.api_id = o.api_id AND e.path = o.path AND e.method = o.method GROUP BY ALL"""
    sql["path_match"] = f"WITH {TEL}, {OBS} SELECT seq, path, template, endpoint_id FROM hit WHERE rn = 1"
    sql["contract_verdict"] = f"""WITH {TEL}, {OBS}, v AS (SELECT obs.seq, obs.method, coalesce(template, obs.path) AS path, endpoint_id,
          CASE WHEN n < 5 THEN CASE n % 3 WHEN 0 THEN {_ITEM_HASH} WHEN 1 THEN {_LIST_HASH} ELSE {_STRING_HASH} END END AS contract_hash,
          CASE WHEN n < 5 THEN CASE k % 7 WHEN 0 THEN {_LIST_HASH} WHEN 1 THEN {_MIXED_HASH} WHEN 2 THEN {_NULL_HASH}
            WHEN 3 THEN {_STRING_HASH} ELSE {_ITEM_HASH} END END AS observed_hash
          FROM obs LEFT JOIN (SELECT * FROM hit WHERE rn = 1) h ON h.seq = obs.seq)
        SELECT seq, CASE WHEN contract_hash IS NULL THEN 'missing' WHEN contract_hash = observed_hash THEN 'valid' ELSE 'warning' END AS status,
          endpoint_id, path, method, contract_hash, observed_hash FROM v"""
    sql["canonical_hash"] = f"""WITH {TEL} SELECT seq, sha256('{{"k":' || k || '}}') AS hash, sha256('{{"k":' || k || '}}') AS dedup FROM tel"""
    # code points beyond printable ASCII as \\u escapes, those above 65535 as surrogate pairs
    escaped = r"""array_to_string(list_transform(regexp_extract_all(CAST(to_json(text) AS VARCHAR), '(?s).'), lambda c: CASE
        WHEN unicode(c) BETWEEN 32 AND 126 THEN c
        WHEN unicode(c) < 65536 THEN '\u' || printf('%04x', unicode(c))
        ELSE '\u' || printf('%04x', 55296 + (unicode(c) - 65536) // 1024) || '\u' || printf('%04x', 56320 + (unicode(c) - 65536) % 1024)
        END), '')"""
    sql["text_hash"] = f"""SELECT doc_id, sha256(concat('{{', concat_ws(',', '"a":' || n_chars, '"b":' || {escaped}), '}}')) AS hash,
        '{{"properties":{{' || concat_ws(',', CASE WHEN n_chars IS NOT NULL THEN '"a":{{"type":"integer"}}' END,
          CASE WHEN text IS NOT NULL THEN '"b":{{"type":"string"}}' END) || '}},"required":[' ||
          concat_ws(',', CASE WHEN n_chars IS NOT NULL THEN '"a"' END, CASE WHEN text IS NOT NULL THEN '"b"' END)
          || '],"type":"object"}}' AS shape FROM documents"""

    # --- urls
    clean = "regexp_replace(url_decode(replace(p, '+', '%2B')), '/$', '')"
    sql["url_origin"] = f"""WITH u AS ({_URL}) SELECT page_id, scheme, host, CASE scheme WHEN 'https' THEN 443 ELSE 80 END AS port,
        scheme || '://' || host AS origin, CASE WHEN {clean} = '' THEN '/' ELSE {clean} END AS path FROM u"""
    sql["path_normalise"] = f"""WITH u AS ({_URL}) SELECT page_id,
        CASE WHEN regexp_replace(p, '/+$', '') = '' THEN '/' ELSE regexp_replace(p, '/+$', '') END AS path,
        regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || CASE WHEN p LIKE '%/' THEN rtrim(p, '/') ELSE '' END || '/status'
          || regexp_extract(url, '^[^?#]*(.*)$', 1) AS joined FROM u"""
    sql["allowed_origin"] = f"""WITH {APIS}, asked AS (SELECT id AS api_id, org_id, CASE WHEN n % 4 = 0 THEN 'http' ELSE 'https' END AS scheme,
          'api' || (n % 50 + n % 2) || '.example.com' AS host,
          CASE WHEN n % 3 = 0 THEN 8443 WHEN n % 5 = 0 THEN 443 WHEN n % 4 = 0 THEN 80 ELSE 443 END AS port,
          CASE WHEN n % 4 = 0 THEN 'http' ELSE 'HTTPS' END || '://api' || (n % 50 + n % 2) || '.example.com'
            || CASE WHEN n % 3 = 0 THEN ':8443' WHEN n % 5 = 0 THEN ':443' ELSE '' END || '/x?y=1' AS url FROM apis),
        reg AS (SELECT org_id, 'api' || (n % 50) || '.example.com' AS host, CASE WHEN n % 3 = 0 THEN 8443 ELSE 443 END AS port FROM apis)
        SELECT api_id, url FROM asked x WHERE scheme = 'https'
          AND EXISTS (SELECT 1 FROM reg r WHERE r.org_id = x.org_id AND r.host = x.host AND r.port = x.port)"""
    sql["public_ip"] = f"""WITH {TEL}, o AS (SELECT seq, [10, 172, 192, 169, 8, 100, 198, 203, 224, 127, 0, 256][seq % 12 + 1] AS a,
          [16, 168, 254, 18, 0, 51, 31][k % 7 + 1] AS b, seq % 200 AS c, k AS d FROM tel)
        SELECT seq, a || '.' || b || '.' || c || '.' || d AS host, CASE WHEN a > 255 THEN NULL
          WHEN a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
            OR (a = 192 AND b = 0 AND c = 2) OR (a = 192 AND b = 0 AND c = 0 AND d NOT IN (9, 10)) OR (a = 198 AND b IN (18, 19))
            OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) THEN 'blocked' ELSE 'public' END AS ip_verdict FROM o"""

    # --- stored tables
    sql["delete_api"] = f"""WITH {TEL} SELECT seq, api_id FROM tel WHERE NOT (org_id = '00000000-0000-4000-8000-000000000001'
        AND api_id = '00000000-0000-4000-9000-000000000004')"""
    gone = "org_id = '00000000-0000-4000-8000-000000000001' AND api_id = '00000000-0000-4000-9000-000000000004'"
    sql["delete_api_stored"] = f"""WITH {TEL}, {PRED} SELECT count(*) FILTER ({gone}) AS telemetry,
        (SELECT count(*) FROM pred WHERE {gone}) AS predictions, count(*) FILTER (NOT ({gone})) AS "left" FROM tel"""
    sql["retention_stored"] = f"""WITH {TEL}, s AS (SELECT seq, make_timestamp((epoch_us(time) // 1000000 * 600
          - 599 * 1704067200::bigint) * 1000000)::date AS date FROM tel) SELECT seq, date FROM s WHERE date >= DATE '2024-01-11'"""
    sql["retention_90_days"] = "SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01' - INTERVAL 90 DAY"
    sql["purge_jobs"] = """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'queued' END AS status
        FROM orders WHERE o_orderstatus NOT IN ('F', 'P') OR o_orderdate >= TIMESTAMP '2000-06-01' - INTERVAL 30 DAY"""
    return sql


__all__ = ["oracle_sql", "SCHEMA_ITEM", "SCHEMA_LIST"]
