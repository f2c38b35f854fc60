"""Named queries over the test tables: each runs one operator (or a short chain) on whole tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.functions import jsontools, scalars, trees
from telemetra.functions.urls import join_url, normalise_path
from telemetra.operators import (
    aggregates,
    contracts,
    deadletters,
    evaluation,
    inventory,
    live,
    predictions,
    quality,
    retention,
    scoring,
    serving_features,
    tenants,
    timing,
    training_features,
    urls,
    validation,
)
from telemetra.plans.oracle import DIGITS
from telemetra.schemas import ENDPOINT_KEY, FEATURES, TOP_FEATURES
from telemetra.session import materialize, scratch_dir
from telemetra.sources import carrier, envelope, tables
from telemetra.streaming import run

AS_OF = carrier.AS_OF
SERIES = ["org_id", "endpoint"]
ORDER = ["time", *ENDPOINT_KEY]

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _registry[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_registry)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to the checked digits (and no negative zero), so engines can differ in the last bits."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}

    def value(c: str) -> str:
        return f"round(`{c}`, {DIGITS.get(c, DIGITS['*'])}) + 0D AS `{c}`" if c in doubles else f"`{c}`"

    return df.selectExpr(*map(value, df.columns))


# --- dashboard aggregates -------------------------------------------------------------------------


@query
def endpoint_stats(spark, sf):
    stats = aggregates.endpoint_stats(carrier.telemetry(spark, sf), None, AS_OF)
    return rounded(aggregates.with_alarm(stats))


@query
def tenant_summary(spark, sf):
    return rounded(aggregates.tenant_summary(carrier.telemetry(spark, sf), None, AS_OF))


@query
def kpi_strip(spark, sf):
    return rounded(aggregates.kpi_strip(aggregates.endpoint_stats(carrier.telemetry(spark, sf), None, AS_OF)))


@query
def health_label(spark, sf):
    stats = aggregates.endpoint_stats(carrier.telemetry(spark, sf), None, AS_OF)
    return aggregates.with_health(stats).select("org_id", "endpoint", "method", "health")


@query
def hourly_rollup(spark, sf):
    return rounded(aggregates.hourly_rollup(carrier.telemetry(spark, sf)))


@query
def outcome_flags(spark, sf):
    t = carrier.telemetry(spark, sf).withColumn("expected", F.when(F.col("seq") % 2 == 0, F.array(F.lit(200), F.lit(404))))
    return scalars.outcome_flags(t, "expected").select("seq", "is_server_error", "is_live_error", "is_poll_ok")


# --- validation and dead letters --------------------------------------------------------------------


@query
def validate_strict(spark, sf):
    checked = validation.validate_strict(carrier.raw_events(spark, sf))
    return checked.select("seq", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query
def validate_lenient(spark, sf):
    checked = validation.validate_lenient(carrier.raw_events(spark, sf))
    return checked.select(
        "seq", "method", "request_size_bytes", "response_size_bytes", F.coalesce("reason", F.lit("ok")).alias("reason")
    )


@query
def request_reject(spark, sf):
    verdicts = validation.batch_verdicts(carrier.raw_events(spark, sf))
    return verdicts.select("batch_id", "events", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query
def accepted_requests(spark, sf):
    ok, _ = validation.reject_batches(carrier.raw_events(spark, sf))
    return validation.to_telemetry(ok).select("seq", "org_id", "status", "request_size")


@query
def single_org_batches(spark, sf):
    # every second request is split by organisation, the others stay mixed
    raw = carrier.raw_events(spark, sf)
    part = F.when(F.col("batch_id") % 2 == 0, F.coalesce(F.right("org_id", F.lit(1)).try_cast("int"), F.lit(0)) + 1).otherwise(0)
    verdicts = validation.batch_verdicts(raw.withColumn("batch_id", F.col("batch_id") * 10 + part))
    return verdicts.select("batch_id", "events", "single_org")


def _envelopes(spark, sf):
    raw = carrier.raw_events(spark, sf).drop("batch_id", "pos")
    return envelope.publish_batches(raw, "seq")


@query
def decoded_messages(spark, sf):
    ok, _ = envelope.decode_messages(_envelopes(spark, sf))
    events = validation.to_telemetry(ok.withColumn("seq", F.col("offset") * envelope.BATCH_EVENTS + F.col("pos")))
    return events.select("seq", "org_id", "endpoint", "method", "status", "latency_ms", "request_size", "schema_hash")


@query
def dlq_records(spark, sf):
    _, bad = envelope.decode_messages(_envelopes(spark, sf))
    records = deadletters.dlq_invalid(bad.withColumn("payload", F.col("pos").cast("string")))
    return records.select("topic", "schema", "source_offset", "failure_reason", F.col("original_payload").alias("pos"))


@query
def dlq_processing(spark, sf):
    t = carrier.telemetry(spark, sf)
    message = t.select(
        F.lit("telemetry.raw").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("seq").alias("offset"),
        F.encode("props", "utf-8").alias("value"),
    )
    return deadletters.dlq_processing(message, "telemetry write failed")


@query
def stream_lag(spark, sf):
    t = carrier.telemetry(spark, sf)
    part = F.col("seq") % 8
    consumed = t.filter(F.col("status") < 500).select(
        F.lit("telemetry.raw").alias("topic"), part.cast("int").alias("partition"), F.expr("seq div 8").alias("offset")
    )
    ends = t.groupBy(part.cast("int").alias("partition")).agg(F.max(F.expr("seq div 8") + 3).alias("high"))
    return envelope.lag_by_partition(consumed, ends.withColumn("topic", F.lit("telemetry.raw")))


# --- tenants ----------------------------------------------------------------------------------------


def _paying(spark, sf):
    return carrier.organizations(spark, sf).filter(F.lower("plan").isin("pro", "business"))


@query
def known_orgs(spark, sf):
    ok, _ = tenants.known_orgs(carrier.telemetry(spark, sf), _paying(spark, sf))
    return ok.select("seq", "org_id")


@query
def unknown_orgs(spark, sf):
    _, bad = tenants.known_orgs(carrier.telemetry(spark, sf), _paying(spark, sf))
    return bad.select("seq", "org_id")


@query
def quota_check(spark, sf):
    return tenants.quota_status(carrier.organizations(spark, sf), carrier.apis(spark, sf), carrier.flags(spark, sf))


# --- live state and timing --------------------------------------------------------------------------


@query
def live_state(spark, sf):
    return rounded(live.live_state(carrier.telemetry(spark, sf), AS_OF, 30))


@query
def live_state_filtered(spark, sf):
    state = live.live_state(carrier.telemetry(spark, sf), AS_OF, 30)
    return rounded(live.list_live(state, method=" get ", contains="ER"))


@query
def late_events(spark, sf):
    _, late = timing.drop_late(carrier.telemetry(spark, sf), AS_OF)
    return late.select("seq", "time")


def _shuffled_arrival(spark, sf):
    """Arrival differs from time order: events of every tenth number arrive a while later."""
    t = carrier.telemetry(spark, sf)
    delay = F.when(F.col("seq") % 10 == 0, 400).otherwise(0)
    return t.withColumn("seq", (F.col("seq") + delay) * 2 + F.when(delay > 0, 1).otherwise(0))


@query
def out_of_order(spark, sf):
    flagged = timing.flag_out_of_order(_shuffled_arrival(spark, sf), block=4096)
    return flagged.select("seq", "out_of_order")


@query
def skew_metrics(spark, sf):
    return timing.skew_metrics(_shuffled_arrival(spark, sf), AS_OF)


# --- serving features -------------------------------------------------------------------------------


def _ticks(spark, sf):
    return serving_features.serving_features(carrier.telemetry(spark, sf))


def _features(*names: str) -> Query:
    def run(spark, sf):
        return rounded(_ticks(spark, sf).select("time", *ENDPOINT_KEY, *names))

    return run


GROUPS = {
    "features_latency": ["p50_latency", "p90_latency", "p95_latency", "latency_variance", "latency_delta", "p95_to_p50_ratio"],
    "features_error_traffic": ["error_rate", "error_rate_delta", "traffic_rps", "traffic_delta"],
    "features_schema": [
        "schema_fields_added",
        "schema_fields_removed",
        "schema_breaking_changes",
        "schema_entropy",
        "schema_entropy_delta",
        "recent_deploy",
    ],
    "features_history": [
        "p95_latency_roll_mean_15",
        "latency_variance_roll_std_15",
        "error_rate_roll_mean_15",
        "error_rate_acceleration",
        "traffic_utilization_proxy",
        "latency_p95_zscore",
        "p95_latency_roll_max_15",
    ],
    "feature_ewm": ["error_rate_ewm"],
    "feature_streak": ["error_high_streak"],
    "warmup": ["is_warmed_up"],
    "feature_vector": [*FEATURES, "latency_mean", "latency_p95", "is_warmed_up"],
}
for _name, _columns in GROUPS.items():
    _registry[_name] = _features(*_columns)


def fixture_risk(df):
    """Stand-in scorer for checks that need the same risk in every engine."""
    risk = F.lit(0.6) * F.col("error_rate") + F.lit(0.4) * F.least(F.col("p95_latency") / 400.0, F.lit(1.0))
    return df.withColumn("risk_score", F.round(F.least(F.lit(1.0), risk), 9))


@query
def predictions_scored(spark, sf):
    scored = predictions.label_risk(fixture_risk(_ticks(spark, sf)))
    rows = predictions.prediction_rows(scored)
    return rounded(
        rows.select(
            "time",
            *ENDPOINT_KEY,
            "risk_score",
            "prediction",
            "confidence",
            F.col("feature_values")["error_rate_ewm"].alias("stored_ewm"),
            F.size("feature_values").alias("stored_values"),
            "model_version",
            "feature_schema_version",
            "is_warmed_up",
        )
    )


# --- predictions ------------------------------------------------------------------------------------


def minute_predictions(spark, sf):
    """Predictions at minute grain from plain minute statistics, 17 seconds into the minute."""
    m = training_features.minute_frame(carrier.telemetry(spark, sf), ENDPOINT_KEY)
    scored = predictions.label_risk(fixture_risk(m)).withColumn("time", F.col("time") + F.expr("interval 17 seconds"))
    raw = F.array(
        F.struct(
            F.lit("error_rate").alias("feature"),
            F.when(F.col("method") == "GET", "error_rate").otherwise(" ").alias("name"),
            F.when(F.col("method") == "GET", F.col("error_rate")).alias("value"),
            (F.lit(0.0) - F.col("error_rate")).alias("contribution"),
            F.col("error_rate").alias("abs_contribution"),
        ),
        F.struct(
            F.lit(None).alias("feature"),
            F.lit(None).alias("name"),
            F.col("p95_latency").alias("value"),
            F.lit(None).cast("double").alias("contribution"),
            F.lit(0.0).alias("abs_contribution"),
        ),
        F.lit(None),
    ).cast(TOP_FEATURES)
    return scored.withColumn("top_features", raw).withColumn("is_warmed_up", F.col("traffic_rps") * 60 >= 3)


@query
def predictions_upsert(spark, sf):
    """Two writes of the prediction store, the second with two rows a key, merged when read."""
    path = f"{scratch_dir(spark)}/predictions-{uuid.uuid4().hex}"
    scored = materialize(predictions.prediction_rows(minute_predictions(spark, sf)), "scored")
    tables.upsert_predictions(scored.withColumn("seq", F.lit(1)), path, version=0)
    shift = scored.withColumn("risk_score", F.round(1 - F.col("risk_score"), 9)).withColumn("seq", F.lit(7))
    last = scored.withColumn("risk_score", F.round(F.col("risk_score") * 0.5 + 0.2, 9)).withColumn("seq", F.lit(8))
    relabel = predictions.label_risk
    tables.upsert_predictions(relabel(shift).unionByName(relabel(last)).select(*scored.columns, "seq"), path, version=1)
    merged = tables.read_predictions(spark, path)
    return rounded(merged.select("time", *ENDPOINT_KEY, "risk_score", "prediction", "confidence", "is_warmed_up"))


@query
def predictions_latest(spark, sf):
    return rounded(predictions.latest_predictions(minute_predictions(spark, sf).drop("top_features"), None, 500))


@query
def prediction_groups(spark, sf):
    g = predictions.prediction_groups(minute_predictions(spark, sf))
    return rounded(
        g.withColumn("recent_methods", F.array_join(F.transform("recent_events", lambda e: e["method"]), ","))
        .withColumn("third_risk", F.get("recent_events", F.lit(2))["risk_score"])
        .withColumn("n_features", F.size("top_features"))
        .drop("recent_events", "top_features")
    )


@query
def prediction_groups_warning(spark, sf):
    g = predictions.prediction_groups(minute_predictions(spark, sf).drop("top_features"), "warning")
    return rounded(predictions.sort_groups(g).select("api_id", "endpoint", "total_events", "max_risk", "latest_at"))


@query
def prediction_group_totals(spark, sf):
    return rounded(predictions.group_totals(predictions.prediction_groups(minute_predictions(spark, sf).drop("top_features"))))


@query
def alerts(spark, sf):
    return rounded(predictions.alerts(minute_predictions(spark, sf), 0.6))


@query
def risk_bands(spark, sf):
    p = predictions.with_band(minute_predictions(spark, sf))
    return p.groupBy("org_id", "prediction", "band").agg(F.count(F.lit(1)).alias("n"))


@query
def run_metrics(spark, sf):
    return rounded(predictions.run_metrics(minute_predictions(spark, sf), 0.6))


@query
def top_features_read(spark, sf):
    p = minute_predictions(spark, sf).withColumn("items", predictions.normalise_top_features())
    return rounded(
        p.select("time", *ENDPOINT_KEY, F.posexplode("items").alias("pos", "i")).select("time", *ENDPOINT_KEY, "pos", "i.*")
    )


@query
def relative_age(spark, sf):
    as_of = dt.datetime(2024, 1, 3, 0, 30)
    t = carrier.telemetry(spark, sf)
    # spread over two days so that all three units occur
    spread = t.withColumn("time", F.timestamp_seconds(F.unix_seconds(F.col("time").cast("timestamp")) * 40 - 39 * 1704067200).cast("timestamp_ntz"))
    return predictions.with_age(spread, as_of).select("seq", "age_amount", "age_unit")


# --- training features and quality ------------------------------------------------------------------


def _minutes(spark, sf):
    return training_features.minute_frame(carrier.telemetry(spark, sf), SERIES, 0.25)


def _train_columns(*names: str) -> Query:
    def run(spark, sf):
        t = training_features.training_features(_minutes(spark, sf), SERIES)
        return rounded(t.select("time", *SERIES, *names))

    return run


TRAIN_GROUPS = {
    "train_rolling": [
        "p95_latency_roll_mean_15",
        "latency_variance_roll_std_15",
        "error_rate_roll_mean_15",
        "traffic_utilization_proxy",
        "p95_latency_roll_max_15",
        "latency_p95_zscore",
    ],
    "train_lagged": ["error_rate_acceleration", "p95_to_p50_ratio"],
    "train_ewm": ["error_rate_ewm"],
    "train_streak": ["error_high_streak"],
}
for _name, _columns in TRAIN_GROUPS.items():
    _registry[_name] = _train_columns(*_columns)


@query
def minute_frame(spark, sf):
    return rounded(_minutes(spark, sf))


def _full_minutes(spark, sf):
    return training_features.full_minute_frame(carrier.telemetry(spark, sf), SERIES, 0.25)


@query
def schema_minutes(spark, sf):
    return rounded(training_features.schema_minutes(carrier.telemetry(spark, sf), SERIES))


DELTAS = ["latency_delta", "error_rate_delta", "traffic_delta", "schema_entropy_delta"]


@query
def deltas(spark, sf):
    return rounded(_full_minutes(spark, sf).select("time", *SERIES, *DELTAS))


@query
def csv_training(spark, sf):
    """Training features of minutes that went through CSV files, a folder a series."""
    path = f"{scratch_dir(spark)}/minutes-{uuid.uuid4().hex}"
    tables.write_training_csv(_full_minutes(spark, sf), path, SERIES)
    frame, series = tables.read_training_csv(spark, path)
    made = training_features.training_features(frame, series)
    names = ["p95_latency_roll_mean_15", "p95_to_p50_ratio", "error_rate_ewm", "error_high_streak"]
    return rounded(made.select(F.col("time").cast("timestamp_ntz").alias("time"), *SERIES, "schema_entropy", "recent_deploy", *names))


@query
def bfill(spark, sf):
    m = _minutes(spark, sf).withColumn("gappy", F.when(F.col("label") == 1, F.col("p95_latency")))
    return rounded(training_features.backfill(m, ["gappy"], SERIES).select("time", *SERIES, "gappy"))


@query
def quantile_repair(spark, sf):
    m = training_features.repair_quantiles(_minutes(spark, sf))
    return rounded(m.select("time", *SERIES, "p50_latency", "p90_latency", "p95_latency"))


@query
def anomaly_starts(spark, sf):
    return quality.anomaly_starts(_minutes(spark, sf), SERIES).select("time", *SERIES)


@query
def max_gap(spark, sf):
    return quality.max_gap(_minutes(spark, sf), SERIES)


@query
def chunk_distribution(spark, sf):
    return quality.chunk_distribution(_minutes(spark, sf), ["time", *SERIES])


@query
def label_distribution(spark, sf):
    return rounded(quality.label_distribution(_minutes(spark, sf)))


@query
def class_stats(spark, sf):
    schema = ["schema_fields_added", "schema_fields_removed", "schema_breaking_changes", "recent_deploy"]
    return rounded(quality.class_stats(_full_minutes(spark, sf), [*DELTAS, *schema]))


@query
def correlations(spark, sf):
    return rounded(quality.correlations(_minutes(spark, sf), ["traffic_rps", "p95_latency", "error_rate"]))


@query
def coupling(spark, sf):
    return rounded(quality.coupling(_minutes(spark, sf)))


@query
def skew(spark, sf):
    return rounded(quality.skewness_corrected(_minutes(spark, sf), "p95_latency"))


@query
def constant_columns(spark, sf):
    m = _minutes(spark, sf).withColumn("schema_fields", F.lit(3)).withColumn("window_duration_minutes", F.lit(1))
    return quality.constant_columns(m)


@query
def describe_frame(spark, sf):
    return rounded(quality.describe(_minutes(spark, sf), ["p50_latency", "error_rate", "traffic_rps"]))


@query
def null_counts(spark, sf):
    return quality.null_counts(carrier.telemetry(spark, sf))


@query
def overview(spark, sf):
    return quality.overview(carrier.telemetry(spark, sf))


# --- evaluation -------------------------------------------------------------------------------------


def scored_minutes(spark, sf):
    """Labelled minute rows per endpoint key with a score that is informative but not perfect."""
    m = training_features.minute_frame(carrier.telemetry(spark, sf), ENDPOINT_KEY, 0.25)
    score = F.lit(0.7) * F.least(F.col("p95_latency") / 250.0, F.lit(1.0)) + F.lit(0.3) * F.least(F.col("error_rate") * 1.5, F.lit(1.0))
    return m.withColumn("score", F.round(score, 4))


@query
def chrono_split(spark, sf):
    return evaluation.chrono_split(scored_minutes(spark, sf), ORDER).select(*ORDER, "split")


@query
def cv_folds(spark, sf):
    return evaluation.cv_folds(scored_minutes(spark, sf), ORDER).groupBy("fold", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time")
    )


@query
def threshold_sweep(spark, sf):
    return rounded(evaluation.threshold_sweep(scored_minutes(spark, sf)))


@query
def best_threshold(spark, sf):
    return rounded(evaluation.best_threshold(evaluation.threshold_sweep(scored_minutes(spark, sf))))


@query
def confusion(spark, sf):
    return evaluation.confusion(scored_minutes(spark, sf), 0.4)


@query
def roc_auc(spark, sf):
    return rounded(evaluation.roc_auc(scored_minutes(spark, sf)))


@query
def auc_by_fold(spark, sf):
    """The area of each forward-chaining test block, from one ranking."""
    folds = evaluation.cv_folds(scored_minutes(spark, sf), ORDER).filter("part = 'test'")
    return rounded(evaluation.roc_auc(folds, ["fold"]))


@query
def avg_precision(spark, sf):
    return rounded(evaluation.average_precision(scored_minutes(spark, sf)))


@query
def roc_points(spark, sf):
    return rounded(evaluation.roc_points(scored_minutes(spark, sf)))


@query
def precision_at_k(spark, sf):
    return rounded(evaluation.precision_at(scored_minutes(spark, sf), ORDER))


@query
def calibration(spark, sf):
    return rounded(evaluation.calibration(scored_minutes(spark, sf)))


@query
def score_hist(spark, sf):
    return evaluation.score_histogram(scored_minutes(spark, sf))


@query
def backtest_tail(spark, sf):
    return rounded(evaluation.backtest_tail(scored_minutes(spark, sf), ORDER).select(*ORDER, "score", "label"))


@query
def mutual_info(spark, sf):
    # rounded first: a cut between equal values must not split them by their last bit
    return rounded(evaluation.mutual_information(rounded(scored_minutes(spark, sf)), ["p50_latency", "p95_latency", "traffic_rps", "error_rate"]))


@query
def edge_rates(spark, sf):
    s = scored_minutes(spark, sf)
    return rounded(evaluation.edge_rates(s.filter("label = 0"), s.filter("label = 1"), 0.4))


def _model(spark, sf):
    """(features with label, model, feature names): a short training run on the first three quarters."""
    m = training_features.minute_frame(carrier.telemetry(spark, sf), SERIES, 0.25)
    names = ["p50_latency", "p90_latency", "p95_latency", "traffic_rps", "error_rate_ewm", "error_rate_roll_mean_15", "error_high_streak"]
    frame = materialize(training_features.training_features(m, SERIES), "frame")
    split = materialize(evaluation.chrono_split(frame, ["time", *SERIES]), "split")
    return split, scoring.train(split.filter("split = 'train'"), names, rounds=10, depth=4, rate=0.1), names


@query
def gbt_scores(spark, sf):
    split, model, names = _model(spark, sf)
    return scoring.with_risk(split.filter("split = 'test'"), model, names).select(
        "time", *SERIES, "label", "risk_score", "prediction", "confidence"
    )


@query
def tree_contributions(spark, sf):
    split, model, names = _model(spark, sf)
    path = f"{scratch_dir(spark)}/trees-{uuid.uuid4().hex}"
    scoring.tree_model(model).write().overwrite().save(path)
    rows = split.withColumn("is_warmed_up", F.lit(True))
    scored = scoring.score(rows, model, names, path, explain_min_risk=0.5)
    return scored.select("time", *SERIES, "risk_score", F.posexplode("top_features").alias("rank", "f")).select(
        "time", *SERIES, "risk_score", "rank", "f.name", "f.value", "f.contribution"
    )


def _node_rows(spark, sf):
    """A small fixed model as a node table, and the minutes it is applied to."""
    minutes = training_features.minute_frame(carrier.telemetry(spark, sf), SERIES, 0.25)
    return minutes.select("time", *SERIES, *carrier.MODEL_FEATURES), carrier.model_nodes(spark)


@query
def node_scores(spark, sf):
    """Risk, label and confidence from a node table, one join a level."""
    minutes, nodes = _node_rows(spark, sf)
    walked = trees.margins(minutes, ["time", *SERIES], nodes, carrier.MODEL_FEATURES)
    risk = walked.select("time", *SERIES, (1 / (1 + F.exp(-F.col("margin")))).alias("risk_score"))
    return rounded(predictions.label_risk(risk))


@query
def node_contributions(spark, sf):
    """Every feature's part in the score, and the strongest factor of rows at or above the gate."""
    minutes, nodes = _node_rows(spark, sf)
    order = list(carrier.MODEL_FEATURES)
    parts = trees.explain_nodes(minutes, nodes, order)
    risk = 1 / (1 + F.exp(-F.aggregate("contributions", F.col("base_score"), lambda a, c: a + c)))
    top = scoring.top_features(order, 1)[0]["name"]
    return rounded(
        parts.select(
            "time", *SERIES, "base_score", *[F.col("contributions")[i].alias(f"by_{n}") for i, n in enumerate(order)],
            F.when(risk >= scoring.EXPLAIN_MIN_RISK, top).alias("top_factor"),
        )
    )


@query
def risk_report(spark, sf):
    s = scored_minutes(spark, sf).withColumnRenamed("score", "risk_score")
    return rounded(scoring.risk_report(s, 0.4))


@query
def risk_report_factors(spark, sf):
    """Report rows of a node table's scores with the strongest factors and their parts."""
    minutes = _minutes(spark, sf).select("time", *SERIES, *carrier.MODEL_FEATURES, "label")
    order = list(carrier.MODEL_FEATURES)
    parts = trees.explain_nodes(minutes, carrier.model_nodes(spark), order)
    risk = 1 / (1 + F.exp(-F.aggregate("contributions", F.col("base_score"), lambda a, c: a + c)))
    report = scoring.risk_report(parts.withColumns({"risk_score": risk, "top_features": scoring.top_features(order, 5)}), 0.4)

    def part(name: str):
        return F.get(F.filter("top_features", lambda x: x["name"] == name), F.lit(0))["contribution"].alias(f"by_{name}")

    return rounded(report.select("time", *SERIES, "risk_score", "prediction", "confidence", "true_label", *map(part, order)))


# --- inventory --------------------------------------------------------------------------------------


@query
def poll_targets(spark, sf):
    t = inventory.poll_targets(carrier.endpoints(spark, sf), carrier.apis(spark, sf))
    return t.withColumn("n_headers", F.size("headers").cast("bigint")).drop("headers", "body", "client_region")


def _static(spark, sf):
    """Every api's status page as a configured target, one JSON array per api."""
    a = carrier.apis(spark, sf)
    item = F.struct(
        F.lit(" ").alias("name"),
        "org_id",
        F.col("id").alias("api_id"),
        "base_url",
        F.lit(" /status ").alias("path"),
        F.lit("post").alias("method"),
        F.lit(0).alias("interval_seconds"),
    )
    return inventory.static_targets(a.select(F.to_json(F.array(item)).alias("targets")))


def _stored_by_path(spark, sf):
    return inventory.poll_targets(carrier.endpoints(spark, sf), carrier.apis(spark, sf)).withColumn("endpoint_id", F.lit(""))


@query
def static_targets(spark, sf):
    return _static(spark, sf).drop("headers")


@query
def targets_merged(spark, sf):
    merged = inventory.merge_targets(_static(spark, sf), _stored_by_path(spark, sf))
    return merged.select("target_key", "schema_version", "interval_seconds", "timeout_ms", "fingerprint")


@query
def fingerprints(spark, sf):
    t = inventory.poll_targets(carrier.endpoints(spark, sf), carrier.apis(spark, sf))
    return inventory.fingerprint(t).select("target_key", "fingerprint")


@query
def targets_reconcile(spark, sf):
    t = materialize(inventory.poll_targets(carrier.endpoints(spark, sf), carrier.apis(spark, sf)), "targets")  # both sides read it
    desired = t.filter(F.col("method") != "PUT")
    changed = F.when(F.col("path") == "/users", F.col("timeout_ms") + 1).otherwise(F.col("timeout_ms"))
    active = t.filter(F.col("path") != "/empty").withColumn("timeout_ms", changed)
    return inventory.reconcile(desired, active)


@query
def api_endpoint_counts(spark, sf):
    return inventory.api_endpoint_counts(carrier.apis(spark, sf), carrier.endpoints(spark, sf))


@query
def endpoints_per_api(spark, sf):
    return rounded(inventory.endpoints_per_api(carrier.apis(spark, sf), carrier.endpoints(spark, sf)))


@query
def api_tree(spark, sf):
    tree = inventory.api_tree(carrier.apis(spark, sf), carrier.endpoints(spark, sf))
    flat = F.transform("endpoints", lambda e: F.concat_ws(" ", e["path"], e["method"], e["endpoint_id"]))
    return tree.select("api_id", "org_id", F.array_join(flat, ";").alias("endpoints"))


@query
def inventory_search(spark, sf):
    return inventory.search(carrier.apis(spark, sf), "API4").select("id", "name", "base_url")


@query
def endpoint_search(spark, sf):
    return inventory.search(carrier.endpoints(spark, sf), "ITEMS", ["path"]).select("id", "api_id", "path", "method")


@query
def duplicate_endpoints(spark, sf):
    return inventory.duplicate_endpoints(carrier.endpoints(spark, sf))


@query
def org_members(spark, sf):
    """Members per organisation size: suppliers as users, their nation as the organisation."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    users = s.select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lower("s_name"), F.lit("@example.com")).alias("email"),
        F.col("s_name").alias("name"),
        F.lit("password").alias("provider"),
    )
    role = F.when(F.col("s_acctbal") > 5000, "owner").otherwise("member")
    links = s.select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("org_id"), role.alias("role"))
    return inventory.members(links, users, 3)


# --- contracts --------------------------------------------------------------------------------------


@query
def spec_operations(spark, sf):
    return contracts.spec_operations(carrier.specs(spark, sf)).select("spec_id", "path", "method", "schema_hash")


@query
def new_endpoints(spark, sf):
    return contracts.new_endpoints(contracts.spec_operations(carrier.specs(spark, sf)), carrier.endpoints(spark, sf))


def _stored_contracts(spark, sf):
    e = carrier.endpoints(spark, sf)
    return e.filter(F.col("method") != "POST").select(
        "org_id", F.col("id").alias("endpoint_id"), F.lit("old").alias("schema_hash"), "created_at"
    )


@query
def contract_sync(spark, sf):
    ops = contracts.spec_operations(carrier.specs(spark, sf))
    return contracts.sync_contracts(ops, carrier.endpoints(spark, sf), _stored_contracts(spark, sf), dt.datetime(2024, 1, 1))


@query
def contract_sync_count(spark, sf):
    return contracts.synced_counts(contracts.spec_operations(carrier.specs(spark, sf)), carrier.endpoints(spark, sf))


@query
def path_match(spark, sf):
    o = carrier.observed(spark, sf)
    seen = o.select("seq", "org_id", F.upper("method").alias("method"), normalise_path("url").alias("path"))
    best = contracts.match_paths(seen, carrier.observed_endpoints(spark, sf))
    return seen.join(best, ["org_id", "method", "path"]).select("seq", "path", "template", "endpoint_id")


@query
def contract_verdict(spark, sf):
    out = contracts.contract_verdict(
        carrier.observed(spark, sf), carrier.observed_endpoints(spark, sf), carrier.observed_contracts(spark, sf)
    )
    return out.select("seq", "status", "endpoint_id", "path", "method", "contract_hash", "observed_hash")


@query
def canonical_hash(spark, sf):
    t = carrier.telemetry(spark, sf)
    return t.select("seq", jsontools.canonical_hash("props").alias("hash"), jsontools.dedup_key("props").alias("dedup"))


@query
def text_hash(spark, sf):
    """Canonical hash of whole document texts as JSON: non-ASCII text is escaped before hashing."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    quoted = F.to_json(F.struct(F.col("text").alias("b"), F.col("n_chars").alias("a")))
    return d.select("doc_id", jsontools.canonical_hash(quoted).alias("hash"), jsontools.shape_json(quoted).alias("shape"))


# --- urls -------------------------------------------------------------------------------------------


@query
def url_origin(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    return urls.with_origin(p, "url").select("page_id", "scheme", "host", "port", "origin", "path")


@query
def path_normalise(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    return p.select(
        "page_id", normalise_path("url").alias("path"), join_url("url", F.lit("status ")).alias("joined")
    )


@query
def allowed_origin(spark, sf):
    a = carrier.apis(spark, sf)
    n = F.substring("id", -6, 6).cast("int")
    asked = a.select(
        F.col("id").alias("api_id"),
        "org_id",
        F.concat(
            F.when(n % 4 == 0, "http").otherwise("HTTPS"), F.lit("://api"), (n % 50 + n % 2).cast("string"), F.lit(".example.com"),
            F.when(n % 3 == 0, ":8443").when(n % 5 == 0, ":443").otherwise(""), F.lit("/x?y=1"),
        ).alias("url"),
    )
    return urls.allowed_targets(asked, a).select("api_id", "url")


@query
def public_ip(spark, sf):
    t = carrier.telemetry(spark, sf)
    k = F.get_json_object("props", "$.k").cast("int")
    first = F.element_at(F.array(*[F.lit(x) for x in (10, 172, 192, 169, 8, 100, 198, 203, 224, 127, 0, 256)]), (F.col("seq") % 12 + 1).cast("int"))
    second = F.element_at(F.array(*[F.lit(x) for x in (16, 168, 254, 18, 0, 51, 31)]), k % 7 + 1)
    host = F.concat_ws(".", first, second, (F.col("seq") % 200).cast("int"), k)
    return urls.public_literal_ip(t.select("seq", host.alias("host")), "host")


# --- stored tables ----------------------------------------------------------------------------------


@query
def delete_api(spark, sf):
    org, api = "00000000-0000-4000-8000-000000000001", "00000000-0000-4000-9000-000000000004"
    return retention.without_api(carrier.telemetry(spark, sf), org, api).select("seq", "api_id")


@query
def delete_api_stored(spark, sf):
    """An api deleted from stored telemetry and predictions: both counts, and what is left of the telemetry."""
    org, api = "00000000-0000-4000-8000-000000000001", "00000000-0000-4000-9000-000000000004"
    store = run.Store(f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}")
    run.store_events(carrier.telemetry(spark, sf).drop("props"), store, 0, late_after=None)
    rows = predictions.prediction_rows(minute_predictions(spark, sf)).withColumn("seq", F.lit(0))
    tables.upsert_predictions(rows, store.at("predictions"), version=0)
    gone = run.delete_api(spark, store, org, api)
    left = spark.read.parquet(store.at("telemetry")).agg(F.count(F.lit(1)).alias("left"))
    return left.select(*[F.lit(gone[c]).cast("bigint").alias(c) for c in ("telemetry", "predictions")], "left")


@query
def retention_stored(spark, sf):
    """Stored telemetry, a minute of the test data stretched to ten hours, after whole dates have expired."""
    path = f"{scratch_dir(spark)}/retained-{uuid.uuid4().hex}"
    t = carrier.telemetry(spark, sf).select("seq", "org_id", "time")
    stretched = F.timestamp_seconds(F.unix_seconds(F.col("time").cast("timestamp")) * 600 - 599 * 1704067200).cast("timestamp_ntz")
    tables.append_telemetry(t.withColumn("time", stretched).repartition(F.to_date("time")), path)
    retention.apply_retention(spark, path, dt.datetime(2024, 4, 10))
    return tables.read_telemetry(spark, path).select("seq", "date")


def _orders_as_jobs(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("queued")
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


@query
def retention_90_days(spark, sf):
    jobs = _orders_as_jobs(spark, sf)
    return retention.retained(jobs, dt.datetime(2000, 6, 1), time="created_at").select("id", "created_at")


@query
def purge_jobs(spark, sf):
    return retention.purge_jobs(_orders_as_jobs(spark, sf), dt.datetime(2000, 6, 1)).select("id", "status")


# --- streams: run to the end of their input, answer with what they stored ----------------------------


def _in_arrival_files(spark, sf, files: int = 2):
    """The events as a stream that delivers several files one after the other."""
    path = f"{scratch_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    t = carrier.telemetry(spark, sf).drop("props")
    t.repartitionByRange(files, "seq").write.parquet(path)
    return spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def stream_features(spark, sf):
    """Feature rows of the last version of every tick, through both streaming jobs' state."""
    store = run.Store(f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}")
    ingest = (
        _in_arrival_files(spark, sf)
        .writeStream.foreachBatch(lambda batch, n: run.store_events(batch, store, n, late_after=None) and None)
        .option("checkpointLocation", store.at("checkpoint/ingest"))
        .trigger(availableNow=True)
        .start()
    )
    ingest.awaitTermination()
    scoring_job = run.start_scoring(
        run.read_ticks(spark, store, 100), store, store.at("checkpoint/scoring"), fixture_risk, trigger={"availableNow": True}
    )
    scoring_job.awaitTermination()
    latest = spark.read.parquet(store.at("features"))
    newest = latest.groupBy(*ENDPOINT_KEY, "minute").agg(F.max(F.struct("version", "batch")).alias("v"))
    rows = latest.join(newest, [*ENDPOINT_KEY, "minute"]).filter(
        (F.col("version") == F.col("v.version")) & (F.col("batch") == F.col("v.batch"))
    )
    names = [*FEATURES, "latency_mean", "latency_p95", "is_warmed_up"]
    return rounded(rows.select(F.timestamp_micros("now_us").cast("timestamp_ntz").alias("time"), *ENDPOINT_KEY, *names))


@query
def stream_live(spark, sf):
    """Live state after the whole stream, from the state store's running totals."""
    store = run.Store(f"{scratch_dir(spark)}/live-{uuid.uuid4().hex}")
    job = run.start_live(
        _in_arrival_files(spark, sf), store, store.at("checkpoint"), trigger={"availableNow": True}
    )
    job.awaitTermination()
    rows = spark.read.parquet(store.at("live")).drop("batch")
    last = rows.groupBy(*ENDPOINT_KEY).agg(F.max_by(F.struct(*rows.columns), "requests").alias("s")).select("s.*")
    return rounded(
        last.select(
            *ENDPOINT_KEY, "requests", "successes", "errors", "last_latency", "last_status",
            F.timestamp_micros("last_seen_us").cast("timestamp_ntz").alias("last_seen"), "error_rate", "avg_latency",
        )
    )


@query
def pipeline_counters(spark, sf):
    """What publishing and two runs of the ingest job have counted; every tenth message is cut short."""
    store = run.Store(f"{scratch_dir(spark)}/counted-{uuid.uuid4().hex}")
    raw = carrier.raw_events(spark, sf).drop("batch_id", "pos")
    n = F.floor(F.col("seq") / 100)
    for half in (0, 1):  # the second run starts where the first one stopped
        run.publish(raw.filter(n % 2 == half), store, store.at("messages"), half, batch=100)
        sent = spark.read.parquet(store.at(f"messages/batch={half}"))
        torn = F.when(F.col("offset") % 10 == 9, F.substring("value", 1, 20)).otherwise(F.col("value"))
        run.write_batch(sent.withColumn("value", torn), store.at("arrived"), half)
        stream = envelope.read_envelopes(spark, store.at("arrived"), streaming=True)
        run.start_ingest(stream, store, store.at("checkpoint"), late_after=None, trigger={"availableNow": True}).awaitTermination()
    return run.read_counters(spark, store)
