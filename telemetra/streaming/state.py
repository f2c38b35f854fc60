"""Stateful processors: feature history per endpoint and live totals with expiry.

Both receive rows that were already combined (ticks, or per-batch partial sums), so the state work of a
hot endpoint does not grow with its events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from telemetra.operators.live import DEFAULT_RETENTION, FALLBACK_RETENTION, normalise_keys
from telemetra.operators.serving_features import CAPACITY_RPS, EWM_ALPHA, HISTORY, WARMUP_EVENTS
from telemetra.schemas import ENDPOINT_KEY, FEATURE_ALIASES, FEATURES
from telemetra.sources.envelope import ARRIVAL, arrival_fields

KEY_SCHEMA = ", ".join(f"{k} string" for k in ENDPOINT_KEY)
# Settings a stateful query takes over when it starts. Without new data there is nothing to report, so no
# empty batches are run (state with an expiry would otherwise ask for one after the other).
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}

# What a snapshot keeps of a tick. Late events may revise the last half hour, so that much more is kept.
SNAPSHOT = ["minute", "events", "p95_latency", "latency_variance", "error_rate", "traffic_rps", "schema_entropy"]
SNAPSHOT_SCHEMA = "minute bigint, events bigint, " + ", ".join(f"{c} double" for c in SNAPSHOT[2:])
KEEP = HISTORY + 32

BASE = [
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
    "recent_deploy",
    "p95_to_p50_ratio",
]
TICK_SCHEMA = f"{KEY_SCHEMA}, minute bigint, now_us bigint, events bigint, " + ", ".join(f"{c} double" for c in BASE)
FEATURE_SCHEMA = (
    f"minute bigint, now_us bigint, {KEY_SCHEMA}, "
    + ", ".join(f"{c} double" for c in [*FEATURES, *FEATURE_ALIASES])
    + ", is_warmed_up boolean, batch bigint"
)


def history_columns(snapshots: pd.DataFrame, i: int) -> dict[str, float]:
    """History features of row ``i`` from the rows before it."""
    past = {c: snapshots[c].to_numpy()[max(0, i - HISTORY) : i] for c in SNAPSHOT[2:]}
    now = snapshots.iloc[i]
    p95, err, var, rps = past["p95_latency"], past["error_rate"], past["latency_variance"], past["traffic_rps"]
    known = len(err) > 0
    ewm = err[0] if known else 0.0
    for x in err[1:]:
        ewm = EWM_ALPHA * x + (1.0 - EWM_ALPHA) * ewm
    z = p95[-30:]
    varies = len(z) > 1 and z.max() > z.min()
    return {
        "schema_entropy_delta": now["schema_entropy"] - past["schema_entropy"][-1] if known else 0.0,
        "p95_latency_roll_mean_15": p95[-15:].mean() if known else now["p95_latency"],
        "latency_variance_roll_std_15": var[-15:].std() if known else 0.0,
        "error_rate_roll_mean_15": err[-15:].mean() if known else now["error_rate"],
        "error_rate_acceleration": (err[-1] - err[-2]) - (err[-2] - err[-3]) if len(err) >= 3 else 0.0,
        "traffic_utilization_proxy": (rps[-10:].mean() if known else now["traffic_rps"]) / CAPACITY_RPS,
        "latency_p95_zscore": (z[-1] - z.mean()) / z.std() if varies else 0.0,
        "error_rate_ewm": ewm,
        "p95_latency_roll_max_15": p95[-15:].max() if known else now["p95_latency"],
        "error_high_streak": float((err[-10:] > np.quantile(err, 0.8)).sum()) if len(err) >= 3 else 0.0,
    }


class HistoryProcessor(StatefulProcessor):
    """Keeps the recent ticks of one endpoint; a tick that arrives again replaces its earlier version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._snapshots = handle.getListState("snapshots", SNAPSHOT_SCHEMA)
        self._forgotten = handle.getValueState("forgotten", "events bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["minute", "batch"]).drop_duplicates("minute", keep="last")
        old = pd.DataFrame(list(self._snapshots.get()), columns=SNAPSHOT)
        old = old[~old["minute"].isin(new["minute"])]
        kept = pd.concat([old, new[SNAPSHOT]]) if len(old) else new[SNAPSHOT]
        kept = kept.sort_values("minute").reset_index(drop=True)
        forgotten = (self._forgotten.get() or (0,))[0] if self._forgotten.exists() else 0
        total = kept["events"].cumsum() + forgotten
        at = {m: i for i, m in enumerate(kept["minute"])}
        out = []
        for tick in new.to_dict("records"):
            i = at[tick["minute"]]
            row = {**tick, **history_columns(kept, i), "is_warmed_up": bool(total[i] >= WARMUP_EVENTS)}
            row.update({alias: row[base] for alias, base in FEATURE_ALIASES.items()})
            out.append(row)
        names = ["minute", "now_us", *ENDPOINT_KEY, *FEATURES, *FEATURE_ALIASES, "is_warmed_up", "batch"]
        frame = pd.DataFrame(out)[names]
        doubles = [*FEATURES, *FEATURE_ALIASES]
        frame[doubles] = frame[doubles].replace([np.inf, -np.inf], np.nan).fillna(0.0)
        if len(kept) > KEEP:
            self._forgotten.update((int(forgotten + kept["events"].iloc[:-KEEP].sum()),))
            kept = kept.tail(KEEP)
        self._snapshots.put([(int(r[0]), int(r[1]), *map(float, r[2:])) for r in kept.itertuples(index=False)])
        yield frame

    def close(self) -> None:
        pass


def start_stateful(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Starts a query under the state settings and puts the session's own back."""
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    try:
        for name, value in STATE_CONF.items():
            spark.conf.set(name, value)
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def with_stream_history(ticks: DataFrame) -> DataFrame:
    """Full feature rows from a stream of ticks (``batch`` orders their versions)."""
    return ticks.groupBy(*ENDPOINT_KEY).transformWithStateInPandas(
        HistoryProcessor(), outputStructType=FEATURE_SCHEMA, outputMode="Update", timeMode="None"
    )


LIVE_SUMS = ["requests", "successes", "errors", "latency_sum"]
LIVE_LAST = [*ARRIVAL, "last_latency", "last_status", "last_seen_us"]
LIVE_SCHEMA = ", ".join(f"{c} bigint" for c in [*LIVE_SUMS, *LIVE_LAST])
LIVE_OUT = f"{KEY_SCHEMA}, {LIVE_SCHEMA}, error_rate double, avg_latency double"


def _partials(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums per endpoint within each Arrow batch: what leaves a task is one row per endpoint, not per event."""
    for f in frames:
        f = f.sort_values(ARRIVAL)
        ok = f["status"].between(200, 499)
        f = f.assign(requests=1, successes=ok.astype("int64"), errors=(~ok).astype("int64"), latency_sum=f["latency"])
        f = f.rename(columns={"latency": "last_latency", "status": "last_status", "us": "last_seen_us"})
        yield f.groupby(ENDPOINT_KEY, as_index=False).agg({c: "sum" for c in LIVE_SUMS} | {c: "last" for c in LIVE_LAST})


class LiveProcessor(StatefulProcessor):
    """Running totals and last values of one endpoint; the state expires after the retention time."""

    def __init__(self, retention_minutes: int):
        self._ttl = 60_000 * (retention_minutes if retention_minutes > 0 else FALLBACK_RETENTION)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("live", LIVE_SCHEMA, self._ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [*LIVE_SUMS, *LIVE_LAST]
        parts = pd.concat(list(rows))[names]
        if self._state.exists():
            parts = pd.concat([pd.DataFrame([tuple(self._state.get())], columns=names), parts])
        sums = parts[LIVE_SUMS].sum()
        newest = parts.sort_values(ARRIVAL).iloc[-1][LIVE_LAST]
        values = (*map(int, sums), *map(int, newest))
        self._state.update(values)
        row = dict(zip(ENDPOINT_KEY, key)) | dict(zip(names, values))
        row["error_rate"] = row["errors"] / row["requests"]
        row["avg_latency"] = row["latency_sum"] / row["requests"]
        yield pd.DataFrame([row])

    def close(self) -> None:
        pass


def stream_live(events: DataFrame, retention_minutes: int = DEFAULT_RETENTION) -> DataFrame:
    """Updated live state of every endpoint a micro-batch touches. Needs ``seq``, the arrival order or number."""
    slim = normalise_keys(events).select(
        *ENDPOINT_KEY,
        *arrival_fields(events),
        F.col("latency_ms").cast("bigint").alias("latency"),
        F.col("status").cast("bigint").alias("status"),
        F.unix_micros(F.col("time").cast("timestamp")).alias("us"),
    )
    partial = slim.mapInPandas(_partials, f"{KEY_SCHEMA}, {LIVE_SCHEMA}")
    return partial.groupBy(*ENDPOINT_KEY).transformWithStateInPandas(
        LiveProcessor(retention_minutes), outputStructType=LIVE_OUT, outputMode="Update", timeMode="ProcessingTime"
    )
