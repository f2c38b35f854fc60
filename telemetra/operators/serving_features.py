"""Rolling per-endpoint features for scoring (25 features, two aliases, warm-up flag).

A *tick* is one (endpoint key, minute) with events; its "now" is the last event of that minute. The
1, 5 and 15 minute windows end at now and include their lower bound to the microsecond.

Shape of the job: the events are shuffled once, on (key, slot of a minute), so a hot endpoint spreads
over its slots. There each event learns its successor's schema hash and whether it still falls into the
partly covered first minute of the 1, 5 and 15 minute windows that end one, five and fifteen minutes
later. On that same partitioning everything is combined into one state a slot: sums, and count maps of
latencies and hashes. The states are shuffled once more, on the key, and all that follows happens there:
links between slots, minutes, windows over minutes and history. Nothing is written in between, and no
window ever runs over raw events of a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.scalars import MINUTE_US, micros
from telemetra.schemas import ENDPOINT_KEY, FEATURE_ALIASES, FEATURES

# History length, warm-up count, smoothing factor, capacity behind the utilisation proxy.
HISTORY = 180
WARMUP_EVENTS = 100
EWM_ALPHA = 0.3
CAPACITY_RPS = 2000.0

KEY = ENDPOINT_KEY
SLOT_SECONDS = 20


def _n(flag: Column) -> Column:
    return F.sum(F.coalesce(flag, F.lit(False)).cast("bigint"))


SUMS = ["n", "e", "s", "sxx", "n1", "e1", "s1", "sxx1", "n5", "e5", "s5", "n15", "ch", "br", "ch15", "br15"]


def slot_states(events: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """One row per (key, minute, slot): sums with the tails of windows, count maps and the ends of the slot.

    ``lat`` and ``lat1`` count latencies (of all events, and of the 1 minute window's tail), ``hashes`` and
    ``hashes15`` schema hashes.
    """
    us = micros("time")
    seq = F.col("seq") if "seq" in events.columns else F.lit(0)
    e = events.select(
        *KEY,
        us.alias("us"),
        F.floor(us / F.lit(MINUTE_US)).cast("bigint").alias("minute"),
        F.floor((us % MINUTE_US) / F.lit(slot_seconds * 1_000_000)).cast("int").alias("slot"),
        F.coalesce("latency_ms", F.lit(0)).alias("latency"),
        (F.col("status") >= 500).alias("err"),
        F.nullif("schema_hash", F.lit("")).alias("hash"),
        seq.alias("seq"),
    )
    at = [*KEY, "minute", "slot"]

    def starts(w: int) -> Column:
        """Lower bound of the w-minute window that ends in the minute ``w`` later, if that minute has events."""
        later = Window.partitionBy(*KEY).orderBy("minute").rangeBetween(w, w)
        return (F.max("last_us").over(later) - w * MINUTE_US).alias(f"from_{w}")

    cuts = e.groupBy(*at).agg(F.max("us").alias("last_us")).select(*at, starts(1), starts(5), starts(15))

    order = Window.partitionBy(*at).orderBy("us", "seq")
    linked = e.join(cuts, at).select(
        "*",
        F.lead("hash").over(order).alias("next_hash"),
        F.lead("err").over(order).alias("next_err"),
        F.row_number().over(order).alias("rn"),
    )
    change = F.coalesce(F.col("hash") != F.col("next_hash"), F.lit(False))
    breaks = change & F.col("next_err")
    first, last = F.col("rn") == 1, F.col("next_err").isNull()

    def tail(w: int) -> Column:
        return F.coalesce(F.col("us") >= F.col(f"from_{w}"), F.lit(False))

    cells = linked.groupBy(*at, "hash", "latency").agg(
        F.count(F.lit(1)).alias("n"),
        _n(F.col("err")).alias("e"),
        *[_n(tail(w)).alias(f"n{w}") for w in (1, 5, 15)],
        *[_n(tail(w) & F.col("err")).alias(f"e{w}") for w in (1, 5)],
        _n(change).alias("ch"),
        _n(breaks).alias("br"),
        _n(change & tail(15)).alias("ch15"),
        _n(breaks & tail(15)).alias("br15"),
        _n(first).alias("has_first"),
        _n(first & F.col("err")).alias("first_err"),
        _n(last).alias("has_last"),
        _n(last & tail(15)).alias("last15"),
        F.max("us").alias("last_us"),
    )
    lat = F.col("latency").cast("bigint")
    cells = cells.withColumns({"s": F.col("n") * lat, "sxx": F.col("n") * lat * lat, "s1": F.col("n1") * lat, "sxx1": F.col("n1") * lat * lat, "s5": F.col("n5") * lat})

    def counted(value: str, weight: str) -> Column:
        return F.collect_list(F.when((F.col(weight) > 0) & F.col(value).isNotNull(), F.struct(F.col(value).alias("x"), F.col(weight).alias("w"))))

    by_hash = cells.groupBy(*at, "hash").agg(
        *[F.sum(c).alias(c) for c in [*SUMS, "has_first", "first_err", "has_last", "last15"]],
        counted("latency", "n").alias("lat"),
        counted("latency", "n1").alias("lat1"),
        F.max("last_us").alias("last_us"),
    )
    return by_hash.groupBy(*at).agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.flatten(F.collect_list("lat")).alias("lat"),
        F.flatten(F.collect_list("lat1")).alias("lat1"),
        counted("hash", "n").alias("hashes"),
        counted("hash", "n15").alias("hashes15"),
        # max over at most one row each: the one that holds the slot's first or last event
        F.max(F.when(F.col("has_first") > 0, F.col("hash"))).alias("first_hash"),
        (F.max("first_err") > 0).alias("first_err"),
        F.max(F.when(F.col("has_last") > 0, F.col("hash"))).alias("last_hash"),
        (F.max("last15") > 0).alias("last15"),
        F.max("last_us").alias("last_us"),
    )


def minute_states(slots: DataFrame) -> DataFrame:
    """One row per (key, minute): the slots merged, with the schema changes between a slot and the key's next one."""
    order = Window.partitionBy(*KEY).orderBy("minute", "slot")
    step = slots.select(
        "*",
        F.coalesce(F.col("last_hash") != F.lead("first_hash").over(order), F.lit(False)).alias("link"),
        F.coalesce(F.lead("first_err").over(order), F.lit(False)).alias("hit_err"),
        F.coalesce(F.lead("minute").over(order) == F.col("minute"), F.lit(False)).alias("inside"),
    )
    ch, br = F.col("link"), F.col("link") & F.col("hit_err")
    return step.groupBy(*KEY, "minute").agg(
        F.max("last_us").alias("now_us"),
        *[F.sum(c).alias(c) for c in SUMS],
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("lat", "lat1", "hashes", "hashes15")],
        _n(ch & F.col("inside")).alias("in_ch"),
        _n(br & F.col("inside")).alias("in_br"),
        _n(ch & ~F.col("inside")).alias("out_ch"),
        _n(br & ~F.col("inside")).alias("out_br"),
        _n(ch & F.col("last15")).alias("tail_ch"),
        _n(br & F.col("last15")).alias("tail_br"),
    )


def _percentiles(counts: str, total: str) -> str:
    """Exact 50th, 90th and 95th percentile of a list of (x, w), between neighbours as usual."""
    ranks = ", ".join(f"{part}({p}D * ({total} - 1))" for p in (0.5, 0.9, 0.95) for part in ("floor", "ceil"))
    # walks the sorted values once; each of the six ranks takes the first value that reaches it
    walk = (
        f"aggregate(array_sort({counts}), named_struct('c', 0L, 'v', array_repeat(cast(NULL AS double), 6)), "
        f"(a, x) -> named_struct('c', a.c + x.w, 'v', transform(a.v, (v, i) -> coalesce(v, if(a.c + x.w > array({ranks})[i], double(x.x), NULL)))), "
        "a -> a.v)"
    )
    at = [f"{p}D * ({total} - 1)" for p in (0.5, 0.9, 0.95)]
    between = ", ".join(
        f"if(ceil({p}) = floor({p}), v[{2 * k}], (ceil({p}) - {p}) * v[{2 * k}] + ({p} - floor({p})) * v[{2 * k + 1}])" for k, p in enumerate(at)
    )
    return f"transform(array({walk}), v -> array({between}))[0]"


def entropy_of(counts: str) -> str:
    """Base-2 entropy of a list of (x, w) in which a value may occur several times; null if it is empty."""
    return (
        f"aggregate(array_sort({counts}), named_struct('x', cast(NULL AS string), 'w', 0D, 't', 0D, 's', 0D), "
        "(a, x) -> named_struct('x', x.x, 'w', if(a.x <=> x.x, a.w, 0D) + x.w, 't', a.t + x.w, 's', a.s + if(a.x <=> x.x OR a.w = 0D, 0D, a.w * log2(a.w))), "
        "a -> if(a.t > 0D, log2(a.t) - (a.s + a.w * log2(a.w)) / a.t, NULL))"
    )


def base_features(events: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """One row per tick with everything that needs no earlier ticks."""
    ticks = minute_states(slot_states(events, slot_seconds))
    key = ", ".join(KEY)

    def over(w: int, whole: str, part: str | None = None, upto: int = 0) -> str:
        """Sum over the last w minutes (less ``upto``) plus the covered part of the minute before them."""

        def total(what: str, first: int, last: int) -> str:
            bound = f"{-last} PRECEDING" if last else "CURRENT ROW"
            frame = f"RANGE BETWEEN {-first} PRECEDING AND {bound}" if first else "RANGE CURRENT ROW"
            return f"coalesce(sum({what}) OVER (PARTITION BY {key} ORDER BY minute {frame}), 0)"

        whole_minutes = total(whole, 1 - w, -upto)
        return whole_minutes + (f" + {total(part, -w, -w)}" if part else "")

    def frame(first: int, last: int) -> str:
        return f"OVER (PARTITION BY {key} ORDER BY minute RANGE BETWEEN {first} PRECEDING AND {f'{last} PRECEDING' if last else 'CURRENT ROW'})"

    nothing = "cast(array() AS array<struct<x:{},w:bigint>>)"
    ticks = ticks.selectExpr(
        "*",
        f"concat(lat, coalesce(first(lat1) {frame(1, 1)}, {nothing.format('int')})) AS counted",
        f"concat(flatten(collect_list(hashes) {frame(14, 0)}), coalesce(first(hashes15) {frame(15, 15)}, {nothing.format('string')})) AS hashed",
        f"{over(1, 'n', 'n1')} AS w",
        f"double({over(1, 's', 's1')}) AS sx",
        f"double({over(1, 'sxx', 'sxx1')}) AS sqx",
    )
    # sums of whole numbers, exact below 2^53; divided once
    ticks = ticks.selectExpr(
        "*",
        f"{_percentiles('counted', 'w')} AS p",
        "if(w > 1, greatest(0D, w * sqx - sx * sx) / (double(w) * double(w)), 0D) AS latency_variance",
        f"{entropy_of('hashed')} AS schema_entropy",
    ).withColumns({"p50_latency": F.col("p")[0], "p90_latency": F.col("p")[1], "p95_latency": F.col("p")[2]})

    t = ticks.selectExpr(
        *KEY,
        "minute",
        "now_us",
        "n AS events",
        f"sum(n) OVER (PARTITION BY {key} ORDER BY minute ROWS UNBOUNDED PRECEDING) AS events_so_far",
        "p50_latency",
        "p90_latency",
        "p95_latency",
        "latency_variance",
        "coalesce(greatest(schema_entropy, 0D), 0D) AS schema_entropy",
        f"{over(1, 'n', 'n1')} AS c1",
        f"{over(5, 'n', 'n5')} AS c5",
        f"{over(1, 'e', 'e1')} AS x1",
        f"{over(5, 'e', 'e5')} AS x5",
        f"{over(5, 's', 's5')} AS l5",
        f"{over(15, 'ch + in_ch', 'ch15 + tail_ch')} + {over(15, 'out_ch', upto=1)} AS changes",
        f"{over(15, 'br + in_br', 'br15 + tail_br')} + {over(15, 'out_br', upto=1)} AS breaking",
    )
    return t.selectExpr(
        *KEY,
        "minute",
        "now_us",
        "events",
        "events_so_far",
        "p50_latency",
        "p90_latency",
        "p95_latency",
        "latency_variance",
        "p50_latency - l5 / c5 AS latency_delta",
        "x1 / c1 AS error_rate",
        "x1 / c1 - x5 / c5 AS error_rate_delta",
        "c1 / 60D AS traffic_rps",
        "c1 / 60D - c5 / 300D AS traffic_delta",
        "double(changes) AS schema_fields_added",
        "greatest(0D, changes - 1D) AS schema_fields_removed",
        "if(breaking > 0, 1D, 0D) AS schema_breaking_changes",
        "schema_entropy",
        "if(changes > 0, 1D, 0D) AS recent_deploy",
        "p95_latency / greatest(p50_latency, 1D) AS p95_to_p50_ratio",
    )


def with_history(ticks: DataFrame, history: int = HISTORY) -> DataFrame:
    """Adds the features that look back over earlier ticks of the key; the current one is never included.

    These windows see one row per minute and key, a number bounded by the retention period.
    """
    order = f"OVER (PARTITION BY {', '.join(KEY)} ORDER BY minute)"

    def last(n: int) -> str:
        return f"{order[:-1]} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"

    e1, e2, e3 = (f"lag(error_rate, {i}) {order}" for i in (1, 2, 3))
    # a constant window may leave rounding noise in the deviation; its range says exactly whether it varies
    varies = f"max(p95_latency) {last(30)} > min(p95_latency) {last(30)}"
    z = f"(lag(p95_latency) {order} - avg(p95_latency) {last(30)}) / stddev_pop(p95_latency) {last(30)}"
    t = ticks.selectExpr(
        "*",
        f"collect_list(error_rate) {last(history)} AS errors",
        f"coalesce(schema_entropy - lag(schema_entropy) {order}, 0D) AS schema_entropy_delta",
        f"coalesce(avg(p95_latency) {last(15)}, p95_latency) AS p95_latency_roll_mean_15",
        f"coalesce(stddev_pop(latency_variance) {last(15)}, 0D) AS latency_variance_roll_std_15",
        f"coalesce(avg(error_rate) {last(15)}, error_rate) AS error_rate_roll_mean_15",
        f"coalesce(({e1} - {e2}) - ({e2} - {e3}), 0D) AS error_rate_acceleration",
        f"coalesce(avg(traffic_rps) {last(10)}, traffic_rps) / {CAPACITY_RPS}D AS traffic_utilization_proxy",
        f"if({varies}, {z}, 0D) AS latency_p95_zscore",
        f"coalesce(max(p95_latency) {last(15)}, p95_latency) AS p95_latency_roll_max_15",
    )
    smooth = f"(acc, x) -> {EWM_ALPHA}D * x + {1.0 - EWM_ALPHA}D * acc"
    at = "0.8D * (size(errors) - 1)"
    low, high = (f"get(s, int({f}({at})))" for f in ("floor", "ceil"))
    quantile = f"{low} + ({high} - {low}) * ({at} - floor({at}))"
    recent = "slice(errors, greatest(size(errors) - 9, 1), 10)"
    # the one-element array binds the sorted history, so that it is sorted once
    streak = f"get(transform(array(array_sort(errors)), s -> size(filter({recent}, x -> x > {quantile}))), 0)"
    return t.selectExpr(
        *[name for name in t.columns if name != "errors"],
        f"if(size(errors) > 0, aggregate(slice(errors, 2, {history}), get(errors, 0), {smooth}), 0D) AS error_rate_ewm",
        f"if(size(errors) >= 3, double({streak}), 0D) AS error_high_streak",
    )


def finish(ticks: DataFrame, time_type="timestamp") -> DataFrame:
    """Key, time, the features in model order with the non-finite guard, aliases and the warm-up flag."""

    def guarded(name: str, alias: str) -> str:
        return f"if({name} IS NULL OR isnan({name}) OR abs({name}) = double('inf'), 0D, {name}) AS {alias}"

    kind = time_type if isinstance(time_type, str) else time_type.simpleString()
    return ticks.selectExpr(
        f"cast(timestamp_micros(now_us) AS {kind}) AS time",
        *KEY,
        *[guarded(name, name) for name in FEATURES],
        *[guarded(base, alias) for alias, base in FEATURE_ALIASES.items()],
        f"events_so_far >= {WARMUP_EVENTS} AS is_warmed_up",
    )


def serving_features(events: DataFrame, history: int = HISTORY, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    ticks = base_features(events, slot_seconds)
    return finish(with_history(ticks, history), events.schema["time"].dataType)
