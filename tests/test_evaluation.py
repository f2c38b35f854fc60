import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetra.operators import evaluation as ev
from telemetra.plans import scale


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = []
    for i in range(3000):
        # a third of all rows share one score
        score = 0.25 if i % 3 == 0 else round(r.random(), 3)
        out.append((dt.datetime(2024, 1, 1) + dt.timedelta(seconds=37 * i), f"k{i % 4}", score, int(r.random() < score)))
    return out


@pytest.fixture(scope="module")
def scored(spark, rows):
    return spark.createDataFrame(rows, "time timestamp, k string, score double, label int").repartition(4)


def test_quantiles_equal_numpy(spark, scored, rows):
    probs = [0.0, 0.1, 0.25, 0.5, 0.8, 0.99, 1.0]
    got = {r["prob"]: r["value"] for r in scale.exact_quantiles(scored, "score", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile([r[2] for r in rows], p), abs=1e-12)
    by = scale.exact_quantiles(scored, "score", [0.5], ["k"]).collect()
    for r in by:
        assert r["value"] == pytest.approx(np.quantile([x[2] for x in rows if x[1] == r["k"]], 0.5), abs=1e-12)


def test_quantiles_of_one_value(spark):
    df = spark.range(5).select(F.lit(3.0).alias("v"))
    assert scale.exact_quantiles(df, "v", [0.5]).first()["value"] == 3.0


def test_rank_is_global(spark, scored):
    got = ev.time_ranked(scored, ["time", "k"]).orderBy("time").select("rn").collect()
    assert [r["rn"] for r in got] == list(range(1, 3001))


def test_auc_and_precision_by_definition(scored, rows):
    pos = [r[2] for r in rows if r[3]]
    neg = [r[2] for r in rows if not r[3]]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert ev.roc_auc(scored).first()["roc_auc"] == pytest.approx(wins / len(pos) / len(neg))
    ap, seen_pos = 0.0, 0
    for s in sorted({r[2] for r in rows}, reverse=True):
        at = [r for r in rows if r[2] == s]
        above = [r for r in rows if r[2] >= s]
        ap += sum(r[3] for r in at) / len(pos) * sum(r[3] for r in above) / len(above)
        seen_pos += sum(r[3] for r in at)
    assert ev.average_precision(scored).first()["average_precision"] == pytest.approx(ap)


def test_precision_at_cuts_inside_a_tie(scored, rows):
    order = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))
    shares = [0.0001, 0.1, 0.9]
    got = {r["share"]: (r["k"], r["precision"]) for r in ev.precision_at(scored, ["time", "k"], shares).collect()}
    for s in shares:
        k = max(1, int(len(rows) * s))
        assert got[s] == (k, pytest.approx(sum(r[3] for r in order[:k]) / k))


def test_sweep_falls_back_without_precise_rows(spark):
    df = spark.createDataFrame([(0, 0.9), (0, 0.8), (0, 0.7), (1, 0.6), (0, 0.5)], "label int, score double")
    sweep = ev.threshold_sweep(df)
    assert sweep.count() == 91
    best = ev.best_threshold(sweep).first()
    assert best["precision"] == 0.25 and best["threshold"] == pytest.approx(0.51)


def test_threshold_edges_are_exact(spark):
    grid = [i / 100 for i in range(101)]
    df = spark.createDataFrame([(1, s) for s in grid], "label int, score double")
    for r in ev.threshold_sweep(df).collect():
        assert r["recall"] == pytest.approx(sum(s >= r["threshold"] for s in grid) / 101)


def test_stability_word(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.92), (3, 0.94)], "fold int, auc double")
    assert ev.fold_stability(df).first()["stability"] == "good"


def test_out_of_order_across_blocks(spark):
    from telemetra.operators.timing import flag_out_of_order

    r = random.Random(1)
    times = [r.randrange(1000) for _ in range(500)]
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), "o", "a", "e", "GET") for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "seq bigint, time timestamp, org_id string, api_id string, endpoint string, method string")
    got = [x["out_of_order"] for x in flag_out_of_order(df, block=16).orderBy("seq").collect()]
    assert got == [i > 0 and t < max(times[:i]) for i, t in enumerate(times)]


def test_quantiles_behind_an_outlier(spark):
    """One far value does not put all others into one range."""
    rows = [(float(i % 977) / 3, "a") for i in range(5000)] + [(1e300, "a"), (-1e300, "a"), (float(2**60), "b"), (1.0, "b"), (1.0 + 2**-52, "b")]
    df = spark.createDataFrame(rows, "v double, k string").repartition(3)
    own = sorted(v for v, _ in rows)
    at = lambda q, x: x[int(q * (len(x) - 1))] + (q * (len(x) - 1) % 1) * (x[min(int(q * (len(x) - 1)) + 1, len(x) - 1)] - x[int(q * (len(x) - 1))])
    for r in scale.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        assert r["value"] == pytest.approx(at(r["prob"], own), rel=1e-12)
    by = {(r["k"], r["prob"]): r["value"] for r in scale.exact_quantiles(df, "v", [0.25, 0.5], ["k"]).collect()}
    assert by["b", 0.5] == 1.0 + 2**-52 and by["a", 0.25] == pytest.approx(at(0.25, sorted(v for v, k in rows if k == "a")))


def test_ranges_hold_few_values_each(spark, monkeypatch):
    """What is written for the windows: no range has most of the distinct values, outliers or not."""
    kept = {}
    store = scale.materialize
    monkeypatch.setattr(scale, "materialize", lambda df, name, *a: kept.setdefault(name, store(df, name, *a)))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(20_000).select((F.col("id") % 4999).cast("double").alias("v")).unionAll(spark.createDataFrame([(1e300,)], "v double"))
        scale.exact_quantiles(df, "v", [0.5]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [r["count"] for r in kept["hist"].groupBy("_range").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) < 2500


def test_auc_by_group_is_the_auc_of_each(spark):
    rows = [(k, (i * 7 + k) % 13 / 13, int((i * 5 + k) % 3 == 0)) for k in range(3) for i in range(60)] + [(9, 0.5, 1)]
    df = spark.createDataFrame(rows, "fold int, score double, label int")
    by = {r["fold"]: r["roc_auc"] for r in ev.roc_auc(df, ["fold"]).collect()}
    assert by.pop(9) is None and len(by) == 3
    for k, auc in by.items():
        assert auc == pytest.approx(ev.roc_auc(df.filter(F.col("fold") == k)).first()["roc_auc"])
