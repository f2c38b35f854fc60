"""Whitening against plain numpy and whole numbers of any size."""

import math

import numpy as np
import pytest

from telemetra.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, v string, deviation string, component string, label int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x", 1) for i, v in rows], schema)


def brute(kept):
    """Whole numbers throughout: covariances times n^2, and the deviations."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    far = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    cov = [[sum(r[i] * r[j] for r in far) for j in range(d)] for i in range(d)]  # n^3 times
    return x, n, sums, far, cov


def test_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    mixing = rng.normal(size=(10, 10))
    good = [(i % 37, [float(c) for c in rng.normal(size=10) @ mixing]) for i in range(300)]
    good += good[:5] + [(None, good[7][1])]  # repeated rows and a row without an id
    bad = [(900, None), (901, [float("nan")] + [0.0] * 9), (902, [None] * 10), (903, [float("inf")] * 10), (904, []), (905, [1.0] * 4), (906, [1e30] * 10)]
    got = whitening.whiten(frame(spark, good + bad).repartition(5)).collect()
    x, n, sums, far, cov = brute(good)
    v = np.array([[c / n**3 for c in row] for row in cov])
    values, columns = np.linalg.eigh(v)
    values, columns = values[::-1], columns[:, ::-1]
    assert len(got) == len(good) * 8 and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9
    want = {}
    for (i, _), f in zip(good, far):
        want.setdefault(i, []).append((sum(c * c for c in f), [abs(float(np.dot(np.array(f) / n, columns[:, k]) / math.sqrt(values[k]))) for k in range(8)]))
    for k in range(8):
        for i, rows in want.items():
            mine = sorted((int(r.deviation), abs(r.whitened)) for r in got if r.vec_id == i and r.component == k + 1)
            theirs = sorted((dev, w[k]) for dev, w in rows)
            assert [a for a, _ in mine] == [a for a, _ in theirs]
            assert [b for _, b in mine] == pytest.approx([b for _, b in theirs], rel=1e-8, abs=1e-8)
        assert next(r.explained for r in got if r.component == k + 1) == pytest.approx(values[k] / np.trace(v), rel=1e-10)
    white = {k: np.array([r.whitened for r in got if r.component == k]) for k in (1, 2)}
    assert white[1].var() == pytest.approx(1) and white[1].mean() == pytest.approx(0, abs=1e-9)


def test_far_entries_stay_exact(spark):
    rows = [(0, [2.0**40, 1.0, -3.5]), (1, [-(2.0**41), 2.0, 0.25]), (2, [7.0, 2.0**45, 0.0]), (3, [0.0, -1.0, 9.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    _, n, _, far, _ = brute(rows)
    assert {r.vec_id: int(r.deviation) for r in got} == {i: sum(c * c for c in f) for (i, _), f in zip(rows, far)}
    assert whitening.whole(whitening.limbs(-(3**80))) == -(3**80) and whitening.whole(whitening.limbs(7**60)) == 7**60


def test_polarisation_identity():
    rng = np.random.default_rng(2)
    x = rng.integers(-1000, 1000, (50, 6))
    n, s = len(x), x.sum(axis=0)
    got = whitening.covariance(n, s.tolist(), whitening.squares(x))
    far = n * x - s
    assert (np.array(got) * n == far.T @ far).all()
    big = x.astype(np.int64) << 40
    assert whitening.squares(big) == [q << 80 for q in whitening.squares(x)]


def test_without_variance_and_empty(spark):
    same = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.component, r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in same] == [(1, None, 0.0, 0.0, 0), (2, None, 0.0, 0.0, 0)] * 2
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and line[0].identity_error < 1e-9
    assert line[0].explained == pytest.approx(1)
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(frame(spark, rows)).collect() == []


def test_query(spark, sf):
    got = whitening.op11_polarisation(spark, sf)
    assert [(c, t) for c, t in got.dtypes][:7] == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
        ("whitened", "double"), ("explained", "double"), ("identity_error", "double"),
    ]
    assert got.count() == 500 * 8 and got.where("deviation is null").count() == 0
