"""Whitening of embeddings from exact variances alone: polarisation gives every covariance.

Entries become whole numbers, so all sums are exact. A first pass counts vectors and adds up every dimension. With the
means known, a second pass adds up the squares of centred values for each dimension and for each *sum of two
dimensions*. A covariance is half of var(i + j) - var(i) - var(j). The covariance matrix, d x d, is the only thing the
driver holds; its eigenvectors go back to the tasks, which project the vectors.

Sums that leave a task are cut into limbs of 40 bits, which Spark adds up as longs, so no total can overflow. Values
are centred at the whole number nearest to the mean, and the rest is taken into account exactly afterwards:
sum (n*x - S)^2 = n^2 * sum (x - m)^2 - n * (S - n*m)^2.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm.common import table
from telemetra.session import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
LIMB, LIMBS = 40, 6
ROWS = 2048
#: a covariance matrix of this many dimensions has 8 MB a thousand; the number of sums is checked, not cut
MAX_DIMENSIONS = 4096

PARTIAL = "key int, rows long, " + ", ".join(f"limb{k} long" for k in range(LIMBS))


@dataclass
class Whitening:
    """The fit: ``n`` vectors, sums by dimension, the covariance as floats, eigenvalues falling, vectors in columns."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def limbs(value: int) -> list[int]:
    """Digits of 40 bits, the lowest first; the last carries the sign."""
    return [value >> LIMB * k & (1 << LIMB) - 1 for k in range(LIMBS - 1)] + [value >> LIMB * (LIMBS - 1)]


def whole(digits: Iterable[int]) -> int:
    return sum(int(x) << LIMB * k for k, x in enumerate(digits))


def usable(vector: Column) -> Column:
    """Whether a vector is there, with no null, no entry that is not finite, and none beyond the range of a long."""
    fits = lambda c: F.abs(c.cast("double")) < F.lit(2.0**52)  # false for infinities; nulls and NaN are looked for
    return F.coalesce(
        vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double"))) & F.forall(vector, fits), F.lit(False)
    )


def vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v``, the vectors as doubles that take part: those of the commonest length among usable ones (of
    two equally common lengths the longer)."""
    kept = rows.where(usable(F.col(vector))).select(F.col("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    common = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.where(F.size("v") == (common["d"] if common else 0))


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their entries as whole numbers, a row a vector."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            entries = np.asarray(part.column("v").flatten()).reshape(part.num_rows, d)
            yield part, np.floor(entries * SCALE).astype(np.int64) + SHIFT


def _partial(n: int, totals: Iterable[int]) -> pa.RecordBatch:
    digits = np.array([limbs(int(t)) for t in totals], dtype=np.int64).reshape(-1, LIMBS)
    own = [pa.array(np.arange(len(digits)), pa.int32()), pa.array(np.full(len(digits), n), pa.int64())]
    return pa.RecordBatch.from_arrays([*own, *(pa.array(digits[:, k]) for k in range(LIMBS))], names=[x.split()[0] for x in PARTIAL.split(", ")])


def _collect(partial: DataFrame) -> tuple[int, list[int]]:
    """Sums of the tasks' partial sums; their number depends on the dimensions alone."""
    summed = partial.groupBy("key").agg(F.sum("rows").alias("rows"), *(F.sum(f"limb{k}").alias(f"limb{k}") for k in range(LIMBS)))
    found = sorted(tuple(r) for r in summed.collect())
    return (found[0][1] if found else 0), [whole(r[2:]) for r in found]


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for part, x in _blocks(batches, d):
            n += len(x)
            # halves of 32 bits keep the sums of a block within a long
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total = [t + (int(h) << 32) + int(s) for t, h, s in zip(total, high, low)]
        if n:
            yield _partial(n, total)

    return run


def pairs(d: int) -> list[tuple[int, int]]:
    """What is squared: every dimension (i, i), then every sum of two dimensions (i, j)."""
    return [(i, i) for i in range(d)] + list(combinations(range(d), 2))


def squares(y: np.ndarray) -> list[int]:
    """Sums over rows of the squares of each dimension and of each sum of two, exact."""
    if y.size and int(np.abs(y).max()) * 2 >= 1 << 25:  # with 2048 rows, a sum of squares could leave 62 bits
        y = y.astype(object)
    alone = (y * y).sum(axis=0)
    both = []
    for i in range(y.shape[1] - 1):
        z = y[:, i + 1 :] + y[:, i : i + 1]
        both += (z * z).sum(axis=0).tolist()
    return [int(s) for s in [*alone.tolist(), *both]]


def _squared(held, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, n, total = np.array(held.value, dtype=np.int64), 0, None
        for part, x in _blocks(batches, d):
            n += len(x)
            own = squares(x - mean)
            total = own if total is None else [a + b for a, b in zip(total, own)]
        if n:
            yield _partial(n, total)

    return run


def covariance(n: int, rest: list[int], total: list[int]) -> list[list[int]]:
    """n^2 times the covariances, exact, from sums of squares about whole centres; ``rest`` is S - n * centre."""
    d = len(rest)
    # n times the sum of (n*x - S)^2 is n^2 * (n*Q - r^2); n^2 * variance is n*Q - r^2
    spread = {p: n * q - (rest[p[0]] + (rest[p[1]] if p[0] != p[1] else 0)) ** 2 for p, q in zip(pairs(d), total)}
    out = [[0] * d for _ in range(d)]
    for (i, j), both in spread.items():
        out[i][j] = out[j][i] = both if i == j else (both - spread[i, i] - spread[j, j]) // 2  # always even
    return out


def fit(rows: DataFrame, d: int) -> Whitening | None:
    """The whitening of ``v``, or None without vectors. Two passes; the driver gets d + d(d+1)/2 sums."""
    if d > MAX_DIMENSIONS:
        raise ValueError(f"{d} dimensions: the covariance matrix is made on the driver, up to {MAX_DIMENSIONS}")
    spark = rows.sparkSession
    n, sums = _collect(rows.select("v").mapInArrow(_sums(d), PARTIAL))
    if not n:
        return None
    centre = [(2 * s + n) // (2 * n) for s in sums]
    held = spark.sparkContext.broadcast(centre)
    _, total = _collect(rows.select("v").mapInArrow(_squared(held, d), PARTIAL))
    exact = covariance(n, [s - n * m for s, m in zip(sums, centre)], total)
    matrix = np.array([[c / (n * n) for c in row] for row in exact]).reshape(d, d)  # division of whole numbers rounds once
    values, columns = np.linalg.eigh(matrix)
    return Whitening(n, sums, matrix, values[::-1].copy(), columns[:, ::-1].copy())


def rank(fitted: Whitening) -> int:
    """Components with variance: those above what rounding leaves of a zero eigenvalue."""
    d = len(fitted.values)
    return int((fitted.values > max(fitted.values.max(initial=0), 0) * d * np.finfo(float).eps * 16).sum()) if d else 0


def _projected(held, components: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Whitening = held.value
        n, d = fitted.n, len(fitted.sums)
        centre = [(2 * s + n) // (2 * n) for s in fitted.sums]
        rest = [s - n * m for s, m in zip(fitted.sums, centre)]
        squared = sum(r * r for r in rest)
        scaled = fitted.vectors[:, :components] / np.sqrt(fitted.values[:components])
        centres, shift = np.array(centre, dtype=np.int64), np.array([r / n for r in rest])
        for part, x in _blocks(batches, d):
            y = x - centres
            # sum (n*y - r)^2 from whole sums: n^2 * sum y^2 - 2n * sum y*r + sum r^2
            most, drift = int(np.abs(y).max(initial=0)), max(map(abs, rest))
            z = y.astype(object) if most * max(most, drift) * d >= 1 << 62 else y
            own, cross = (z * z).sum(axis=1), (z * np.array(rest, dtype=z.dtype)).sum(axis=1)
            deviation = [n * n * a - 2 * n * b + squared for a, b in zip(own.tolist(), cross.tolist())]
            white = (y - shift) @ scaled
            offsets = pa.array(np.arange(len(y) + 1) * components, pa.int32())
            exact = pa.array([s if s < 10**38 else None for s in deviation], pa.decimal128(38))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), exact, pa.ListArray.from_arrays(offsets, pa.array(white.ravel(), pa.float64()))],
                names=["vec_id", "deviation", "whitened"],
            )

    return run


def identity_error(whitened: DataFrame, components: int) -> float:
    """The largest entry of the covariance of ``whitened`` less the identity, measured on all rows: means first, then
    products of centred values."""
    if not components:
        return 0.0
    entry = lambda k: F.get("whitened", F.lit(k))
    means = whitened.agg(*(F.avg(entry(k)).alias(f"m{k}") for k in range(components))).first()
    if means[0] is None:
        return 0.0
    both = [(a, b) for a in range(components) for b in range(a, components)]
    found = whitened.agg(*(F.avg((entry(a) - means[a]) * (entry(b) - means[b])).alias(f"c{a}_{b}") for a, b in both)).first()
    return max(abs(c - (a == b)) for c, (a, b) in zip(found, both))


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation (decimal), whitened, explained, identity_error``: a row a vector and component.

    Vectors that are null, or hold a null or an entry that is not finite, are dropped; so are those whose length is not
    the commonest one and those with an entry of 2**52 or more, which has no place in the exact numbers. Repeated
    vec_ids, also null ones, are rows of their own. Components without variance (fewer distinct vectors than
    dimensions) have no direction: their ``whitened`` is null, ``explained`` 0, and the identity error is taken over the
    others. There are as many components as dimensions if those are fewer. ``deviation`` is null beyond 38 digits.
    An empty table, or one without usable vectors or with empty ones only, gives no rows. Further columns are left behind.
    """
    spark = rows.sparkSession
    used = vectors(rows, vector)
    first = used.select(F.size("v")).first()
    empty = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    d = first[0] if first else 0
    fitted = fit(used, d) if d else None
    if fitted is None:
        return spark.createDataFrame([], empty)
    asked = min(components, d)
    held_components = min(asked, rank(fitted))
    held = spark.sparkContext.broadcast(fitted)
    id_type = used.schema["vec_id"].dataType.simpleString()
    projected = used.mapInArrow(_projected(held, held_components), f"vec_id {id_type}, deviation decimal(38,0), whitened array<double>")
    stored = materialize(projected, "whitened")
    error = identity_error(stored, held_components)
    trace = float(np.trace(fitted.covariance))
    share = [float(v) / trace if k < held_components else 0.0 for k, v in enumerate(fitted.values[:asked])]
    return stored.select(
        "vec_id", "deviation", F.explode(F.sequence(F.lit(1), F.lit(asked))).alias("component"), F.col("whitened").alias("_w")
    ).select(
        "vec_id",
        "component",
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        F.get("_w", F.col("component") - 1).alias("whitened"),
        F.element_at(F.array(*map(F.lit, share)), F.col("component")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op11_polarisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` as a long is null where the exact number has no place in one; the operator's own is a decimal."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
