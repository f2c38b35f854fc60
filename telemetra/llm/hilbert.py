"""Sharding along a Hilbert curve, in DataFrame functions only.

Several metadata dimensions, texts by their whole values, are quantised at their quantiles, so that equal bins hold about equal rows and keep the
order of the values. The bins are the coordinates of a cell on a Hilbert curve; rows in curve order are cut into runs
of equal counts. Neighbours on the curve are close in every dimension, so each shard covers narrow ranges of all of
them and readers can skip files by any.

Positions need no global sort: cells are counted (their number is fixed by the bits), the counts are added up along
the curve, and rows are numbered inside hashed parts of a cell, so one source that holds a third of all rows is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from telemetra.llm.common import table
from telemetra.session import materialize

BITS = 5
PARTS = 1024
SHARDS = 16
ACCURACY = 10_000


def text_cuts(rows: DataFrame, dim: str, bits: int = BITS) -> tuple[int, list[str]]:
    """The quantile cut points of a text dimension in the order of its whole values, nulls lowest: how many of the
    2**bits - 1 are null, and the others.

    Distinct values are counted and dealt out in ranges; totals of whole ranges are carried over, the rest is added up
    inside a range.
    """
    counts = rows.groupBy(dim).agg(F.count("*").alias("_n"))
    ranged = materialize(counts.where(F.col(dim).isNotNull()).repartitionByRange(dim).withColumn("_range", F.spark_partition_id()), "ranged")
    totals = sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.sum("_n").alias("n")).collect())  # a row a range
    nulls = rows.where(F.col(dim).isNull()).count()
    starts, total = [], nulls
    for part, n in totals:
        starts.append((part, total))
        total += n
    bins = 1 << bits
    before = rows.sparkSession.createDataFrame(starts, "_range int, _before long")
    along = Window.partitionBy("_range").orderBy(dim).rowsBetween(Window.unboundedPreceding, 0)
    upto = ranged.join(F.broadcast(before), "_range").withColumn("_upto", F.col("_before") + F.sum("_n").over(along))
    passed = upto.select(
        dim, F.expr(f"(_upto - _n) * {bins} div {max(total, 1)}L").alias("low"), F.expr(f"_upto * {bins} div {max(total, 1)}L").alias("high")
    )
    found = passed.where("high > low").orderBy("low").collect()  # 2**bits at most
    points = [r[dim] for r in found for k in range(r["low"] + 1, r["high"] + 1) if k < bins]
    return (min(nulls * bins // total, bins - 1) if total else 0), points


def cuts(rows: DataFrame, dims: Sequence[str], bits: int = BITS) -> list[list[int]]:
    """The quantile cut points of each dimension: 2**bits - 1 numbers for each reach the driver."""
    at = F.array(*[F.lit(i / (1 << bits)) for i in range(1, 1 << bits)])
    found = rows.agg(*[F.percentile_approx(d, at, ACCURACY).alias(d) for d in dims]).first()
    return [list(found[d] or []) for d in dims]


def bin_of(value: Column, points: Sequence[int | str]) -> Column:
    """How many cut points are at most the value."""
    if not points:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p <= value))


def curve_index(coordinates: Sequence[Column], bits: int) -> Column:
    """The position of a cell on the Hilbert curve: the coordinates are turned and reflected from the highest bit
    down, Gray-coded and interleaved."""
    n = len(coordinates)

    def at(x: Column, i: int) -> Column:
        return F.element_at(x, i + 1)

    def turn(x: Column, q: Column) -> Column:
        """One bit level for all dimensions; ``q`` is the bit, lower bits are reflected or exchanged."""
        p = q - 1
        for i in range(n):
            here = at(x, i).bitwiseAND(q) != 0
            change = F.when(here, p).otherwise(at(x, 0).bitwiseXOR(at(x, i)).bitwiseAND(p))
            state = F.array(
                at(x, 0).bitwiseXOR(change),
                *[at(x, k).bitwiseXOR(F.when(here, F.lit(0)).otherwise(change)) if k == i else at(x, k) for k in range(1, n)],
            ) if i else F.array(F.when(here, at(x, 0).bitwiseXOR(p)).otherwise(at(x, 0)), *[at(x, k) for k in range(1, n)])
            # a one-element fold binds the state, so that the expression does not double with every step
            x = F.aggregate(F.array(state), F.array(*[F.lit(0)] * n), lambda _, s: s)
        return x

    levels = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    x = F.aggregate(levels, F.array(*[c.cast("int") for c in coordinates]), turn)
    coded = F.aggregate(
        F.array(*[F.lit(i) for i in range(1, n)]),
        x,
        lambda a, i: F.transform(a, lambda v, k: F.when(k == i, v.bitwiseXOR(F.element_at(a, i))).otherwise(v)),
    )
    last = F.aggregate(
        F.array(coded),
        F.lit(0),
        lambda _, a: F.aggregate(levels, F.lit(0), lambda t, q: F.when(at(a, n - 1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)),
    )
    places = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])
    return F.aggregate(
        F.array(F.struct(coded.alias("x"), last.alias("t"))),
        F.lit(0).cast("long"),
        lambda _, s: F.aggregate(
            places,
            F.lit(0).cast("long"),
            lambda out, b: F.aggregate(
                s.x, out, lambda o, v: o * 2 + F.call_function("shiftright", v.bitwiseXOR(s.t), b).bitwiseAND(1)
            ),
        ),
    )


def positions(rows: DataFrame, dims: Sequence[str], key: str, bits: int = BITS) -> DataFrame:
    """Adds ``curve`` and ``position`` (0, 1, 2 ... along the curve) to stored rows with numeric or text ``dims``. Inside
    a cell rows follow a hash of ``key``, then ``key``."""
    texts = [d for d in dims if rows.schema[d].dataType == StringType()]
    numbers = [d for d in dims if d not in texts]
    points = {d: (0, p) for d, p in zip(numbers, cuts(rows, numbers, bits))} if numbers else {}
    points |= {d: text_cuts(rows, d, bits) for d in texts}
    cell = F.lit(0)
    for d in dims:
        lowest, p = points[d]
        cell = cell * (1 << bits) + lowest + bin_of(F.col(d), p)
    placed = rows.withColumn("_cell", cell).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    counts = materialize(placed.groupBy("_cell", "_part").agg(F.count("*").alias("_n")), "cells")
    axes = [F.floor(F.col("_cell") / (1 << bits * i)).cast("int").bitwiseAND((1 << bits) - 1) for i in reversed(range(len(dims)))]
    # 2 ** (bits * dimensions) cells at most, whatever the number of rows
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy("_cell").agg(F.sum("_n").alias("_n")).withColumn("curve", curve_index(axes, bits))
    cells = cells.select("_cell", "curve", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_cell", "_part", F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_ahead")).join(cells, "_cell")
    order = [key, *[c for c in rows.columns if c != key]]
    rank = F.row_number().over(Window.partitionBy("_cell", "_part").orderBy(*order)) - 1
    ranked = placed.withColumn("_rank", rank).join(starts, ["_cell", "_part"])
    return ranked.withColumn("position", F.col("_first") + F.col("_ahead") + F.col("_rank")).select(*rows.columns, "curve", "position")


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, size and crc32 of the text, and the dimensions lang and source, stored: the texts are read once."""
    text = F.col("text").cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"),
        F.col("lang").cast("string").alias("_lang"),
        F.col("source").cast("string").alias("_source"),
    )
    return materialize(rows, "described")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, by the law ``rows`` (counts at
    most one apart).

    Null texts have size 1; null languages and sources sort first. Rows that tie in everything are interchangeable and
    each get a slot. Fewer rows than shards leave shards empty; an empty table gives no rows.
    """
    rows = describe(docs)
    total = rows.count()
    placed = positions(rows, ["_lang", "_source", "size"], "doc_id")
    placed = placed.withColumn("shard", F.expr(f"cast((position * {shards}L) div {max(total, 1)}L as int)"))
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("position") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the documents as one folder a shard, rows in curve order inside its files."""
    plan = shard(docs, shards).select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).dropDuplicates(["_id"])
    rows = docs.join(plan, docs["doc_id"].eqNullSafe(plan["_id"]))
    rows.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_id", "_slot").write.partitionBy("_shard").parquet(path)


def op10_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).drop("curve")
