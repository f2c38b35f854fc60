"""Per-row contributions of a boosted-tree model (path-dependent tree Shapley values).

With z_i the share of training rows that stay on a path at its feature i and o_i whether a row does, a leaf gives
feature j its value times (o_j - z_j) times the mean, over t from 0 to 1, of the product of z_i (1 - t) + o_i t over the
path's other features. That product is a polynomial in t of a degree below the number of features, so a few
Gauss-Legendre points give the mean exactly. All rows and leaves of a block are computed at once; what travels to the
tasks are the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: nodes that travel and are held at once, about 100 bytes each; larger models are applied in several passes
PASS_NODES = 500_000
#: cells (rows x leaves x features) computed at once
CELLS = 500_000


@dataclass
class Leaves:
    """The leaves with the same number of path features, each a box over them: features, bounds and covers (leaf x
    feature), and values."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cover: np.ndarray
    value: np.ndarray


def model_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node table of a saved boosted-tree model: tree, weight, id, children, split, cover, prediction."""
    data = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    # written as (tree, its metadata, its weight); the column names differ between Spark versions
    meta = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weights").drop("metadata")
    return data.join(meta, "treeID").select(
        F.col("treeID").alias("tree"),
        F.col("weights").alias("weight"),
        "id",
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.get("impurityStats", F.lit(0)).alias("cover"),
        "prediction",
    )


def build_leaves(nodes: pd.DataFrame, scale: float = 2.0) -> tuple[float, list[Leaves]]:
    """(expected score, leaves by number of path features). ``scale`` 2 turns the model's margin into log-odds."""
    base, found = 0.0, {}
    for _, tree in nodes.groupby("tree"):
        rows = dict(zip(tree["id"], zip(*(tree[c] for c in ("left", "right", "feature", "threshold", "cover", "weight", "prediction")))))
        todo = [(min(rows), {}, 1.0)]
        while todo:
            node, path, reach = todo.pop()
            left, right, feature, cut, cover, weight, prediction = rows[node]
            if left < 0:
                value = scale * weight * prediction
                base += value * reach
                if path:
                    names = sorted(path)
                    found.setdefault(len(names), []).append((names, *zip(*(path[f] for f in names)), value))
                continue
            f = int(feature)
            low, high, stay = path.get(f, (-np.inf, np.inf, 1.0))
            for child, side in ((left, (low, min(high, cut))), (right, (max(low, cut), high))):
                share = rows[child][4] / cover
                todo.append((child, {**path, f: (*side, stay * share)}, reach * share))
    return base, [Leaves(*map(np.array, zip(*own))) for _, own in sorted(found.items())]


def contributions(x: np.ndarray, leaves: Sequence[Leaves]) -> np.ndarray:
    """What each feature adds to the expected score of each row."""
    out = np.zeros_like(x, dtype=float)
    for own in leaves:
        d = own.features.shape[1]
        points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
        points, weights = (points + 1) / 2, weights / 2
        rows = max(1, min(len(x), 1024))
        width = max(1, CELLS // (rows * d))
        for at in range(0, len(own.value), width):
            part = slice(at, at + width)
            features = own.features[part].ravel()
            order = np.argsort(features, kind="stable")
            starts = np.flatnonzero(np.diff(features[order], prepend=-1))
            for k in range(0, len(x), rows):
                v = x[k : k + rows][:, own.features[part]]
                inside = ((v > own.low[part]) & (v <= own.high[part])).astype(float)
                share = np.zeros_like(v)
                for t, w in zip(points, weights):
                    factor = own.cover[part] * (1 - t) + inside * t
                    before, after = np.ones_like(factor), np.ones_like(factor)
                    np.cumprod(factor[..., :-1], axis=-1, out=before[..., 1:])
                    after[..., :-1] = np.cumprod(factor[..., :0:-1], axis=-1)[..., ::-1]
                    share += w * before * after
                given = (own.value[part][:, None] * (inside - own.cover[part]) * share).reshape(len(v), -1)
                out[k : k + rows, features[order][starts]] += np.add.reduceat(given[:, order], starts, axis=1)
    return out


_built: dict = {}


def _once(held) -> tuple[float, list[Leaves]]:
    """A worker builds the leaves of the nodes it was sent once, and keeps the last ones."""
    if held.id not in _built:
        _built.clear()
        _built[held.id] = build_leaves(held.value)
    return _built[held.id]


class _Nodes:
    """Broadcast nodes under a number of their own."""

    def __init__(self, spark: SparkSession, nodes: pd.DataFrame):
        import uuid

        self.id, self._held = uuid.uuid4().hex, spark.sparkContext.broadcast(nodes)

    @property
    def value(self) -> pd.DataFrame:
        return self._held.value


def explain_nodes(df: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``contributions`` (array in feature order) and ``base_score`` from a node table.

    The trees are dealt into passes of at most ``PASS_NODES`` nodes (or one tree); each pass adds its trees' share, so a
    model of any size is applied whole. Nothing is shuffled. A model without trees gives zeros.
    """
    spark = df.sparkSession
    sizes = sorted((r["tree"], r["n"]) for r in nodes.groupBy("tree").agg(F.count("*").alias("n")).collect())  # a row a tree
    passes, room = [], 0
    for tree, n in sizes:
        if not passes or n > room:
            passes.append([])
            room = PASS_NODES
        passes[-1].append(tree)
        room -= n
    out = df.withColumns({"contributions": F.array_repeat(F.lit(0.0), len(features)), "base_score": F.lit(0.0)})
    schema = T.StructType(
        [*df.schema.fields, T.StructField("contributions", T.ArrayType(T.DoubleType())), T.StructField("base_score", T.DoubleType())]
    )
    for trees in passes:
        own = nodes.where(F.col("tree").between(trees[0], trees[-1]))
        held = _Nodes(spark, own.select("tree", "id", "left", "right", "feature", "threshold", "cover", "weight", "prediction").toPandas())

        def explain(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            base, leaves = _once(held)
            for frame in frames:
                added = contributions(frame[features].to_numpy(dtype=float), leaves)
                before = np.array(frame["contributions"].tolist(), dtype=float).reshape(added.shape)
                yield frame.assign(contributions=list(before + added), base_score=frame["base_score"] + base)

        out = out.mapInPandas(explain, schema)
    return out


def with_contributions(df: DataFrame, model_path: str, features: list[str]) -> DataFrame:
    """Adds ``contributions`` (array in feature order) and ``base_score`` from a saved model."""
    return explain_nodes(df, model_nodes(df.sparkSession, model_path), features)


def margins(df: DataFrame, key: Sequence[str], nodes: DataFrame, features: Sequence[str], scale: float = 2.0) -> DataFrame:
    """``key`` and ``margin`` by walking down the node table, one join a level for all rows and trees together.

    A row and tree is one row of the walk, so this is for checking models and for small ones; many trees over many rows
    go through the model itself. Rows of equal keys are added up. Without trees there are no rows.
    """
    at = nodes.select("tree", F.col("id").alias("at"), "left", "right", "feature", "threshold", F.col("weight") * F.col("prediction") * scale)
    at = at.toDF("tree", "at", "left", "right", "feature", "threshold", "value")
    roots = nodes.groupBy("tree").agg(F.min("id").alias("at"))
    depth, level = 0, roots.select("tree", "at")
    while True:  # over the nodes alone
        level = level.join(at, ["tree", "at"]).where("left >= 0").select("tree", F.explode(F.array("left", "right")).alias("at"))
        if level.isEmpty():
            break
        depth += 1
    start = roots.agg(F.collect_list(F.struct("tree", "at")).alias("trees")).scalar()
    walk = df.select(*key, F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.explode(start).alias("s"))
    walk = walk.select(*key, "x", "s.tree", "s.at")
    for _ in range(depth):
        goes = F.when(F.get("x", F.col("feature").cast("int")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        walk = walk.join(at, ["tree", "at"]).select(*key, "x", "tree", F.when(F.col("left") < 0, F.col("at")).otherwise(goes).alias("at"))
    return walk.join(at, ["tree", "at"]).groupBy(*key).agg(F.sum("value").alias("margin"))
