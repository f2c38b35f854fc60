"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.session import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(pairs: DataFrame, keep) -> DataFrame:
    """Links the kept neighbours of every node to the smallest of node and neighbours. Hot nodes are joined, not
    gathered: the minimum combines before the shuffle and the join may split a hot key."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u").where(keep).select(F.col("v"), F.col("m").alias("u")).where("u != v")


def _settled(now: DataFrame) -> bool:
    """Whether ``now`` (u < v) is a set of separate stars: no node has two smaller ones, none is both end and centre.
    One shuffle of counts that combine before it, where a further round takes six."""
    ends = now.select(F.col("v").alias("node"), F.lit(1).alias("end"), F.lit(0).alias("centre"))
    both = ends.union(now.select(F.col("u").alias("node"), F.lit(0).alias("end"), F.lit(1).alias("centre")))
    seen = both.groupBy("node").agg(F.sum("end").alias("end"), F.max("centre").alias("centre"))
    return seen.where(F.col("end") + F.col("centre") > 1).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node it reaches) for every node of ``edges`` (u, v: long).

    Each round is written to the shared scratch folder, so lineage stays short and a lost executor costs one
    round. Ends when every component is a star around its smallest node, which may be so before the first round; no
    rows in, no rows out.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).where("u < v").distinct(), "edges")
    while not _settled(now):
        large = _stars(_both(now), F.col("v") > F.col("u"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(least, "u")
        small = linked.where("v != m").select("v", F.col("m").alias("u")).union(least.select(F.col("u").alias("v"), F.col("m").alias("u")))
        now = materialize(small.where("u != v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct(), "edges")
    tops = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(tops)
