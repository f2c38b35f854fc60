"""Splits and scores for binary classifiers. Input rows carry ``label`` (0/1) and ``score`` in [0, 1].

Curves are computed over one row per distinct score, ordered through nested score ranges, so no task
sorts the whole table and rows with equal scores never have to be told apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.plans.scale import exact_quantiles, ranked, running_totals, score_totals, unit_levels, with_time_levels
from telemetra.session import materialize

# Threshold grid in hundredths, precision floor, top shares, stability limits, warning shares.
GRID = (5, 95)
PRECISION_FLOOR = 0.40
TOP_SHARES = [0.005, 0.01, 0.02]
STABILITY = [(0.01, "excellent"), (0.03, "good"), (0.05, "moderate")]
MI_WARNING, IMPORTANCE_WARNING = 0.30, 0.40
BACKTEST_ROWS = 2000


def _positives(label: str = "label") -> dict[str, Column]:
    return {"pos": (F.col(label) == 1).cast("bigint"), "neg": (F.col(label) == 0).cast("bigint")}


def time_ranked(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Adds ``rn``, the position in time order, and ``total``, the number of rows.

    ``order_by`` starts with the time column.
    """
    order = list(order_by)
    return ranked(with_time_levels(df, order[0]), order, ["_hour", "_minute"], total="total").drop("_hour", "_minute")


def chrono_split(df: DataFrame, order_by: Sequence[str], frac: float = 0.75) -> DataFrame:
    """Adds ``split``: the first ``int(n * frac)`` rows in time order are train, the rest test."""
    train_row = F.col("rn") <= F.floor(F.col("total") * frac)
    return time_ranked(df, order_by).withColumn("split", F.when(train_row, "train").otherwise("test")).drop("rn", "total")


def cv_folds(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """Forward-chaining folds: adds ``fold`` (1..n) and ``part``; fold i tests on block i and trains on all before.

    Rows repeat once per fold they belong to.
    """
    total = F.col("total")
    size = F.floor(total / (n + 1))
    folds = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("fold")
    rows = time_ranked(df, order_by).select("*", folds)
    start = total - (n + 1 - F.col("fold")) * size
    part = F.when(F.col("rn") <= start, "train").when(F.col("rn") <= start + size, "test")
    return rows.withColumn("part", part).filter(F.col("part").isNotNull()).drop("rn", "total")


def fold_stability(fold_auc: DataFrame) -> DataFrame:
    """Mean and population deviation of per-fold AUCs, and a word for the spread."""
    out = fold_auc.agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))
    word = F.coalesce(*[F.when(F.col("std_auc") < limit, w) for limit, w in STABILITY], F.lit("poor"))
    return out.withColumn("stability", word)


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and F2 at every threshold of the grid.

    Each row falls into one of 92 steps; 92 sums are then accumulated from the top.
    """
    low, high = GRID
    steps = high - low + 1
    guess = F.floor(F.col("score") * 100).cast("int")

    def at(i: Column) -> Column:
        return i / F.lit(100.0)

    # the guess may be off by one in the last bit, the comparison decides
    step = F.when(F.col("score") >= at(guess + 1), guess + 1).when(F.col("score") >= at(guess), guess).otherwise(guess - 1)
    step = F.least(F.greatest(step, F.lit(low - 1)), F.lit(high))
    sums = scored.groupBy(step.alias("step")).agg(*[F.sum(c).alias(k) for k, c in _positives().items()])
    grid = scored.sparkSession.range(low - 1, high + 1).select(F.col("id").cast("int").alias("step"))
    full = grid.join(sums, "step", "left").select(
        "step", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg")
    )
    down = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)  # 92 rows
    everything = Window.partitionBy()
    t = full.select(
        "step",
        F.sum("pos").over(down).alias("tp"),
        F.sum("neg").over(down).alias("fp"),
        F.sum("pos").over(everything).alias("p"),
    ).filter(F.col("step") >= low)
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0)
    t = t.select((F.col("step") / 100.0).alias("threshold"), precision.alias("precision"), recall.alias("recall"))
    pr = F.col("precision") * F.col("recall")

    def f_beta(b2: int) -> Column:
        below = b2 * F.col("precision") + F.col("recall")
        return F.when(below > 0, (1 + b2) * pr / below).otherwise(0.0)

    assert steps == 91
    return t.select("*", f_beta(1).alias("f1"), f_beta(4).alias("f2"))


def best_threshold(sweep: DataFrame, floor: float = PRECISION_FLOOR) -> DataFrame:
    """Best F1, then precision, then recall, among rows above the precision floor (all rows if none is)."""
    above = (F.col("precision") >= floor).cast("int")
    order = [F.desc(above), F.desc("f1"), F.desc("precision"), F.desc("recall"), F.asc("threshold")]
    return sweep.orderBy(*order).limit(1)


def confusion(scored: DataFrame, threshold: float | Column = 0.5) -> DataFrame:
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0)
    return scored.groupBy("label", predicted.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def roc_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; equal scores count half. With ``by`` one row a group, all from one ranking.

    Null for a group with one class only.
    """
    t = score_totals(scored, "score", _positives(), by)
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    pairs = F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))
    return t.groupBy(*by).agg((wins / pairs).alias("roc_auc"))


def _with_counts(scored: DataFrame) -> DataFrame:
    """Per distinct score: ``tp`` and ``fp`` of the rows at or above it, and the class totals ``t``."""
    t = materialize(score_totals(scored, "score", _positives()), "curve")
    sums = t.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t")).scalar()
    t = t.withColumn("t", sums)
    return t.withColumn("tp", F.col("t.p") - F.col("before_pos")).withColumn("fp", F.col("t.n") - F.col("before_neg"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum of precision times the gain in recall over descending distinct scores."""
    t = _with_counts(scored)
    gain = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return t.agg((F.sum(gain) / F.sum("pos")).alias("average_precision"))


def roc_points(scored: DataFrame) -> DataFrame:
    """(score, tpr, fpr, precision) per distinct score, for curves."""
    tp, fp = F.col("tp"), F.col("fp")
    return _with_counts(scored).select(
        "score", (tp / F.col("t.p")).alias("tpr"), (fp / F.col("t.n")).alias("fpr"), (tp / (tp + fp)).alias("precision")
    )


def precision_at(scored: DataFrame, tie_order: Sequence[str], shares: Sequence[float] = TOP_SHARES) -> DataFrame:
    """Precision among the top shares of rows, max(1, int(n * share)) each.

    Equal scores follow ``tie_order`` (its first column a time). A score that many rows share is split
    further by minute, so even one score for a third of the table is ranked in small windows.
    """
    b1, b2 = unit_levels("score")
    rows = with_time_levels(
        scored.withColumn("_b1", -b1).withColumn("_b2", -b2).withColumn("_s", -F.col("score")), tie_order[0]
    )
    levels = ["_b1", "_b2", "_s", "_hour", "_minute"]
    cells = rows.groupBy(*levels).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == 1).cast("bigint")).alias("pos")
    )
    cells = materialize(cells, "cells")
    total = cells.agg(F.sum("n").alias("n")).scalar()
    cells = running_totals(cells, levels, ["n"], stored=True)
    wanted = F.explode(
        F.array(
            *[
                F.struct(F.lit(s).alias("share"), F.greatest(F.lit(1), F.floor(total * s)).cast("bigint").alias("k"))
                for s in shares
            ]
        )
    ).alias("q")
    whole = cells.select(*levels, "n", "pos", "before_n", wanted).filter(F.col("before_n") < F.col("q.k"))
    end = F.col("before_n") + F.col("n")
    full = whole.filter(end <= F.col("q.k")).select("q.share", "q.k", "pos")
    # the one cell per share that is cut: only its rows are ranked
    cut = whole.filter(end > F.col("q.k")).select(
        *levels, F.col("q.share").alias("_share"), F.col("q.k").alias("_k"), (F.col("q.k") - F.col("before_n")).alias("_take")
    )
    order = Window.partitionBy("_share").orderBy(*tie_order)
    partly = (
        rows.join(cut, levels)
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= F.col("_take"))
        .select(F.col("_share").alias("share"), F.col("_k").alias("k"), (F.col("label") == 1).cast("bigint").alias("pos"))
    )
    return full.unionByName(partly).groupBy("share", "k").agg((F.sum("pos") / F.col("k")).alias("precision"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and positive rate per quantile bin; a score on an inner cut belongs to the lower bin."""
    inner = exact_quantiles(scored, "score", [i / bins for i in range(1, bins)])
    cuts = inner.agg(F.array_sort(F.collect_list("value")).alias("cuts")).scalar()  # bins - 1 values
    binned = (
        scored.groupBy("score")
        .agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == 1).cast("bigint")).alias("pos"))
        .withColumn("cuts", cuts)
        .withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("score"))).cast("bigint"))
    )
    return binned.groupBy("bin").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean_score"),
        (F.sum("pos") / F.sum("n")).alias("positive_rate"),
    )


def score_histogram(scored: DataFrame, bins: int = 50) -> DataFrame:
    """Rows per label and equal-width score bin between the extreme scores (the top edge joins the last bin)."""
    ends = scored.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi")).alias("e")).scalar()
    s = scored.withColumn("e", ends)
    width = F.col("e.hi") - F.col("e.lo")
    pos = F.when(width > 0, F.floor((F.col("score") - F.col("e.lo")) / width * bins)).otherwise(0)
    return s.groupBy("label", F.least(pos, F.lit(bins - 1)).cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def backtest_tail(scored: DataFrame, order_by: Sequence[str], rows: int = BACKTEST_ROWS) -> DataFrame:
    """The newest rows, for the backtest view."""
    return scored.orderBy(*[F.desc(c) for c in order_by]).limit(rows)


def mutual_information(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each feature with the label over its quantile bins, and its share.

    A binned estimate: values differ from nearest-neighbour estimators, the ranking purpose is the same.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    )
    counts = (
        df.select("label", pairs.alias("x"))
        .groupBy(F.col("x.column").alias("column"), F.col("x.v").alias("v"), "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    long = df.select(pairs.alias("x")).select("x.column", "x.v")
    cuts = (
        exact_quantiles(long, "v", [i / bins for i in range(1, bins)], ["column"])
        .groupBy("column")
        .agg(F.array_sort(F.collect_list("value")).alias("cuts"))
    )
    cell = (
        counts.join(cuts, "column")
        .withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("v"))))
        .groupBy("column", "bin", "label")
        .agg(F.sum("n").cast("double").alias("n"))
    )
    # at most bins x labels rows per feature from here on
    of = Window.partitionBy("column")
    total = F.sum("n").over(of)
    marginal = F.sum("n").over(Window.partitionBy("column", "bin")) * F.sum("n").over(Window.partitionBy("column", "label"))
    term = F.col("n") / total * F.log(F.col("n") * total / marginal)
    mi = cell.select("column", term.alias("t")).groupBy("column").agg(F.greatest(F.lit(0.0), F.sum("t")).alias("mutual_info"))
    share = F.col("mutual_info") / F.nullif(F.sum("mutual_info").over(Window.partitionBy()), F.lit(0.0))
    return mi.withColumn("share", share).withColumn("dominates", F.col("share") > MI_WARNING)


def edge_rates(normal: DataFrame, anomaly: DataFrame, threshold: float) -> DataFrame:
    """Rates of one threshold on an all-normal and an all-positive set."""
    hit = (F.col("score") >= threshold).cast("bigint")
    both = normal.select(F.lit(0).alias("k"), "score").unionAll(anomaly.select(F.lit(1), "score"))

    def of(k: int, c: Column) -> Column:
        return F.when(F.col("k") == k, c)

    t = both.agg(
        F.count(of(0, hit)).alias("n0"),
        F.count(of(1, hit)).alias("n1"),
        F.sum(of(0, hit)).alias("fp"),
        F.sum(of(1, hit)).alias("tp"),
        F.avg(of(0, F.col("score"))).alias("normal_avg_score"),
        F.avg(of(1, F.col("score"))).alias("downtime_avg_score"),
    )
    c = F.col
    return t.select(
        ((c("n0") - c("fp")) / c("n0")).alias("tn_rate"),
        (c("fp") / c("n0")).alias("fp_rate"),
        (c("tp") / c("n1")).alias("tp_rate"),
        ((c("n1") - c("tp")) / c("n1")).alias("fn_rate"),
        ((c("n0") - c("fp") + c("tp")) / (c("n0") + c("n1"))).alias("accuracy"),
        "normal_avg_score",
        "downtime_avg_score",
    )
