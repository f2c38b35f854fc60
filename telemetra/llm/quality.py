"""Quality rules and an isolation forest over their statistics.

Every whole text gives exact rule statistics. Two fixed rules fail a document outright. The rest is judged by an
isolation forest: trees that split random statistics at random values, in which unusual rows end after few splits.
The anomaly score comes from the mean path length; the threshold is where labelled good and bad rows part best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm.common import Words, documents, mix, start_task, table, worker_cache
from telemetra.session import materialize

REPEAT = 8
TREES, SUBSAMPLE = 128, 256
SEED = 7
MIN_WORDS, MAX_REPEAT = 20, 30  # words; percent of words in repeated windows
GOOD_KEPT = 0.995  # of the labelled good rows, at least, that the threshold keeps
BINS = 2000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbols", "dup_lines", "repeats", "distinct", "capitals", "digits", "marks", "line_words"]
STATS = ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS], "features array<double>"])

_words = Words()
worker_cache(_words.known.clear)
_SPACE = b" \t\n\x0b\x0c\r"
_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b".,;:!?|\"'()[]{}<>#*$%&/\\=+-_~^@`"


def repeated_words(words: list[bytes], size: int = REPEAT) -> int:
    """Words that lie in a window of ``size`` words found twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = _words.hashes(words)
    with np.errstate(over="ignore"):
        windows = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            windows = mix(windows * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    _, first, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[first] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + size, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts and the forest's features of a whole text. Without words all are zero."""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, _SPACE)))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    counts = [n, chars, symbols, len(lines) - len(set(lines)), repeats]
    if not n:
        return counts, [0.0] * len(FEATURES)
    share = lambda chosen: (len(data) - len(data.translate(None, chosen))) / len(data)
    features = [
        math.log1p(n), chars / n, symbols / n, counts[3] / len(lines), repeats / n, len(set(words)) / n ** 0.9,
        share(_CAPITALS), share(_DIGITS), share(_MARKS), math.log1p(n / len(lines)),
    ]
    return counts, features


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    start_task()
    for batch in batches:
        made = [statistics(t.as_py()) for t in batch.column("text")]
        columns = [pa.array([m[0][i] for m in made], pa.int64()) for i in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns, pa.array([m[1] for m in made], pa.list_(pa.float64()))],
            names=["doc_id", *COUNTS, "features"],
        )


def rule_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts and ``features`` of every row. Null texts have no words."""
    return documents(docs).mapInArrow(_measure, STATS)


class Forest:
    """Isolation trees as flat arrays: split feature (-1 for a leaf), value, left child (right is next), path length."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = min(size, len(rows))
        self.scale = expected(size)
        self.trees = [self.grow(rows[rng.choice(len(rows), size, replace=False)], rng) for _ in range(trees if size > 1 else 0)]

    @staticmethod
    def grow(rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        limit = math.ceil(math.log2(max(2, len(rows))))
        feature, value, left, path = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            node, own, depth = todo.pop()
            varied = np.flatnonzero(own.max(axis=0) > own.min(axis=0)) if len(own) > 1 and depth < limit else []
            if not len(varied):
                path[node] = depth + expected(len(own))
                continue
            f = int(rng.choice(varied))
            cut = rng.uniform(own[:, f].min(), own[:, f].max())
            feature[node], value[node], left[node] = f, cut, len(feature)
            below = own[:, f] < cut
            for side in (below, ~below):
                todo.append((len(feature), own[side], depth + 1))
                for column, x in ((feature, -1), (value, 0.0), (left, 0), (path, 0.0)):
                    column.append(x)
        return np.array(feature), np.array(value), np.array(left), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected): near 1 for rows that splits isolate at once."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, value, left, path in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = rows[every, np.maximum(f, 0)] >= value[at]
                at = np.where(inner, left[at] + right, at)
            total += path[at]
        return 2.0 ** (-total / (len(self.trees) * self.scale))


def expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def fit(stats: DataFrame, trees: int = TREES, size: int = SUBSAMPLE) -> Forest:
    """A forest over at most ``trees * size`` rows, those whose ids hash lowest: the method fits subsamples, whatever
    the number of rows. The bound of the hash follows from the row count, so that a partition sends its share of
    the sample to the driver and not a whole one; too low a bound is doubled."""
    wanted, order = trees * size, F.xxhash64("doc_id")
    able = stats.where("n_words > 0")
    total = able.count()
    share = min(1.0, 1.25 * wanted / max(total, 1))
    while True:
        low = able if share >= 1 else able.where(order <= F.lit(int(-(2**63) + share * 2**64)))
        rows = low.orderBy(order, "doc_id", "features").limit(wanted).select("features").collect()
        if share >= 1 or len(rows) == wanted:
            break
        share = min(1.0, 2 * share)
    return Forest(np.array([r[0] for r in rows], dtype=float).reshape(-1, len(FEATURES)), trees, size)


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = held.value
        for batch in batches:
            rows = np.array(batch.column("features").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
            kept = [batch.column(c) for c in ("doc_id", *COUNTS)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(forest.score(rows))], names=["doc_id", *COUNTS, "anomaly"])

    return run


def anomalies(stats: DataFrame, forest: Forest) -> DataFrame:
    held = stats.sparkSession.sparkContext.broadcast(forest)  # trees * (2 * size) nodes
    schema = ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS], "anomaly double"])
    return stats.mapInArrow(_score(held), schema)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The anomaly above which a document is rejected: of all thresholds that keep ``GOOD_KEPT`` of the labelled good
    rows the one with the most right verdicts. Counted over all labelled rows in BINS steps; only rows that the fixed
    rules pass count. Without labelled bad rows nothing is rejected."""
    marked = labels.where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    bins = F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).cast("int")
    counted = scored.where(~base_failed()).join(marked, "doc_id").groupBy(bins.alias("bin"), "quality").count().collect()
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for r in counted:
        (good if r["quality"] else bad)[r["bin"]] += r["count"]
    if not bad.sum():
        return 1.0
    kept = np.cumsum(good)  # a threshold after bin i keeps bins 0..i
    right = kept + bad.sum() - np.cumsum(bad)
    right[kept < GOOD_KEPT * good.sum()] = -1
    return float((int(np.argmax(right)) + 1) / BINS)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``anomaly``, ``base_failed`` and ``kept`` of every row.

    Null, empty and blank texts fail the fixed rules. Repeated rows are each judged; labels of unknown documents or
    without a quality are not used; an empty table gives no rows.
    """
    stats = materialize(rule_statistics(docs), "statistics")
    scored = materialize(anomalies(stats, fit(stats)), "scored")  # read for the threshold and for the verdicts
    limit = threshold(scored, labels)
    return scored.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("anomaly") < limit)
    )


def op8_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("anomaly")
