"""Language identification with language-bitmask n-gram filters.

Training counts letter n-grams per language. An n-gram belongs to every language in which it is about as frequent as
in the one that uses it most. Memberships go into one bit-sliced Bloom filter: slot i holds one bit a language, and
the AND over an n-gram's slots is the mask of all languages that contain it. A text's n-grams are looked up once; the
per-language popcounts, less the share that false positives explain, decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetra.llm.common import documents, fold, start_task, table
from telemetra.session import materialize

SIZES = (3, 4)
SLOT_BITS = 20
PROBES = 3
KEEP = 1 << 16  # n-grams a language's slice holds, the most frequent first
SHARE = 0.25  # of the highest relative frequency that makes an n-gram part of a language
UNKNOWN = "und"
HELD = 1_000_000  # n-grams a task collects before it counts them; a longer text is counted on its own
ROWS = 10_000  # of a batch it yields

_letters: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_table() -> np.ndarray:
    """For each code point: itself if a letter, else a space."""
    if not _letters:
        points = np.arange(0x110000, dtype=np.uint32)
        is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        _letters.append(np.where(is_letter, points, np.uint32(32)))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """Hashes of the letter n-grams of a whole text, words bounded by one space; empty without a letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32)
    points = letter_table()[points]
    space = points == 32
    points = points[np.r_[True, ~(space[1:] & space[:-1])]]
    if len(points) < 3:
        return np.zeros(0, dtype=np.uint64)
    wide, out = points.astype(np.uint64), []
    inner = points == 32
    for n in SIZES:
        m = len(wide) - n + 1
        if m < 1:
            continue
        h, keep = np.full(m, np.uint64(n)), np.ones(m, dtype=bool)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + m]
            if 0 < k < n - 1:
                keep &= ~inner[k : k + m]
        out.append(_mix(h[keep]))
    return np.concatenate(out)


def slots(h: np.ndarray, k: int) -> np.ndarray:
    """Probe k of each n-gram: a slice of its hash."""
    return ((h >> np.uint64(SLOT_BITS * k)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "gram", "n"]
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            parts.clear()
            for at in range(0, len(found), ROWS):
                own, times = found[at : at + ROWS].view(np.int64), n[at : at + ROWS].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(own)), pa.array(own), pa.array(times)], names=names)
        held.clear()

    start_task()
    with np.errstate(over="ignore"):
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                own = grams(text.as_py())
                held.setdefault(lang, []).append(own)
                size += len(own)
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()


class Filter:
    """The bit-sliced filter: languages, one row of slots for each 63 of them, and the fill of each slice."""

    def __init__(self, languages: list[str], rows: list[tuple[int, int, int]]):
        self.languages = languages
        self.words = np.zeros((max(1, -(-len(languages) // 63)), 1 << SLOT_BITS), dtype=np.int64)
        for word, slot, mask in rows:
            self.words[word, slot] = mask
        fill = [np.mean(self.words[i // 63] >> np.int64(i % 63) & 1) for i in range(len(languages))]
        self.false = np.array(fill) ** PROBES

    def shares(self, h: np.ndarray) -> np.ndarray:
        """For each language the share of n-grams it contains, less what false positives explain."""
        at = [slots(h, k) for k in range(PROBES)]
        hits = []
        for words in self.words:
            mask = words[at[0]]
            for a in at[1:]:
                mask = mask & words[a]
            hits.append(mask)
        found = [np.count_nonzero(hits[i // 63] >> np.int64(i % 63) & 1) for i in range(len(self.languages))]
        return np.clip((np.array(found) / len(h) - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)

    def predict(self, text: str) -> tuple[str, float]:
        h = grams(text)
        if not len(h) or not self.languages:
            return UNKNOWN, 0.0
        shares = self.shares(h)
        best = int(np.argmax(shares))
        return self.languages[best], float(shares[best])


def fit(labelled: DataFrame) -> Filter:
    """The filter of rows with ``text`` and a non-null ``lang``. Counts cover every row and combine before the
    shuffle; what reaches the driver is the filter itself, 2**SLOT_BITS slots at most for each 63 languages."""
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = [r[0] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    number = spark.createDataFrame([(x, i) for i, x in enumerate(languages)], "lang string, language int")
    # one row for each language and n-gram: the window holds one row a language
    same = Window.partitionBy("gram")
    rate = F.col("n") / F.col("total")
    shared = counts.join(F.broadcast(totals), "lang").select("lang", "gram", "n", rate.alias("rate"))
    shared = shared.withColumn("most", F.max("rate").over(same)).where((F.col("rate") >= SHARE * F.col("most")) & (F.col("n") > 1))
    # the KEEP most frequent of each language; ranks within hash parts first, so no task sorts a whole language
    part = Window.partitionBy("lang", F.pmod("gram", F.lit(64))).orderBy(F.desc("n"), "gram")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    some = shared.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= KEEP)
    some = some.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= KEEP)
    probes = F.array(*[F.shiftrightunsigned("gram", SLOT_BITS * k).bitwiseAND((1 << SLOT_BITS) - 1) for k in range(PROBES)])
    bits = some.join(F.broadcast(number), "lang").select(
        F.floor(F.col("language") / 63).cast("int").alias("word"), F.expr("shiftleft(1L, language % 63)").alias("bit"), F.explode(probes).alias("slot")
    )
    filled = bits.groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).collect()
    return Filter(languages, [tuple(r) for r in filled])


_PREDICTED = "doc_id long, lang_pred string, score double"


def _predict(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task()
        own: Filter = held.value
        with np.errstate(over="ignore"):
            for batch in batches:
                made = [own.predict(t.as_py()) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    return run


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row from its whole text. A text that is null, empty or without a letter
    is ``und`` with score 0, as is everything if nothing was learned. Equal shares go to the language first by name.
    Repeated rows are each predicted; an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # slots, not n-grams: of fixed size
    return documents(docs).mapInArrow(_predict(held), _PREDICTED)


def keeping(held, least: float):
    """For ``mapInArrow`` on rows with a text: keeps, with all columns, those whose language is recognised with a
    score of ``least`` or more. ``held`` is the broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task()
        own: Filter = held.value
        with np.errstate(over="ignore"):
            for batch in batches:
                made = [own.predict(t.as_py() or "") for t in batch.column("text")]
                yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in made], pa.bool_()))

    return run


def learning_rows(docs: DataFrame) -> DataFrame:
    """The rows the query may learn from: fold of three other than 1."""
    return docs.where(fold("doc_id", 3) != 1)


def op6_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(learning_rows(docs)))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
