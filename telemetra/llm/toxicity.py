"""Toxicity by Levenshtein automata over a learned lexicon trie, with context windows.

The lexicon is learned from labelled rows: words found far more often in toxic documents than chance allows. For each
word of a text a Levenshtein automaton is run down the lexicon trie, so only prefixes that can still be within the
allowed distance are followed; it finds the terms a misspelled word may stand for. Every match is weighed by a window
of words around it: quotation marks and reporting verbs speak for quotation, second person for abuse. A logistic
model over these sums gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm.common import documents, fold, table
from telemetra.session import materialize

EVIDENCE = 20.0  # log-likelihood ratio that makes a word a term
TERMS = 4096  # terms of the lexicon, the best first
ID_BITS = 24  # size of the bitmap of labelled ids: 2 MB
SAMPLE = 40_000  # labelled rows the logistic model is fitted on, at most
AROUND = 6  # words on either side that count as context
SHORTEST = 4  # letters of a word that may be a misspelling
EDITS = 1  # edits of a misspelling

WORD = re.compile(r"[^\W_]+")
QUOTES = re.compile("[\"“”„«»‘’]")
#: fixed values: words that report speech, and words that address someone
REPORTING = frozenset("said says wrote writes called quoted quote quotes reported claimed sagte schrieb nannte zitierte dit écrit dijo escribió".split())
ADDRESSING = frozenset("you your yours you're du dich dir ihr euch tu te vous ton tú usted tus".split())
FEATURES = ["exact", "misspelled", "exact_quoted", "misspelled_quoted", "addressed", "density", "any"]


class Trie:
    """The lexicon as nested dictionaries; the empty key holds the term."""

    def __init__(self, terms):
        self.root: dict = {}
        self.terms = set(terms)
        for term in self.terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term

    def within(self, word: str, most: int = EDITS) -> list[str]:
        """All terms at a distance of at most ``most``. A state of the word's automaton is a place in the word and the
        edits used so far; it walks the trie along with a node. A branch without a step to take is dead, so only
        prefixes that can still be within reach are followed."""
        found, size = set(), len(word)
        todo = [(self.root, 0, 0)]
        while todo:
            node, i, used = todo.pop()
            if i == size and "" in node:
                found.add(node[""])
            if i < size and word[i] in node:
                todo.append((node[word[i]], i + 1, used))
            if used == most:
                continue
            if i < size:
                todo.append((node, i + 1, used + 1))  # a letter too many
            # with the last edit, the letter after it must fit at once
            last = used + 1 == most
            here = word[i] if i < size else ""
            after = word[i + 1] if i + 1 < size else ""
            for c, child in node.items():
                if c:
                    if not last or here in child:  # a letter missing
                        todo.append((child, i, used + 1))
                    if here and c != here and (not last or after in child):  # another letter
                        todo.append((child, i + 1, used + 1))
        return list(found)


class Lexicon:
    """Terms with their weights, and words near a term that are known to be harmless."""

    def __init__(self, weights: dict[str, float], harmless: frozenset[str] = frozenset()):
        self.weights, self.harmless = weights, harmless
        long = [t for t in weights if len(t) >= SHORTEST]
        self.trie = Trie(long)
        # one edit leaves the first or the second half of a term as it is: other words need no automaton
        self.heads = {t[: len(t) // 2] for t in long}
        self.tails = {t[len(t) // 2 :] for t in long}
        self.sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})
        self.clean: set[str] = set()

    def resembles(self, word: str) -> list[str]:
        """Terms that the word may be a misspelling of."""
        heads, tails = self.heads, self.tails
        if len(word) < SHORTEST or not (
            any(word[:k] in heads for k in self.sizes[0]) or any(word[-k:] in tails for k in self.sizes[1])
        ):
            return []
        return self.trie.within(word)

    def matches(self, words: list[str]) -> dict[str, tuple[float, bool]]:
        """The words that match: weight, and whether misspelled."""
        out = {}
        if len(self.clean) > 400_000:
            self.clean.clear()
        for w in set(words) - self.clean:
            if w in self.weights:
                out[w] = (self.weights[w], False)
                continue
            near = [] if w in self.harmless else self.resembles(w)
            if near:
                out[w] = (max(self.weights[t] for t in near), True)
            else:
                self.clean.add(w)
        return out

    def features(self, text: str) -> list[float]:
        """Sums over the matches of a whole text; all zero without a match."""
        low = text.lower()
        words = WORD.findall(low)
        match = self.matches(words)
        sums = [0.0] * len(FEATURES)
        if not match:
            return sums
        found = [(i, *match[w]) for i, w in enumerate(words) if w in match]
        spans = [m.span() for m in WORD.finditer(low)]
        for i, weight, misspelled in found:
            a, b = max(0, i - AROUND), min(len(words), i + AROUND + 1)
            before, after = low[spans[a][0] : spans[i][0]], low[spans[i][1] : spans[b - 1][1] + 1]
            quoted = bool(QUOTES.search(before) and QUOTES.search(after)) or not REPORTING.isdisjoint(words[a:b])
            sums[(2 if quoted else 0) + misspelled] += weight
            sums[4] += not quoted and not ADDRESSING.isdisjoint(words[a:b])
        n = len(found)
        return [math.log1p(s) for s in sums[:5]] + [min(1.0, 20 * n / len(words)), 1.0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            marks = some.column("toxic").to_pylist()
            counts: dict[str, list[int]] = {"": [marks.count(0), marks.count(1)]}  # no word is empty: the documents
            for words, toxic in zip(some.column("words").to_pylist(), marks):
                for w in words:
                    counts.setdefault(w, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())],
                names=["word", "clean", "toxic"],
            )


def _distinct(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((bits[slot >> 6] >> (slot & 63) & 1).astype(bool)))
            made = [list(set(WORD.findall(t.as_py().lower()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.list_(pa.string()))], names=["doc_id", "words"])

    return run


def _slot(doc_id: str = "doc_id"):
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << ID_BITS)).cast("long")


def id_bits(marks: DataFrame) -> np.ndarray:
    """A bitmap of 2**ID_BITS hashed ids. It says surely which rows have no label; the join settles the others."""
    slots = marks.select(_slot().alias("slot"))
    words = slots.groupBy(F.expr("slot div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    out = np.zeros((1 << ID_BITS) // 64, dtype=np.int64)
    found = words.toArrow()  # 2**ID_BITS / 64 rows at most
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out


def marked(labels: DataFrame) -> DataFrame:
    return labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``toxic`` and the distinct ``words`` of whole texts with a label. A row that repeats an id counts again, with each
    of its labels. A bitmap of ids, of fixed size, leaves out most rows without a label; what is then dealt out by id are
    words, not texts, the same way at every size."""
    marks = marked(labels)
    held = docs.sparkSession.sparkContext.broadcast(id_bits(marks))
    words = documents(docs).withColumn("slot", _slot()).mapInArrow(_distinct(held), "doc_id long, words array<string>")
    return words.join(marks.hint("merge"), "doc_id").select("words", "toxic")


def learn(rows: DataFrame) -> Lexicon:
    """The lexicon of labelled rows (words, toxic). Document counts of all words combine before the shuffle; the
    driver gets the TERMS best terms and the harmless words that resemble them."""
    counts = rows.mapInArrow(_counted, "word string, clean long, toxic long")
    counts = counts.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts.where("clean + toxic > 1"), "words")
    size = counts.where("word = ''").first()
    bad, good = (size["toxic"], size["clean"]) if size else (0, 0)
    if not bad or not good:
        return Lexicon({})
    counts = counts.where("word <> ''")
    share = bad / (bad + good)

    def part(n: str, expected: float):
        return F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (expected * (F.col("clean") + F.col("toxic"))))).otherwise(0.0)

    ratio = 2 * (part("toxic", share) + part("clean", 1 - share))
    odds = F.log(((F.col("toxic") + 0.5) / (bad + 1)) / ((F.col("clean") + 0.5) / (good + 1)))
    best = counts.select("word", ratio.alias("ratio"), odds.alias("odds"))
    best = best.where((F.col("ratio") >= EVIDENCE) & (F.col("odds") > 2)).orderBy(F.desc("ratio"), "word").limit(TERMS)
    weights = {r["word"]: float(r["odds"]) for r in best.collect()}
    # words that resemble a term but are at home in clean documents: a few spellings a term
    trie = counts.sparkSession.sparkContext.broadcast(Lexicon(weights))

    def resembling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = trie.value
        for batch in batches:
            near = [w for w in batch.column("word").to_pylist() if w not in lexicon.weights and lexicon.resembles(w)]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], names=["word"])

    usual = counts.where(F.col("clean") * share >= F.col("toxic") * (1 - share)).select("word")
    harmless = frozenset(r["word"] for r in usual.mapInArrow(resembling, "word string").collect()) if weights else frozenset()
    return Lexicon(weights, harmless)


def logistic(rows: np.ndarray, marks: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(rows)), rows])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (marks - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str) -> float:
        z = float(self.weights[0] + np.dot(self.weights[1:], self.lexicon.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _features(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [held.value.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of labelled documents: the lexicon from all of them, the logistic weights from SAMPLE at most (those
    whose ids hash lowest). Without labels of both kinds every score is the same, below one half."""
    lexicon = learn(labelled(docs, labels))
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # TERMS terms
    order = F.xxhash64("doc_id")
    marks = marked(labels)
    chosen = marks.select("doc_id").distinct().orderBy(order, "doc_id").limit(SAMPLE)
    sample = documents(docs).join(F.broadcast(marks.join(F.broadcast(chosen), "doc_id", "left_semi")), "doc_id").select("text", "toxic")
    made = sample.mapInArrow(_features(held), "toxic int, x array<double>").toPandas()
    marks = made["toxic"].to_numpy(dtype=float)
    if not len(marks) or marks.min() == marks.max():
        return Model(Lexicon({}), np.array([-3.0] + [0.0] * len(FEATURES)))
    return Model(lexicon, logistic(np.array(made["x"].tolist(), dtype=float), marks))


def _scored(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [held.value.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row from its whole text alone. Null and empty texts get the score of a text without
    a match. Repeated rows are each scored; an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # TERMS terms and a few spellings each
    return documents(docs).mapInArrow(_scored(held), "doc_id long, score double")


def op4_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    scored = score(docs, model).withColumn("held_out", fold("doc_id", 5) == 0)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
