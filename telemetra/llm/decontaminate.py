"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, one scan of every text.

Texts and items are normalised alike (A-Z lower-cased, words of digits, letters a-z and all non-ASCII characters).
The automaton works on word numbers: its keys are the items' windows of ten words. Word positions lead back to
code points of the original text.

The items are read in shards of a bounded number of characters. Almost always there is one; with more, the
documents are scanned once a shard and the marks are carried along, so a large benchmark is never held whole.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm.common import documents, start_task, table, worker_cache
from telemetra.session import materialize

WINDOW = 10
SHARD_CHARS = 16_000_000

#: bytes that are no word become spaces, capitals small letters; bytes of non-ASCII characters stay
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
WORD = re.compile(rb"[^ ]+")

SCAN = "doc_id long, text string, n_words long, hits array<int>, items array<string>"


def words(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


class Items:
    """The automaton of some items: numbers of words, and for each window the items that hold it."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        held: dict[tuple, set[str]] = {}
        for item_id, text in items:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words(text))
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                held.setdefault(ids[at : at + window], set()).add(item_id)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, owners in held.items():
            self.automaton.add_word(key, (len(key), sorted(owners)))
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def scan(self, text: str) -> tuple[int, list[int], list[str]]:
        """Number of words, hit ranges as first, end, first, end ... in words, and the items found."""
        found = words(text)
        if self.empty or not found:
            return len(found), [], []
        number, spans, owners = self.number, [], set()
        for end, (size, who) in self.automaton.iter(tuple([number.get(w, 0) for w in found])):
            spans.append((end + 1 - size, end + 1))
            owners.update(who)
        return len(found), merged(spans), sorted(owners)


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted disjoint ranges, flat; ranges that touch are joined."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


_built: dict = {}
worker_cache(_built.clear)


def _scan(items, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task()
        own = _built_once(items, window)
        for batch in batches:
            counts, hits, owners = [], [], []
            for text, hit, items_ in zip(batch.column("text"), batch.column("hits"), batch.column("items")):
                n, spans, who = own.scan(text.as_py())
                old = hit.as_py()
                counts.append(n)
                hits.append(merged([*zip(old[::2], old[1::2]), *zip(spans[::2], spans[1::2])]) if old else spans)
                owners.append(sorted({*items_.as_py(), *who}))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text"), pa.array(counts, pa.int64()),
                    pa.array(hits, pa.list_(pa.int32())), pa.array(owners, pa.list_(pa.string())),
                ],
                names=[x.split()[0] for x in SCAN.split(", ")],
            )

    return run


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Distinct items (id as text, text) and the number of shards they are read in."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    size = items.agg(F.sum(F.length("text") + F.length("item_id") + 1)).first()[0] or 0
    return items, -(-size // SHARD_CHARS) or 1


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text, n_words, hits`` (word ranges, flat) and ``items`` (ids found, sorted as text) of every row.

    Null texts are empty. A null item id is the empty id; rows of one item id are one item. An empty benchmark, or
    items without words, hit nothing. Repeated documents are each scanned; an empty table gives no rows.
    """
    items, shards = _items(benchmark)
    state = documents(docs).selectExpr(
        "doc_id", "text", "0L as n_words", "cast(array() as array<int>) as hits", "cast(array() as array<string>) as items"
    )
    for k in range(shards):
        state = state.mapInArrow(_scan(_held(items, shards, k), window), SCAN)
        if k < shards - 1:
            state = materialize(state, "scanned")
    return state


def _held(items: DataFrame, shards: int, k: int):
    """The items of one shard with a name of their own, broadcast: SHARD_CHARS or one item."""
    mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
    return items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in mine.collect()]))


def _built_once(held, window: int) -> Items:
    """A worker builds the automaton once and keeps the last one."""
    name, items = held.value
    if (name, window) not in _built:
        _built.clear()
        _built[name, window] = Items(items, window)
    return _built[name, window]


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text holds no window of an item."""
    items, shards = _items(benchmark)
    for k in range(shards):
        held = _held(items, shards, k)

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            start_task()
            own = _built_once(held, window)
            for batch in batches:
                yield batch.filter(pa.array([not own.scan(t.as_py() or "")[1] for t in batch.column("text")], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
        if k < shards - 1:
            docs = materialize(docs, "scanned")
    return docs


def _code_points(text, hits):
    data = text.encode()
    at = [m.span() for m in WORD.finditer(data.translate(NORMAL))]
    starts = np.cumsum([0] + [b & 0xC0 != 0x80 for b in data])
    return [(int(starts[at[a][0]]), int(starts[at[b - 1][1]])) for a, b in zip(hits[::2], hits[1::2])]


def hit_spans(scanned: DataFrame) -> DataFrame:
    """Adds ``spans``: the hit passages as code points of the original text, end exclusive."""
    none = F.expr("cast(array() as array<struct<start:long,end:long>>)")
    located = F.udf(_code_points, "array<struct<start:long,end:long>>", useArrow=True)
    return scanned.withColumn("spans", F.when(F.size("hits") > 0, located("text", "hits")).otherwise(none))


def op9_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(sequence(0, size(hits) div 2), 0L, (s, i) -> s + coalesce(get(hits, 2 * i + 1) - get(hits, 2 * i), 0))")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH dl AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bl AS (
  SELECT cast(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bl WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM win),
dwin AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dl, sizes WHERE len(w) >= size)
), hit AS (SELECT DISTINCT doc_id, i, size, item_id FROM dwin JOIN win USING (win, size)),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dl d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
