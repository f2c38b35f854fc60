"""Source divergence audit by single-pass in-memory indexing.

Tasks read documents once and collect postings (term, source, occurrences) of a language in memory. When a block is full
it is spilled as a run: its terms in order, dealt out by hash into shards and cut into chunks. The runs of a shard are
merged over a heap of terms, which opens a chunk only when the merge reaches its first term. More than ``FAN`` runs are
merged in several levels, so the number of open chunks is bounded. The result is one row a kept term and language with
its frequencies by source.

Each group (language, source) then has a smoothed share p of every kept term of its language, in billionths:
1 + floor(10^9 * (count + 1) / (N + V)). The divergence of two groups sums floor((p - q)^2 / q) over *all* kept terms.
Terms in neither group all give the same value, so the sum starts as V times that and is corrected: by the terms of one
group, through the few distinct shares it has, and, streaming over the frequencies, by the terms that both have.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetra.llm.common import table
from telemetra.session import materialize

MIN_DOCS = 3
TOP = 200
#: postings in memory before a block is spilled, up to about 150 bytes each while it is put in order
POSTINGS = 600_000
SHARDS = 1024
#: runs merged at once
FAN = 256
CHUNK = 2048
#: texts are split into words in slices of about this many bytes
SLICE = 4_000_000
ROWS = 512
SLOTS = 16
FLUSH = 200_000

#: bytes that are no letter become spaces, capitals small letters; bytes of non-ASCII characters stay
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

_POSTINGS = "terms array<binary>, docs array<long>, sizes array<int>, sources array<string>, counts array<long>"
RUN = f"shard int, lang string, run string, first binary, {_POSTINGS}"
RUN_COLUMNS = ["shard", "lang", "run", "first", "terms", "docs", "sizes", "sources", "counts"]
FREQUENCY = "lang string, term string, docs long, sources array<string>, counts array<long>"


def tokens(data: bytes) -> pa.Array:
    """The words of normalised bytes, as one Arrow array."""
    inside = np.frombuffer(data, dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    ends = np.concatenate([[0], np.cumsum(edges[1::2] - edges[::2])])
    words = data.translate(None, b" ")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(words)])


def slices(text: str) -> Iterator[bytes]:
    """A whole text, normalised, in slices that end between terms."""
    data = text.encode().translate(LETTERS)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= SLICE else data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def counted(parts: list[bytes], owners: list[int]) -> pa.Table:
    """Postings (group, term, count, docs) of whole normalised texts, each with the number of its group."""
    parts = [p + b" " for p in parts]
    found = tokens(b"".join(parts)).dictionary_encode()
    terms = max(1, len(found.dictionary))
    # words a text: beginnings of words in its bytes
    data = np.frombuffer(b" " + b"".join(parts), dtype=np.uint8) != 32
    begins = np.concatenate([[0], np.cumsum(data[1:] & ~data[:-1])])
    words = np.diff(begins[np.concatenate([[0], np.cumsum([len(p) for p in parts])])])
    texts = np.repeat(np.arange(len(parts), dtype=np.int64), words)
    key, times = np.unique(texts * terms + found.indices.to_numpy(), return_counts=True)
    group = np.array(owners, dtype=np.int64)[key // terms]
    key, at = np.unique(group * terms + key % terms, return_inverse=True)
    count = np.zeros(len(key), dtype=np.int64)
    np.add.at(count, at, times)
    return pa.table({"group": key // terms, "term": found.dictionary.take(pa.array(key % terms)), "count": count, "docs": np.bincount(at, minlength=len(key))})


def long_text(text: str, owner: int) -> pa.Table:
    """Postings of one text that is taken in slices; it is one document."""
    own = [counted([part], [owner]).select(["term", "count"]) for part in slices(text)]
    one = pa.concat_tables(own).group_by("term").aggregate([("count", "sum")])
    return pa.table({"group": np.full(len(one), owner), "term": one["term"], "count": one["count_sum"], "docs": np.ones(len(one), dtype=np.int64)})


class Block:
    """Postings in memory: occurrences and documents by language, source and term."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.tables: list[pa.Table] = []
        self.parts: list[bytes] = []
        self.owners: list[int] = []
        self.waiting = self.size = 0

    def add(self, lang: str, source: str, text: str) -> None:
        owner = self.groups.setdefault((lang, source), len(self.groups))
        if len(text) > SLICE:
            self._take(long_text(text, owner))
        else:
            self.parts.append(text.encode().translate(LETTERS))
            self.owners.append(owner)
            self.waiting += len(self.parts[-1])
            if self.waiting > SLICE:
                self._count()

    def _take(self, postings: pa.Table) -> None:
        self.tables.append(postings)
        self.size += len(postings)

    def _count(self) -> None:
        if self.parts:
            self._take(counted(self.parts, self.owners))
        self.parts, self.owners, self.waiting = [], [], 0

    def run(self, shards: int, name: str) -> Iterator[pa.RecordBatch]:
        """The block as a run: chunks in order of shard, language and term."""
        self._count()
        if not self.size:
            return
        whole = pa.concat_tables(self.tables)
        term = whole["term"].combine_chunks().dictionary_encode()
        names = term.dictionary
        rank = np.empty(len(names), dtype=np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        shard = np.fromiter((zlib.crc32(t) % shards for t in names.to_pylist()), np.int64, len(names))
        langs = sorted({lang for lang, _ in self.groups})
        lang_of = np.array([langs.index(lang) for lang, _ in self.groups])
        group, code = whole["group"].to_numpy(), term.indices.to_numpy()
        part = shard[code] * len(langs) + lang_of[group]  # chunks do not cross these
        entry = part * len(names) + rank[code]
        order = np.lexsort((group, entry))
        entry, group, code, part = entry[order], group[order], code[order], part[order]
        first = np.flatnonzero((np.diff(entry, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
        count, docs = (np.add.reduceat(whole[c].to_numpy()[order], first) for c in ("count", "docs"))
        entry, group, code, part = entry[first], group[first], code[first], part[first]
        starts = np.flatnonzero(np.diff(entry, prepend=-1))  # postings at which a term begins
        part = part[starts]
        # a chunk ends with its part, or at the first term behind a multiple of CHUNK postings
        cuts = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(starts // CHUNK, prepend=-1) != 0))
        sources = pa.array([source for _, source in self.groups], pa.string())
        lists = lambda at, n, values: pa.ListArray.from_arrays(pa.array(np.append(at, n), pa.int32()), values)
        entries = lambda values: lists(cuts, len(starts), values)
        rows = lambda values: lists(starts[cuts], len(entry), values)
        ordered = names.take(pa.array(code[starts])).cast(pa.binary())
        whole = pa.RecordBatch.from_arrays(
            [
                pa.array(part[cuts] // len(langs), pa.int32()), pa.array([langs[k] for k in part[cuts] % len(langs)], pa.string()),
                pa.array([name] * len(cuts), pa.string()), ordered.take(pa.array(cuts)), entries(ordered),
                entries(pa.array(np.add.reduceat(docs, starts), pa.int64())), entries(pa.array(np.diff(np.append(starts, len(entry))), pa.int32())),
                rows(sources.take(pa.array(group))), rows(pa.array(count, pa.int64())),
            ],
            names=RUN_COLUMNS,
        )
        yield from (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS))


def _batch(chunks: list[tuple], run: str) -> pa.RecordBatch:
    shard, lang, first, names, docs, sizes, sources, counts = map(list, zip(*chunks))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(shard, pa.int32()), pa.array(lang, pa.string()), pa.array([run] * len(lang), pa.string()), pa.array(first, pa.binary()),
            pa.array(names, pa.list_(pa.binary())), pa.array(docs, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())),
            pa.array(sources, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64())),
        ],
        names=RUN_COLUMNS,
    )


def _batches(chunks: Iterator[tuple], run: str) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk[-1])
        if size >= FLUSH:
            yield _batch(held, run)
            held, size = [], 0
    if held:
        yield _batch(held, run)


def _spill(shards: int, postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, runs, task = Block(), 0, TaskContext.get().partitionId()
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
                block.add(*(x.as_py() for x in row))
                if block.size >= postings:
                    yield from block.run(shards, f"{task}:{runs}")
                    block, runs = Block(), runs + 1
        yield from block.run(shards, f"{task}:{runs}")

    return run


def merged(chunks: Iterator[tuple], min_docs: int = 0) -> Iterator[tuple]:
    """Terms of one shard and language in at least ``min_docs`` documents, from chunks ordered by their first term:
    (term, docs, sources, counts).

    The heap holds the next term of every open chunk. A chunk is opened when its first term is not behind the heap's.
    """
    heap: list[tuple[bytes, int, int]] = []  # term, chunk, place in it
    opened: dict[int, tuple] = {}
    waiting, number = next(chunks, None), 0
    while waiting is not None or heap:
        while waiting is not None and (not heap or waiting[0] <= heap[0][0]):
            _, names, docs, sizes, sources, counts = waiting
            opened[number] = names, docs, [0, *accumulate(sizes)], sources, counts
            heapq.heappush(heap, (waiting[0], number, 0))
            waiting, number = next(chunks, None), number + 1
        term, own, at = heap[0]
        total, same = 0, []
        while True:
            names = opened[own][0]
            total += opened[own][1][at]
            same.append((opened[own], at))
            if at + 1 < len(names):
                heapq.heapreplace(heap, (names[at + 1], own, at + 1))
            else:
                heapq.heappop(heap)
                del opened[own]
            if not heap or heap[0][0] != term:
                break
            _, own, at = heap[0]
        if total >= min_docs:
            found: dict[str, int] = {}
            for (_, _, ends, sources, counts), at in same:
                for k in range(ends[at], ends[at + 1]):
                    found[sources[k]] = found.get(sources[k], 0) + counts[k]
            yield term, total, list(found), list(found.values())


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Chunks of ordered rows by (run group, shard, language)."""

    def rows():
        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("group", "shard", "lang", "first")]
            yield from zip(*plain, *(_lists(batch.column(c)) for c in ("terms", "docs", "sizes", "sources", "counts")))

    for key, own in groupby(rows(), key=lambda r: r[:3]):
        yield key, (r[3:] for r in own)


def _lists(column: pa.ListArray) -> Iterator[list]:
    """The lists of a column, their values taken out of Arrow at once."""
    values = column.flatten()
    if pa.types.is_integer(values.type):
        values = values.to_numpy(zero_copy_only=False).tolist()
    elif pa.types.is_string(values.type):  # a source is one object however often it occurs
        coded = values.dictionary_encode()
        values = np.array(coded.dictionary.to_pylist(), dtype=object)[coded.indices.to_numpy()].tolist()
    else:
        values = values.to_pylist()
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    return (values[a:b] for a, b in zip([0, *ends], ends))


def _level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs of a group into one run."""

    def chunks():
        names, docs, sizes, sources, counts = [], [], [], [], []
        for term, n, own, times in merged(rows):
            names.append(term)
            docs.append(n)
            sizes.append(len(own))
            sources += own
            counts += times
            if len(counts) >= CHUNK:
                yield shard, lang, names[0], names, docs, sizes, sources, counts
                names, docs, sizes, sources, counts = [], [], [], [], []
        if names:
            yield shard, lang, names[0], names, docs, sizes, sources, counts

    for (group, shard, lang), rows in _by_shard(batches):
        yield from _batches(chunks(), str(group))


def _frequencies(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for (_, _, lang), rows in _by_shard(batches):
            for term, docs, sources, counts in merged(rows, min_docs):
                kept.append((lang, term.decode(), docs, sources, counts))
                size += len(counts)
                if size >= FLUSH:
                    yield _table(kept)
                    kept, size = [], 0
        if kept:
            yield _table(kept)

    return run


def _table(kept: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*kept)), kinds)], names=["lang", "term", "docs", "sources", "counts"])


def texts(docs: DataFrame) -> DataFrame:
    """``lang, source, text`` as text, nulls as ''; what further columns there are is left behind."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, postings: int = POSTINGS, fan: int = FAN) -> DataFrame:
    """``lang, term, docs, sources, counts``: the terms in at least ``min_docs`` documents of a language, with the
    occurrences in each source that has the term. Every row of ``docs`` is a document."""
    spark = docs.sparkSession
    shards = max(SHARDS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = materialize(texts(docs).mapInArrow(_spill(shards, postings), RUN), "runs")
    while True:
        n = runs.select("run").distinct().count()
        groups = -(-n // fan) or 1
        dealt = runs.withColumn("group", F.pmod(F.hash("run"), F.lit(groups))).repartition("group", "shard")
        ordered = dealt.sortWithinPartitions("group", "shard", "lang", "first").drop("run")
        if n <= fan:
            return ordered.mapInArrow(_frequencies(min_docs), FREQUENCY)
        runs = materialize(ordered.mapInArrow(_level, RUN), "runs")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / (n + v)), exact; null without terms."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    product = whole(F.lit(1_000_000_000), 10) * whole(count + 1, 19)
    return F.call_function("div", product, F.nullif(whole(n + v, 19), whole(F.lit(0), 19))) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _np_gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms that two sources share add, over the values taken from each alone: a row a pair and batch."""
    for batch in batches:
        held = batch.column("held")
        sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        own = held.flatten()
        lang = batch.column("lang").dictionary_encode()
        source = own.field("source").dictionary_encode()
        p, p0 = (own.field(c).to_numpy(zero_copy_only=False) for c in ("p", "p0"))
        codes, langs = source.indices.to_numpy(), np.repeat(lang.indices.to_numpy(), sizes)
        many, total = len(source.dictionary), {}
        at, ends = 0, np.cumsum(sizes)
        starts = ends - sizes
        while at < len(sizes):  # terms until their pairs are FLUSH, or one term
            stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:] ** 2), FLUSH)) + at)
            n = sizes[at:stop]
            left = np.repeat(np.arange(starts[at], ends[stop - 1]), np.repeat(n, n))
            first = np.repeat(np.repeat(starts[at:stop], n), np.repeat(n, n))
            run = np.repeat(np.cumsum(np.repeat(n, n)) - np.repeat(n, n), np.repeat(n, n))
            right = first + np.arange(len(left)) - run
            left, right = left[left != right], right[left != right]
            value = _np_gap(p[left], p[right]) - _np_gap(p[left], p0[right]) - _np_gap(p0[left], p[right]) + _np_gap(p0[left], p0[right])
            key, inverse = np.unique((langs[left].astype(np.int64) * many + codes[left]) * many + codes[right], return_inverse=True)
            summed = np.zeros(len(key), dtype=np.int64)
            np.add.at(summed, inverse, value)
            for k, v in zip(key.tolist(), summed.tolist()):
                total[k] = total.get(k, 0) + v
            at = stop
        key = np.fromiter(total, np.int64, len(total))
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(key // many**2)), source.dictionary.take(pa.array(key // many % many)), source.dictionary.take(pa.array(key % many)), pa.array(total.values(), pa.int64())],
            names=["lang", "source", "item", "both"],
        )


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has the divergence of every group from each other source of
    its language, part ``term`` the terms that a group has more of than its language, up to rank ``top``.

    Null text, lang and source are ''. Every row counts as a document, repeated ones too. Groups without terms take part
    in pairs; if a language keeps no term, its pairs have value 0. Equal values rank by the bytes of the item. An empty
    table gives no rows.
    """
    stored = materialize(frequencies(docs, min_docs), "frequencies")
    by_lang = stored.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("n_lang"))
    zipped = F.explode(F.arrays_zip("sources", "counts")).alias("x")
    whole = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("lang_count")
    held = stored.select("lang", "term", whole, zipped).select("lang", "term", "lang_count", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    sizes = held.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    none = F.lit(0).cast("long")
    groups = texts(docs).select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("n", "v", "n_lang")))
    groups = materialize(groups.withColumn("p0", share(none, F.col("n"), F.col("v"))), "groups")

    shares = held.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "p0", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), share(F.col("lang_count"), F.col("n_lang"), F.col("v")).alias("q")
    )
    shares = materialize(shares, "shares")
    ahead = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))

    # the distinct shares of a group with their numbers of terms: fewer than the root of twice its occurrences
    levels = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    levels = levels.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("levels"))
    sides = groups.join(levels, ["lang", "source"], "left").withColumn("levels", F.coalesce("levels", F.expr("cast(array() as array<struct<p:bigint,m:bigint>>)")))
    left = sides.select("lang", "source", "v", "p0", "levels", F.pmod(F.hash("source"), F.lit(SLOTS)).alias("slot"))
    right = sides.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("levels").alias("item_levels"), F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    both = (
        shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("held"))
        .where(F.size("held") > 1).select("lang", "held").mapInArrow(_corrections, "lang string, source string, item string, both long")
        .groupBy("lang", "source", "item").agg(F.sum("both").alias("both"))
    )
    p0, q0 = F.col("p0"), F.col("q0")
    alone = F.aggregate("levels", none, lambda a, x: a + x.m * (gap(x.p, q0) - gap(p0, q0)))
    other = F.aggregate("item_levels", none, lambda a, x: a + x.m * (gap(p0, x.p) - gap(p0, q0)))
    pairs = left.join(right, ["lang", "slot"]).where("source <> item").select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * gap(p0, q0) + alone + other).otherwise(none).alias("single"))
    pairs = pairs.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("single") + F.coalesce("both", none)).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda part: part.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(ahead).where(F.col("rank") <= top))


def op12_spimi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), tok AS (SELECT lang, source, id, unnest(t) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM tok GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
cnt AS (SELECT lang, source, term, count(*) AS c FROM tok SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
sizes AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM kept GROUP BY 1),
n AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY 1, 2),
g AS (
  SELECT lang, source, coalesce(n, 0)::HUGEINT AS n, coalesce(v, 0)::HUGEINT AS v
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) LEFT JOIN sizes USING (lang)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // (n + v) AS p
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = k.term
), q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (total + 1) // (n_lang + v)::HUGEINT AS q FROM kept JOIN sizes USING (lang)
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), term AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 200
"""
