"""Language-model scores by logistic context mixing.

A text is a sequence of words and one end; a word is coded as its bytes and a closing space, a byte as eight binary
decisions. Several predictors give the probability of each bit from a context: the last one to four bytes, and the
whole beginning of the word. Their log odds are mixed with weights that a gate selects by how often the contexts
were seen; the weights are fitted on every training word, by Newton steps from slopes and curvatures that the parts of words
add up, each bit before it is counted (an occurrence is taken out of its own counts). A further reading of every
training word gives a probability map that refines the result. Both are fixed when words are scored. The bits of a word add up to its log probability.

Counts are kept by whole contexts, never by hashed slots, so they stay apart however many there are. Sorted words are
cut into parts of about equal size. The words that share a beginning are neighbours, so a part counts its beginnings
itself, but for those that reach over a cut; these, and the contexts of the last two to four bytes, are a table that
each part is joined to. Only the contexts of one byte, 65,536 slots, are broadcast.

The bits' contexts do not reach across words, so every distinct word is scored once, whatever the size of the corpus,
and a beginning that neighbours share once for all of them, with the occurrences of them all.
A last predictor is the text itself: the share a word has among the words before it joins the model's probability
with a weight that adapts as the text goes on. The counts behind all this come from every training document. Frequent words go to
the documents by a broadcast of fixed size, all others by a join.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm.common import documents, fold, table
from telemetra.session import materialize

ORDERS = (2, 3, 4)  # bytes of the contexts that are joined
PREDICTORS = len(ORDERS) + 2  # one byte, ORDERS, beginning of the word
TOTAL = 1 << 16  # slots of the contexts of one byte: the byte and the node
PART = 16_384  # words of a part, about
DRAWN = 32  # words a part that the cuts are taken from
HOT = 100_000  # frequent words that are broadcast
SIGHTS = (1, 2, 4, 8, 16, 64, 256)  # steps of how often a context was seen
GATES = (len(SIGHTS) + 1) * 4
MAP_STEPS = 33
STEPS = np.linspace(-12, 12, MAP_STEPS)
PRIOR = 0.4
PASSES = 3  # Newton steps, each from every training word
RIDGE = 2.0  # curvature at the start weights
FLUSH = 250_000
SLICE = 2_000_000  # bytes of text whose words are laid out at once
START_WEIGHT, START_WORDS = 0.1, 20  # weight of a text's own earlier words, and how many words that stands for

_BITS = np.arange(8, dtype=np.uint8)


class Laid:
    """The bytes of words, each with its closing space: ``owner`` and ``place`` of each byte and the four bytes
    ``before`` it in one number, spaces where the word has none."""

    def __init__(self, words: list[bytes]):
        self.data = np.frombuffer(b"".join([w + b" " for w in words]), dtype=np.uint8)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.owner = np.repeat(np.arange(len(words)), self.lengths)
        self.place = np.arange(len(self.data)) - self.starts[self.owner]
        self.before = np.zeros(len(self.data), dtype=np.int64)
        for back in (4, 3, 2, 1):
            byte = np.full(len(self.data), 32, dtype=np.int64)
            byte[back:] = self.data[:-back]
            byte[self.place < back] = 32
            self.before = self.before << 8 | byte

    def bytes_after(self, order: int) -> np.ndarray:
        """The number of the context of so many bytes, and the byte that follows: order, context and byte."""
        return order << 40 | (self.before & ((1 << 8 * order) - 1)) << 8 | self.data

    def decisions(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For some bytes the nodes (the byte's bits so far) and bits, eight a byte."""
        data = self.data[at]
        bit = (data[:, None] >> (7 - _BITS)) & 1
        node = (np.int64(1) << _BITS.astype(np.int64)) | (data[:, None].astype(np.int64) >> (8 - _BITS.astype(np.int64)))
        return node, bit


def word_slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of words with ``most`` bytes together, or one longer word."""
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right"))
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def split_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of texts and an end, the empty word, after each: for every word the number of its text and its code, and
    the distinct words (bytes) by code, the end last."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, sizes = split.flatten(), np.diff(split.offsets.to_numpy())
    some = pc.greater(pc.binary_length(words), 0)  # white space at the ends of a text leaves empty ones
    text = np.repeat(np.arange(len(texts)), sizes)[some.to_numpy(zero_copy_only=False)]
    coded = words.filter(some).dictionary_encode()
    distinct = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([b""], pa.binary())])
    ends = np.cumsum(np.bincount(text, minlength=len(texts)))
    code = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(distinct) - 1)
    return np.insert(text, ends, np.arange(len(texts))), code, distinct


def text_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about SLICE bytes of text; a longer text is a slice of its own."""
    lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
    for start, stop in word_slices(lengths, SLICE):
        yield batch.slice(start, stop - start)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task's documents, of all and of the training ones; the end is the empty word."""
    made: list[pa.Table] = []

    def flush():
        table = pa.concat_tables(made).group_by("word", use_threads=False).aggregate([("c", "sum"), ("n", "sum")])
        made.clear()
        yield from table.select(["word", "c_sum", "n_sum"]).rename_columns(["word", "c", "n"]).to_batches(max_chunksize=FLUSH)

    for batch in batches:
        for some in text_slices(batch):
            text, code, distinct = split_texts(some.column("text"))
            learned = ~some.column("held_out").fill_null(False).to_numpy(zero_copy_only=False)[text]
            c, n = (np.bincount(x, minlength=len(distinct)) for x in (code[learned], code))
            made.append(pa.table({"word": distinct, "c": pa.array(c, pa.int64()), "n": pa.array(n, pa.int64())}))
            if sum(t.num_rows for t in made) > 4 * FLUSH:
                yield from flush()
    if made:
        yield from flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (bytes), ``c`` in training documents and ``n`` in all, for every distinct word, stored."""
    rows = docs.select("text", "held_out").mapInArrow(_count_words, "word binary, c long, n long")
    return materialize(rows.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "counts")


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key; the keys ascend."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def _bytes_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte follows each context of one to four bytes in a task's words."""
    none = np.zeros(0, dtype=np.int64)
    keys, sums = none, none

    def flush():
        for order in (1, *ORDERS):
            k, n = _summed(order << 40 | (keys & ((1 << 8 * (order + 1)) - 1)), sums)
            for at in range(0, len(k), 50_000):
                some = k[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some >> 8), pa.array((some & 255).astype(np.int16)), pa.array(n[at : at + 50_000])], names=["ctx", "next", "n"]
                )

    for batch in batches:
        words, counts = batch.column("word").to_pylist(), batch.column("c").to_numpy(zero_copy_only=False)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        for start, stop in word_slices(lengths, 1_000_000):
            laid = Laid(words[start:stop])
            made = _summed(laid.bytes_after(4), counts[start:stop][laid.owner])
            keys, sums = _summed(np.concatenate([keys, made[0]]), np.concatenate([sums, made[1]]))
            if len(keys) > 4 * FLUSH:
                yield from flush()
                keys, sums = none, none
    yield from flush()


_AFTER = "array<struct<next:smallint,n:bigint>>"


def byte_contexts(counts: DataFrame) -> DataFrame:
    """``ctx`` (order and bytes) and ``after``, how often each byte follows it in training words; stored."""
    made = counts.where("c > 0").select("word", "c").mapInArrow(_bytes_after, "ctx long, next smallint, n long")
    made = made.groupBy("ctx", "next").agg(F.sum("n").alias("n"))
    return materialize(made.groupBy("ctx").agg(F.collect_list(F.struct("next", "n")).alias("after")), "contexts")  # 256 bytes at most


def first_order(contexts: DataFrame) -> np.ndarray:
    """(TOTAL, 2) counts of zeros and ones after each byte at each node."""
    out = np.zeros((256, 256, 2), dtype=np.int64)
    for row in contexts.where(F.col("ctx") < F.lit(2 << 32)).collect():  # 256 rows at most
        for byte, n in row["after"]:
            for k in range(8):
                out[row["ctx"] & 255, 1 << k | byte >> (8 - k), byte >> (7 - k) & 1] += n
    return out.reshape(-1, 2)


def cut_points(counts: DataFrame, distinct: int) -> list[bytes]:
    """The shortest strings that cut the sorted words (with their spaces) into parts of about PART words."""
    parts = -(-distinct // PART)
    if parts < 2:
        return []
    drawn = counts.where(F.pmod(F.xxhash64("word", F.lit(1)), F.lit(PART // DRAWN)) == 0).select("word").collect()  # DRAWN a part
    drawn = sorted(bytes(r["word"]) + b" " for r in drawn)
    out = []
    for at in sorted({k * len(drawn) // parts for k in range(1, parts)} - {0}):
        out.append(drawn[at][: common(drawn[at - 1], drawn[at]) + 1])
    return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _parted(held):
    """Words with their part and whether they are among those the weights are fitted on, the training words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = held.value[0]
        for batch in batches:
            words = batch.column("word").to_pylist()
            part = pa.array([bisect_right(cuts, w + b" ") for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("c"), part, pc.greater(batch.column("c"), 0)], names=["word", "c", "part", "chosen"]
            )

    return run


def _over_cuts(held):
    """How often each byte follows each beginning that a cut of a task's words starts with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, sums = held.value[0], Counter()

        def flush():
            prefix, n = pa.array([k[:-1] for k in sums], pa.binary()), pa.array(list(sums.values()), pa.int64())
            yield pa.RecordBatch.from_arrays([prefix, pa.array([k[-1] for k in sums], pa.int16()), n], names=["prefix", "next", "n"])
            sums.clear()

        for batch in batches:
            for word, c, part in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist(), batch.column("part").to_pylist()):
                key = word + b" "
                near = max([common(key, cut) for cut in cuts[max(part - 1, 0) : part + 1]], default=0)
                for k in range(min(near, len(word)) + 1):
                    sums[key[: k + 1]] += c
            if len(sums) > FLUSH:
                yield from flush()
        yield from flush()

    return run


def _wanted(table: pa.Table) -> pa.Table:
    """The contexts of two to four bytes that occur in a part."""
    words, part = table.column("word").to_pylist(), table.column("part")[0].as_py()
    found = []
    for start, stop in word_slices(np.fromiter(map(len, words), np.int64, len(words)) + 1, 1_000_000):
        laid = Laid(words[start:stop])
        found += [np.unique(laid.bytes_after(k) >> 8) for k in ORDERS]
    ctx = np.unique(np.concatenate(found))
    return pa.table({"part": pa.array(np.full(len(ctx), part)), "ctx": pa.array(ctx)})


def answers(parted: DataFrame, contexts: DataFrame, held) -> DataFrame:
    """For each part what follows the contexts it holds: ``part, ctx, prefix, after``, stored. A beginning that reaches
    over a cut is a ``prefix``, other contexts a ``ctx``."""
    cuts = held.value[0]
    spark = parted.sparkSession
    ctx = parted.select("word", "part").groupBy("part").applyInArrow(_wanted, "part long, ctx long").join(contexts, "ctx")
    over = parted.select("word", "c", "part").mapInArrow(_over_cuts(held), "prefix binary, next smallint, n long")
    over = over.groupBy("prefix", "next").agg(F.sum("n").alias("n"))
    over = over.groupBy("prefix").agg(F.collect_list(F.struct("next", "n")).alias("after"))
    # the beginnings of the two cuts of each part
    ends = {(part, cut[:k]) for i, cut in enumerate(cuts) for part in (i, i + 1) for k in range(len(cut) + 1)}
    ends = spark.createDataFrame([(part, bytearray(p)) for part, p in sorted(ends)], "part long, prefix binary")
    prefix = ends.join(over, "prefix")
    return materialize(
        ctx.select("part", "ctx", F.lit(None).cast("binary").alias("prefix"), "after").unionByName(
            prefix.select("part", F.lit(None).cast("long").alias("ctx"), "prefix", "after")
        ),
        "answers",
    )


def shared_bits(laid: Laid) -> np.ndarray:
    """How many bits each of the sorted words has in common with the one before; -1 before the first and after the
    last. No word with its space is the beginning of another."""
    a, b = laid.starts[:-1], laid.starts[1:]
    same, todo = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    for k in range(64):
        same[todo] = k
        todo = todo[laid.data[a[todo] + k] == laid.data[b[todo] + k]]
        if not len(todo):
            break
    for i in todo.tolist():
        n = int(min(laid.lengths[i], laid.lengths[i + 1]))
        same[i] = np.argmax(laid.data[a[i] : a[i] + n] != laid.data[b[i] : b[i] + n])
    change = laid.data[a + same] ^ laid.data[b + same]
    return np.r_[-1, 8 * same + 7 - np.floor(np.log2(change)).astype(np.int64), -1]


class Evidence:
    """How often each bit and its opposite followed their contexts in training words, for sorted distinct ``words``
    that stand for ``c`` occurrences. ``first``: counts after one byte; ``after``: for ``ctx`` and ``prefix`` as in
    ``answers``. Contexts that are in neither were not seen. ``only``: the words to give evidence for, all by default."""

    def __init__(self, first: np.ndarray, words: list[bytes], c: np.ndarray, after: pa.Table | None = None, only: list[int] | None = None):
        self.first, self.laid, self.c = first, Laid(words), np.asarray(c, dtype=np.int64)
        self.size = len(words)
        over: dict[bytes, np.ndarray] = {}
        keys = counts = np.zeros(0, dtype=np.int64)
        if after is not None and after.num_rows:
            after = after.combine_chunks()
            lists = after.column("after").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            sizes = np.diff(lists.offsets.to_numpy())
            following, n = (lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("next", "n"))
            row = np.repeat(np.arange(after.num_rows), sizes)
            by_bytes = after.column("ctx").is_valid().to_numpy(zero_copy_only=False)
            ctx = after.column("ctx").fill_null(0).to_numpy()
            mine = by_bytes[row]
            keys, counts = _summed(ctx[row][mine] << 8 | following[mine], n[mine])
            ends = np.cumsum(sizes)
            for i in np.flatnonzero(~by_bytes).tolist():
                at = slice(ends[i] - sizes[i], ends[i])
                over[after.column("prefix")[i].as_py()] = np.r_[0, np.cumsum(np.bincount(following[at], weights=n[at], minlength=256))]
        self.upto = np.r_[0, np.cumsum(counts)]
        self.keys = keys
        self._begin(over)
        if only is not None:
            self.laid = Laid([words[i] for i in only])
            self.c, self.depth, self.offset = self.c[only], self.depth[only], self.offset[only]
        self._share()
        self._follow()

    def _begin(self, over: dict[bytes, np.ndarray]) -> None:
        """``depth`` of each word, the bits it has in common with others, and the occurrences of all words that share
        its first 0, 1 ... ``depth`` bits. With more bits it is alone."""
        laid, c = self.laid, self.c
        alike = shared_bits(laid) if self.size else np.zeros(1, dtype=np.int64)
        own = np.maximum(alike[:-1], alike[1:])
        near = {}
        for prefix in sorted(over, key=len):  # bytes up to the end of the prefix are the same
            k = len(prefix)
            if not k:
                near[prefix] = np.arange(self.size)
            elif prefix[:-1] in near:
                at = near[prefix[:-1]]
                at = at[laid.lengths[at] > k]
                near[prefix] = at[laid.data[laid.starts[at] + k - 1] == prefix[-1]]
        self.depth = np.maximum(own, 0)
        for prefix, at in near.items():
            self.depth[at] = np.maximum(self.depth[at], 8 * len(prefix) + 8)
        self.offset = np.cumsum(self.depth + 1) - self.depth - 1
        self.sums = np.repeat(c, self.depth + 1)
        low, at = 0, np.arange(self.size)
        for bits in np.unique(alike[1:-1]).tolist():  # from low to this many bits the same words belong together
            at = at[own[at] >= bits]
            start = alike[at] < bits
            total = np.add.reduceat(c[at], np.flatnonzero(start))[np.cumsum(start) - 1]
            for k in range(low, bits + 1):
                self.sums[self.offset[at] + k] = total
            low = bits + 1
        for prefix, at in near.items():
            byte, sums = laid.data[laid.starts[at] + len(prefix)].astype(np.int64), over[prefix]
            for k in range(9):
                low = byte >> (8 - k) << (8 - k)
                self.sums[self.offset[at] + 8 * len(prefix) + k] = (sums[low + (1 << (8 - k))] - sums[low]).astype(np.int64)

    def _share(self) -> None:
        """Words that share a beginning have the same evidence there: ``shared`` are the bytes that end the distinct
        beginnings, each in the first word that has it, and ``edge`` has for each byte of all words the number of its own."""
        laid = self.laid
        alike = shared_bits(laid)[:-1] // 8 if len(laid.lengths) else np.zeros(0, dtype=np.int64)
        again = laid.place < alike[laid.owner]
        source = np.arange(len(laid.data))
        source[again] -= laid.lengths[laid.owner[again] - 1]  # the same place of the word before
        while True:
            further = source[source]
            if np.array_equal(further, source):
                break
            source = further
        self.shared = np.flatnonzero(~again)
        self.edge = (np.cumsum(~again) - 1)[source]

    def _follow(self) -> None:
        """For each order the distinct contexts with their byte, and how often its first 0, 1 ... 8 bits followed."""
        self.follow = []
        for order in ORDERS:
            keys, place = np.unique(self.laid.bytes_after(order)[self.shared], return_inverse=True)
            sums = np.empty((len(keys), 9), dtype=np.int64)
            for k in range(9):
                low = keys >> (8 - k)
                new = np.r_[True, low[1:] != low[:-1]][: len(low)]
                low = low[new] << (8 - k)
                found = self.upto[np.searchsorted(self.keys, low + (1 << (8 - k)))] - self.upto[np.searchsorted(self.keys, low)]
                sums[:, k] = found[np.cumsum(new) - 1]
            self.follow.append((sums, place.astype(np.int32)))

    def chunks(self, chunk: int = 150_000) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of words: the first word's number, then for every bit the word's number, node, bit and for each
        predictor how often the bit and its opposite were seen."""
        laid = self.laid
        for start, stop in word_slices(laid.lengths, chunk // 8):
            at = np.arange(laid.starts[start], laid.starts[stop - 1] + laid.lengths[stop - 1])
            yield start, np.repeat(laid.owner[at], 8), *self._bits(at)

    def edges(self, chunk: int = 150_000) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """As ``chunks``, but each byte of a beginning that words share comes once: for runs of ``shared`` their numbers, then
        for every bit node, bit and how often the bit and its opposite were seen."""
        for start in range(0, len(self.shared), chunk // 8):
            run = slice(start, min(start + chunk // 8, len(self.shared)))
            yield run, *self._bits(self.shared[run])

    def _bits(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        laid = self.laid
        node, bit = laid.decisions(at)
        yes, no = np.empty((2, PREDICTORS, len(node), 8), dtype=np.float32)
        slot = (laid.before[at] & 255)[:, None] << 8 | node
        yes[0], no[0] = self.first[slot, bit], self.first[slot, 1 - bit]
        for k, (sums, place) in enumerate(self.follow, 1):
            found = sums[place[self.edge[at]]]
            yes[k], no[k] = found[:, 1:], found[:, :-1] - found[:, 1:]
        owner = laid.owner[at]
        bits = 8 * laid.place[at][:, None] + np.arange(9)
        depth = self.depth[owner][:, None]
        found = np.where(bits <= depth, self.sums[self.offset[owner][:, None] + np.minimum(bits, depth)], self.c[owner][:, None])
        yes[-1], no[-1] = found[:, 1:], found[:, :-1] - found[:, 1:]
        return node.ravel(), bit.ravel(), yes.reshape(PREDICTORS, -1), no.reshape(PREDICTORS, -1)


def _stretch(yes: np.ndarray, no: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Log odds of a one."""
    odds = np.log((yes + np.float32(PRIOR)) / (no + np.float32(PRIOR)))
    return np.where(bit == 1, odds, -odds)


def _seen(total: np.ndarray) -> np.ndarray:
    """How often a context was seen, in steps."""
    return np.digitize(total, SIGHTS).astype(np.uint8)


def _gate(total: np.ndarray) -> np.ndarray:
    """From the sightings of the last two predictors."""
    return _seen(total[1]).astype(np.int64) * 4 + _seen(total[0]) // 2


class Mixer:
    """Counts after one byte, gated weights and the probability map."""

    def __init__(self, first: np.ndarray, weights: np.ndarray, refine: np.ndarray):
        self.first, self.weights, self.refine = first, weights, refine

    def mixed(self, inputs: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = self.weights[gate, -1].astype(np.float32)
        for k, x in enumerate(inputs):
            z += self.weights[gate, k] * x
        return np.clip(z, -12, 12)

    def unseen(self, bit: np.ndarray, yes: np.ndarray, no: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, gate and mixed log odds of bits before their own occurrence is counted."""
        yes = np.maximum(yes - 1, 0)
        inputs = _stretch(yes, no, bit)
        gate = _gate(yes[-2:] + no[-2:])
        return inputs, gate, self.mixed(inputs, gate)

    def refined(self, z: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Mean of the mixed log odds and the map's, interpolated between its steps."""
        at = (z + 12) * ((MAP_STEPS - 1) / 24)
        low = np.minimum(at.astype(np.int64), MAP_STEPS - 2)
        part = (at - low).astype(np.float32)
        row = node.astype(np.int64) * MAP_STEPS + low
        return 0.5 * (z + self.refine[row] * (1 - part) + self.refine[row + 1] * part)

    def score(self, words: list[bytes], c: np.ndarray | None = None, after: pa.Table | None = None) -> np.ndarray:
        """log10 probability of each word. ``c`` and ``after``: what is known of a part's sorted words, see Evidence."""
        if c is None:
            distinct = sorted({w + b" " for w in words})
            place = {w: i for i, w in enumerate(distinct)}
            made = self.score([w[:-1] for w in distinct], np.zeros(len(distinct)))
            return np.array([made[place[w + b" "]] for w in words])
        known = Evidence(self.first, words, c, after)
        cost = np.zeros(len(known.shared))  # of each byte
        for run, node, bit, yes, no in known.edges():
            z = self.refined(self.mixed(_stretch(yes, no, bit), _gate(yes[-2:] + no[-2:])), node)
            cost[run] = np.logaddexp(0, np.where(bit == 1, -z, z)).reshape(-1, 8).sum(axis=1, dtype=np.float64)
        return np.bincount(known.laid.owner, weights=cost[known.edge], minlength=len(words)) / -math.log(10)


def learn(counts: np.ndarray, words: list[bytes], weight: np.ndarray, passes: int = 2) -> Mixer:
    """As ``fit``, on distinct words of which only the counts after one byte are known."""
    order = sorted(range(len(words)), key=lambda i: words[i] + b" ")
    known = Evidence(counts, [words[i] for i in order], np.zeros(len(words))) if words else None

    def chunks():
        for _, owner, node, bit, yes, no in known.chunks(64_000) if known else ():
            yield node, bit, yes, no, (weight[order] / weight.mean())[owner]

    return fit(counts, chunks, passes)


def fit(first: np.ndarray, chunks, passes: int = 2) -> Mixer:
    """Learns the gated weights and the map from ``chunks()``: for runs of bits, node, bit, how often the bit and its
    opposite were seen, and how many occurrences a bit stands for."""
    own = Mixer(first, start_weights(), np.tile(STEPS, 256).astype(np.float32))
    for _ in range(passes):
        own.weights = stepped(own.weights, *slopes(own, chunks))
    own.refine = refinement(*hits_and_tries(own, chunks))
    return own


def start_weights() -> np.ndarray:
    return np.tile(np.array([0.0, 0.1, 0.2, 0.3, 0.4, 0.0], dtype=np.float32), (GATES, 1))


def slopes(own: Mixer, chunks) -> tuple[np.ndarray, np.ndarray]:
    """Curvature and slope of each gate's weights, from counts without the occurrence that is predicted."""
    size = PREDICTORS + 1
    curve, slope = np.zeros((GATES, size, size)), np.zeros((GATES, size))
    for _, bit, yes, no, w in chunks():
        inputs, gate, z = own.unseen(bit, yes, no)
        p = 1 / (1 + np.exp(-z))
        order = np.argsort(gate.astype(np.uint8), kind="stable")  # bits of a gate together
        x = np.vstack([inputs, np.ones(len(z), dtype=np.float32)])[:, order].astype(np.float64)
        p, w, bit = p[order], w[order], bit[order]
        bent, off = x * (w * p * (1 - p)), w * (bit - p)
        ends = np.cumsum(np.bincount(gate, minlength=GATES))
        for g in np.flatnonzero(np.diff(ends, prepend=0)):
            at = slice(ends[g - 1] if g else 0, ends[g])
            curve[g] += bent[:, at] @ x[:, at].T
            slope[g] += x[:, at] @ off[at]
    return curve, slope


def stepped(weights: np.ndarray, curve: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """The weights after a Newton step, held to the start by RIDGE."""
    pull = slope - RIDGE * (weights - start_weights())
    step = np.linalg.solve(curve + np.eye(PREDICTORS + 1) * RIDGE, pull[..., None])[..., 0]
    return weights + np.clip(step, -0.5, 0.5).astype(np.float32)


def hits_and_tries(own: Mixer, chunks) -> tuple[np.ndarray, np.ndarray]:
    """How many bits at each node and step of the mixed log odds were ones, and how many there were."""
    hits, tries = np.zeros(256 * MAP_STEPS), np.zeros(256 * MAP_STEPS)
    for node, bit, yes, no, w in chunks():
        z = own.unseen(bit, yes, no)[2]
        near = np.rint((z + 12) * ((MAP_STEPS - 1) / 24)).astype(np.int64) + node.astype(np.int64) * MAP_STEPS
        hits += np.bincount(near, weights=w * bit, minlength=len(hits))
        tries += np.bincount(near, weights=w, minlength=len(tries))
    return hits, tries


def refinement(hits: np.ndarray, tries: np.ndarray) -> np.ndarray:
    """The map: log odds of a one by node and step."""
    prior = np.tile(1 / (1 + np.exp(-STEPS)), 256)
    p = (hits + 4 * prior) / (tries + 4)
    return np.clip(np.log(p / (1 - p)), -14, 14).astype(np.float32)


def _sorted(words: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    words = words.combine_chunks()
    order = pc.sort_indices(pc.binary_join_element_wise(words.column("word"), pa.scalar(b" "), pa.scalar(b"")))
    own, c, chosen = (words.column(k).take(order).to_numpy() for k in ("word", "c", "chosen"))
    return own.tolist(), c.astype(np.int64), chosen.astype(bool)


def _training_chunks(first: np.ndarray, words: pa.Table, after: pa.Table, mean: float):
    """Chunks for ``slopes`` and ``hits_and_tries``: the beginnings of a part's training words, weighted by how often they occur."""
    own, c, chosen = _sorted(words)
    made = np.flatnonzero(chosen).tolist()
    known = Evidence(first, own, c, after, made) if made else None
    times = np.bincount(known.edge, weights=known.c[known.laid.owner]) / mean if known else None

    def chunks():
        for run, node, bit, yes, no in known.edges(64_000) if known else ():
            yield node, bit, yes, no, np.repeat(times[run], 8)

    return chunks


def _learn_part(held):
    """Curvature and slope that a part's training words give: ``slot, value`` to be summed over parts."""

    def run(words: pa.Table, after: pa.Table) -> pa.Table:
        own, mean = held.value
        values = np.concatenate([x.ravel() for x in slopes(own, _training_chunks(own.first, words, after, mean))])
        return pa.table({"slot": pa.array(np.arange(len(values))), "value": pa.array(values)})

    return run


def _map_part(held):
    """The places of the map that a part's training words meet: ``slot, hits, tries`` to be summed over parts."""

    def run(words: pa.Table, after: pa.Table) -> pa.Table:
        own, mean = held.value
        hits, tries = hits_and_tries(own, _training_chunks(own.first, words, after, mean))
        met = np.flatnonzero(tries)
        return pa.table({"slot": pa.array(met), "hits": pa.array(hits[met]), "tries": pa.array(tries[met])})

    return run


def fit_parts(spark: SparkSession, parts, first: np.ndarray, mean: float, passes: int = PASSES) -> Mixer:
    """Weights and map learned from every training word, part by part. What reaches the driver has a fixed size."""
    own = Mixer(first, start_weights(), np.tile(STEPS, 256).astype(np.float32))
    size = PREDICTORS + 1
    for _ in range(passes):
        sums = np.zeros(GATES * size * (size + 1))
        made = parts.applyInArrow(_learn_part(spark.sparkContext.broadcast((own, mean))), "slot long, value double")
        for r in made.groupBy("slot").agg(F.sum("value").alias("value")).collect():
            sums[r["slot"]] = r["value"]
        curve, slope = np.split(sums, [GATES * size * size])
        weights = stepped(own.weights, curve.reshape(GATES, size, size), slope.reshape(GATES, size))
        own = Mixer(first, weights, own.refine)
    hits, tries = np.zeros((2, 256 * MAP_STEPS))
    held = spark.sparkContext.broadcast((own, mean))
    met = parts.applyInArrow(_map_part(held), "slot long, hits double, tries double")
    for r in met.groupBy("slot").agg(F.sum("hits").alias("hits"), F.sum("tries").alias("tries")).collect():
        hits[r["slot"]], tries[r["slot"]] = r["hits"], r["tries"]
    own.refine = refinement(hits, tries)
    return own


def _score_part(held):
    def run(words: pa.Table, after: pa.Table) -> pa.Table:
        own, c, _ = _sorted(words)
        made = held.value.score(own, c, after) if own else np.zeros(0)
        return pa.table({"word": pa.array(own, pa.binary()), "c": pa.array(c), "s": pa.array(made)})

    return run


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """``word`` of about the ``most`` most frequent words, of equally frequent ones by hash. Counts of counts reach the
    driver, not words."""
    left = most
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        if r["words"] > left:
            drawn = (F.col("n") == r["n"]) & (F.pmod(F.xxhash64("word", F.lit(3)), F.lit(1 << 20)) < (left << 20) // r["words"])
            return counts.where((F.col("n") > r["n"]) | drawn).select("word")
        left -= r["words"]
    return counts.select("word")


def recent(ids: np.ndarray, prob: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a text the share it has among the words before it, and the weight of that share against the
    model's probability ``prob``. The weight adapts online: it is the mean responsibility of the shares so far, renewed
    at places 1, 2, 4 ... 256 and every 256 further, so it depends on earlier words only. Several texts may be laid one
    after another, ``starts`` are their first words."""
    starts = np.zeros(1, dtype=np.int64) if starts is None else starts
    sizes = np.diff(np.r_[starts, len(ids)])
    text = np.repeat(np.arange(len(starts)), sizes)
    spot = np.arange(len(ids)) - starts[text]
    order, first = grouped(text, ids)
    before = np.empty(len(ids))
    before[order] = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)]))
    share = before / np.maximum(spot, 1)
    weight, held, at, longest = np.zeros(len(ids)), np.zeros(len(starts)), 1, sizes.max(initial=0)
    along = np.argsort(spot, kind="stable")
    until = np.cumsum(np.bincount(spot))  # words at a place or before it
    while at < longest:
        stop = min(2 * at if at < 256 else at + 256, longest)
        some = along[until[at - 1] : until[stop - 1]]
        whose = text[some]
        now = ((START_WEIGHT * START_WORDS + held) / (START_WORDS + at))[whose]
        weight[some] = now
        own = now * share[some]
        held += np.bincount(whose, weights=own / (own + (1 - now) * prob[some]), minlength=len(starts))
        at = stop
    return share, weight


def grouped(text: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts equal words of a text together, and where each of them starts in it."""
    key = text * (ids.max(initial=0) + 1) + ids
    order = np.argsort(key, kind="stable")
    key = key[order]
    return order, np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])


_DOCS = "row long, doc_id long, held_out boolean, word binary, times long, n_tokens long, n_known long, base_score double, score double, n_bytes long, again array<double>"


def _score_docs(held):
    """For each document a row with the sums over its frequent words, and a row for every other distinct word;
    ``again`` has the odds (log10) of its share against the weight left to the model, for each later occurrence."""

    kinds = dict(zip([x.split()[0] for x in _DOCS.split(", ")], [
        pa.int64(), pa.int64(), pa.bool_(), pa.binary(), *[pa.int64()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.float64()),
    ]))

    def rows(**columns) -> pa.RecordBatch:
        """The columns, and nulls in all others."""
        n = len(columns["row"])
        made = [pa.nulls(n, kind) if (c := columns.get(k)) is None else c if isinstance(c, pa.Array) else pa.array(c, kind) for k, kind in kinds.items()]
        return pa.RecordBatch.from_arrays(made, names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, known, base, score, unknown = held.value
        prob = np.append(10.0**score, unknown)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in text_slices(batch):
                text, code, distinct = split_texts(some.column("text"))
                n = some.num_rows
                hot = np.array([place.get(w, -1) for w in distinct.to_numpy(zero_copy_only=False).tolist()])
                found, sizes = hot[code], np.bincount(text, minlength=n)
                share, weight = recent(code, prob[found], np.cumsum(sizes) - sizes)
                left = np.log10(1 - weight)
                with np.errstate(divide="ignore"):
                    odds = np.log10(weight * share) - left
                frequent = found >= 0
                whose, found = text[frequent], found[frequent]
                gained = np.logaddexp(0, (odds[frequent] - score[found]) * math.log(10)) / math.log(10)
                total = lambda whose, values: np.bincount(whose, weights=values, minlength=n)
                yield rows(
                    row=row + np.arange(n), doc_id=some.column("doc_id"), held_out=some.column("held_out"), n_tokens=sizes,
                    n_known=total(whose, known[found]).astype(np.int64), base_score=total(whose, base[found]),
                    score=total(whose, score[found] + gained) + total(text, left), n_bytes=pc.binary_length(some.column("text")).cast(pa.int64()),
                )
                rare = np.flatnonzero(~frequent)
                order, first = grouped(text[rare], code[rare])
                order = rare[order]
                times = np.diff(np.r_[first, len(order)])
                later = np.ones(len(order), dtype=bool)
                later[first] = False
                again = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(times - 1)], pa.int32()), pa.array(odds[order[later]]))
                yield rows(row=row + text[order[first]], word=distinct.take(pa.array(code[order[first]])), times=times, again=again)
                row += n

    return run


def score(docs: DataFrame, held_out) -> DataFrame:
    """Scores every row of ``docs``; rows where the column ``held_out`` is false are learned from.

    Gives doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (null for an empty
    text). Null texts are empty and still have an end; repeated rows are counted and scored each; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    rows = documents(docs).withColumn("held_out", held_out)
    counts = word_counts(rows)
    n, v, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count("*")).first()

    contexts = byte_contexts(counts)
    first = first_order(contexts)
    held = spark.sparkContext.broadcast((cut_points(counts, distinct),))  # a cut a part
    parted = materialize(counts.select("word", "c").mapInArrow(_parted(held), "word binary, c long, part long, chosen boolean"), "parted")
    after = answers(parted, contexts, held)
    parts = parted.groupBy("part").cogroup(after.groupBy("part"))
    mixer = fit_parts(spark, parts, first, n / max(v, 1))
    model = spark.sparkContext.broadcast(mixer)  # counts after one byte, weights and map
    scored = materialize(parts.applyInArrow(_score_part(model), "word binary, c long, s double"), "scored")

    listed = F.broadcast(frequent_words(counts, HOT))
    hot = scored.join(listed, "word", "left_semi").toArrow()  # HOT words
    hot_c = hot.column("c").to_numpy().astype(np.float64)
    place = {w: i for i, w in enumerate(hot.column("word").to_pylist())}
    base = np.log10((hot_c + 1) / (n + v + 1))
    frequent = spark.sparkContext.broadcast((place, hot_c > 0, base, hot.column("s").to_numpy(), 1 / (n + v + 1)))
    del hot, place
    sums = materialize(rows.mapInArrow(_score_docs(frequent), _DOCS), "sums")
    scored = scored.join(listed, "word", "left_anti")
    times = F.col("times")
    repeats = F.expr("if(size(again) = 0, 0D, aggregate(again, 0D, (a, r) -> a + if(r - s > 15, r - s, log10(1 + pow(10D, r - s)))))")
    tail = sums.where("word is not null").select("row", "word", "times", "again").join(scored, "word").select(
        "row", F.when(F.col("c") > 0, times).otherwise(0).alias("n_known"),
        (times * F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).alias("base_score"), (times * F.col("s") + repeats).alias("score"),
    )
    parts = ["n_known", "base_score", "score"]
    tail = tail.groupBy("row").agg(*[F.sum(p).alias(f"_{p}") for p in parts])
    whole = sums.where("word is null").join(tail, "row", "left")
    whole = whole.select("doc_id", "held_out", "n_tokens", "n_bytes", *[(F.col(p) + F.coalesce(f"_{p}", F.lit(0))).alias(p) for p in parts])
    return whole.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)
