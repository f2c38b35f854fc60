"""Packing by cutting-stock column generation.

Documents become token ids plus one end id. A document is cut into full pieces of the sequence length and one
remainder. Pieces are counted by length class (length in grains of a few tokens, rounded up). A linear program
over patterns (how many pieces of each class share a sequence) is solved by column generation: the dual values
price the classes, a knapsack dynamic program finds the best new pattern, a simplex pivot brings it in. Pattern
counts are rounded down and handed to the pieces of a class by rank. The pieces left by the rounding, at most a
few per pattern whatever the size of the corpus, are laid end to end and cut at sequence ends; the very last
sequence is cut into powers of two, which need no padding.

The program sees only the histogram (one count per class). Ranks come from counts per (task, class), so no piece
is sorted globally, and the ids themselves are stored once and never shuffled by the plan.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetra.llm.common import documents, start_task, worker_cache
from telemetra.session import materialize

LENGTH = 2048
GRAIN = 8
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
CACHE = 400_000  # text parts whose ids a worker keeps, new ones; as many older ones stay

STOPS = ".,;:!?"
JOINED = 40  # parts that are encoded as one text
BEGINS = "\u0120\u010a"  # how byte-level models write a space and a line feed

PIECES = (
    "part int, cls int, local long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"
)


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of whole texts. Byte-level BPE never merges across a space that follows a non-space, so the parts
    between single spaces are encoded once, many in one text, and remembered. Texts with other white space, where
    that does not hold, and texts that hold one of the tokenizer's added tokens are encoded whole."""

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses all cores
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.joined = 1 if any(c in token for token in self.added for c in " \n") else JOINED
        self.forget()
        alone = lambda text: pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self.stops, self.feed = {c: alone(c) for c in STOPS}, alone("\n")
        # ids of pieces that begin with a space or a line feed, as the pieces of a part do not but for the first
        self.begins = np.zeros(1 + max(self.tokenizer.get_vocab().values()), dtype=bool)
        self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token[0] in BEGINS]] = True

    def forget(self) -> None:
        self.known: tuple[dict, dict] = ({}, {})  # parts with their ids: the newer ones and the ones before

    def prepare(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts. A space goes before a part, but not after the line feed that it may begin with."""
        new, old = self.known
        if len(new) > CACHE:
            new, old = {}, new
            self.known = new, old
        found = list(map(new.get, parts))
        missing = [i for i, ids in enumerate(found) if ids is None]
        fresh, ended = {}, []
        for i in missing:
            p = parts[i]
            ids = old.get(p)
            if ids is None and len(p) > 1 and p[-1] in STOPS and p[-2].isalpha():
                ended.append(p)  # a stop after a letter is a piece of its own
                p = p[:-1]
                ids = new.get(p) or old.get(p)
            if ids is None:
                fresh[p] = None
            else:
                new[p] = ids
        if "\n" in fresh:
            new["\n"] = self.feed
            del fresh["\n"]
        words = list(fresh)
        for at in range(0, len(words), 8000):
            some = words[at : at + 8000]
            texts = [f" {' '.join(some[k : k + self.joined])}".replace(" \n", "\n") for k in range(0, len(some), self.joined)]
            ids = np.array([i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], dtype="<u4")
            first, data = 4 * np.flatnonzero(self.begins[ids]), ids.tobytes()
            for p, start, stop in zip(some, first.tolist(), [*first[1:].tolist(), len(data)], strict=True):
                new[p] = data[start:stop]
        for p in ended:
            new[p] = new[p[:-1]] + self.stops[p[-1]]
        for i in missing:
            found[i] = new[parts[i]]
        return found

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        simple = self.simple(texts)
        # a single line feed between other characters is a piece of its own, and no space goes before the next part;
        # one is put before each text, so that the first part is like others, and its id is taken off
        lines = pc.binary_join_element_wise("\n", pc.replace_substring(texts.filter(simple), "\n", " \n"), "")
        split = pc.split_pattern(lines, " ")
        parts = split.flatten().dictionary_encode()
        known = np.array(self.prepare(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), dtype=object)
        ids, ends = known[parts.indices.to_numpy()].tolist(), split.offsets.to_numpy().tolist()
        made = (b"".join(ids[a:b])[len(self.feed) :] for a, b in zip(ends, ends[1:]))
        return [
            next(made) if whole else pack_ids(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids)
            for i, whole in enumerate(simple.to_pylist())
        ]

    def simple(self, texts: pa.Array) -> pa.Array:
        """Where white space is single spaces and line feeds between other characters, and no added token is held."""
        unusual = pc.match_substring_regex(texts, UNUSUAL)
        for token in self.added:
            unusual = pc.or_(unusual, pc.match_substring(texts, token))
        return pc.invert(unusual)


#: two of space and line feed together, or one where a text may not begin or end; other white space and controls by code point
UNUSUAL = (
    r"[ \n][ \n]|\A\n|[ \n]\z|[\x00-\x09\x0b-\x1f\x7f-\xa0\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}]"
)
_encoders: dict[str | None, Encoder] = {}


def _forget() -> None:
    for encoder in _encoders.values():
        encoder.forget()


worker_cache(_forget)


def _batches(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[tuple[list, pa.Array]]:
    """Slices of a batch of about so many bytes of text; a longer text is a slice of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right"))
        stop = max(stop, start + 1)
        yield batch.column(0).slice(start, stop - start).to_pylist(), batch.column(1).slice(start, stop - start)
        start = stop


def _pieces(path: str | None, length: int, grain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task()
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder, part = _encoders[path], TaskContext.get().partitionId()
        seen = [0] * (length // grain + 2)
        end, wide = np.asarray([END_ID], dtype="<u4").tobytes(), 4 * length
        for batch in batches:
            for doc_ids, texts in _batches(batch):
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids, encoder.encode(texts)):
                    ids += end
                    total = len(ids) // 4
                    for at in range(0, len(ids), wide):
                        piece = ids[at : at + wide]
                        n = len(piece) // 4
                        cls = -(-n // grain)
                        rows.append((part, cls, seen[cls], doc_id, at // 4, n, total, zlib.crc32(piece), piece))
                        seen[cls] += 1
                kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    names=[x.split()[0] for x in PIECES.split(", ")],
                )

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """One stored row per piece with its ids (little-endian unsigned 32 bit), its class and its number in (task, class)."""
    if length % grain:
        raise ValueError("the sequence length must be a multiple of the grain")
    return materialize(documents(docs).mapInArrow(_pieces(tokenizer, length, grain), PIECES), "pieces")


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack over ascending sizes: value and counts of the pattern worth most."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for room in range(1, capacity + 1):
        worth[room], n = worth[room - 1], fits[room]
        if n:
            gains = worth[room - sizes[:n]] + prices[:n]
            k = gains.argmax()
            if gains[k] > worth[room] + 1e-12:
                worth[room], last[room] = gains[k], k
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            counts[last[room]] += 1
            room -= sizes[last[room]]
    return float(worth[capacity]), counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, fractional, with patterns @ used == demand. Ends when no
    pattern improves, or when the bound objective / best price shows the rest is below ``gap``."""
    m = len(sizes)
    copies = capacity // sizes
    patterns = np.diag(copies.astype(float))
    inverse, used, price = np.diag(1.0 / copies), demand / copies, 1.0 / copies
    while True:
        value, column = best_pattern(sizes, price, capacity)
        if value <= 1 + gap:
            return patterns, np.maximum(used, 0)
        direction = inverse @ column
        up = direction > 1e-9
        ratio = np.where(up, used / np.where(up, direction, 1), np.inf)
        k = int(np.argmin(ratio))
        step = ratio[k]
        used -= step * direction
        used[k] = step
        row = inverse[k] / direction[k]
        inverse -= np.outer(direction, row)
        inverse[k] = row
        patterns[:, k] = column
        price = price + (1 - value) * row
        if m == 1:
            return patterns, used


def runs(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int, dict[int, int]]:
    """Rank ranges of each class: (cls, from, to, first sequence, copies a sequence, first slot), the number of
    sequences, and how many pieces of each class the rounded patterns take."""
    classes = np.array(sorted(counts), dtype=int)
    patterns, used = solve(classes, np.array([counts[c] for c in classes], dtype=float), capacity)
    taken, sequence, out = dict.fromkeys(classes.tolist(), 0), 0, []
    for p in np.argsort(-used, kind="stable"):
        times = min(
            [int(used[p] + 1e-7)]
            + [(counts[int(c)] - taken[int(c)]) // int(a) for c, a in zip(classes, patterns[:, p]) if a]
        )
        if times <= 0:
            continue
        slot = 0
        for c, a in zip(classes.tolist()[::-1], patterns[::-1, p].astype(int).tolist()):
            if a:
                out.append((c, taken[c], taken[c] + times * a, sequence, a, slot))
                taken[c] += times * a
                slot += a
        sequence += times
    return out, sequence, taken


def tail(left: list[tuple], first: int, length: int) -> list[tuple]:
    """Lays pieces (key.., start, length) end to end: (key.., start, length, sequence, offset) of their cuts. The
    unfilled last sequence is cut into powers of two, largest first."""
    total = sum(x[-1] for x in left)
    rest = total % length
    ends = list(range(length, total - rest + 1, length))
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            ends.append((ends[-1] if ends else 0) + (1 << bit))
    out, at, k = [], 0, 0
    for *key, start, n in left:
        done = 0
        while done < n:
            take = min(n - done, ends[k] - at)
            begin = ends[k - 1] if k else 0
            out.append((*key, start + done, take, first + k, at - begin))
            done += take
            at += take
            k += at == ends[k]
    return out


def pack(stored: DataFrame, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """Places stored pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    An empty table gives no rows. Repeated rows are packed as often as they come. Lengths are whole numbers of
    ids, the empty text has the end id only.
    """
    spark = stored.sparkSession
    light = stored.drop("ids")
    per_task = light.groupBy("part", "cls").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("part", "cls", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_before"))
    # one row per length class: length // grain + 1 at most
    counts = {r["cls"]: r["n"] for r in light.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    placed, sequences, taken = runs(counts, length // grain) if counts else ([], 0, {})
    ranked = light.join(before, ["part", "cls"]).withColumn("_rank", F.col("_before") + F.col("local"))
    ranked = materialize(ranked.drop("_before"), "ranked")
    slots = spark.createDataFrame(
        placed, "_cls int, _from long, _to long, _seq long, _copies long, _slot long"
    )  # classes times patterns at most
    mine = (F.col("cls") == F.col("_cls")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    inside = F.col("_rank") - F.col("_from")
    fitted = ranked.join(F.broadcast(slots), mine).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_seq") + F.floor(inside / F.col("_copies"))).alias("sequence_id"),
        (F.col("_slot") + inside % F.col("_copies")).alias("_slot"),
    )
    earlier = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    fitted = fitted.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("_slot")

    limits = spark.createDataFrame(sorted(taken.items()), "cls int, _taken long")
    # what rounding leaves: under one pattern's pieces for each class
    left = (
        ranked.join(F.broadcast(limits), "cls")
        .where(F.col("_rank") >= F.col("_taken"))
        .select("part", "cls", "local", "start", "length", "_rank")
        .collect()
    )
    left.sort(key=lambda r: (-r["cls"], r["_rank"]))
    cuts = spark.createDataFrame(
        tail([tuple(r)[:5] for r in left], sequences, length),
        "part int, cls int, local long, _start long, _length long, sequence_id long, offset long",
    )
    ids = F.expr("substring(ids, cast(4 * (_start - start) as int) + 1, cast(4 * _length as int))")
    cut = stored.join(F.broadcast(cuts), ["part", "cls", "local"]).select(
        "doc_id", F.col("_start").alias("start"), F.col("_length").alias("length"), F.crc32(ids).alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )
    return fitted.select(cut.columns).unionByName(cut)


def sequences(stored: DataFrame, plan: DataFrame) -> DataFrame:
    """The packed ids of one row per sequence: sequence_id, doc_ids and lengths of its pieces in order, and ids
    (little-endian unsigned 32 bit, not padded). Documents are told apart by their ids."""
    part = F.expr("substring(s.ids, cast(4 * (p.start - s.start) as int) + 1, cast(4 * p.length as int))")
    piece = F.expr("p.doc_id <=> s.doc_id and p.start >= s.start and p.start < s.start + s.length")
    rows = plan.alias("p").join(stored.alias("s"), piece)
    rows = rows.select("p.sequence_id", F.struct("p.offset", "p.doc_id", "p.length", part.alias("ids")).alias("piece"))
    whole = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    return whole.select(
        "sequence_id",
        F.col("pieces.doc_id").alias("doc_ids"),
        F.col("pieces.length").alias("lengths"),
        F.expr("aggregate(pieces.ids, cast('' as binary), (a, b) -> concat(a, b))").alias("ids"),
    )


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
