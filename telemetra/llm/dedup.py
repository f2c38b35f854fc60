"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct 5-word shingles as 64-bit hashes. One permutation scatters the shingles over a
universe; a second one, circularly shifted by 1, 2, 3 ..., gives every signature coordinate, so a shingle adds one
contiguous slice of that permutation to the running minimum.

Equal sets are one class from the start. Representatives that share a band are candidates. First every bucket's
members meet its smallest member only (a star: rows grow with members, not pairs). What verifies is linked, and
then only buckets that still hold several components are looked at. In rounds, their members meet one member drawn
by hash, as long as that links many; links close buckets, so a group held together by chains is not compared whole.
What is still open is dealt to blocks, and a task compares two blocks: signature bits first, as a matrix, then the
full sets of those with a likely partner. It returns the links that join its components, not pairs. Members of one
component need no further link. So no candidate pair that could join two components is left out, and no group, alike
or just under the limit, becomes a table of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm.common import documents, mix, start_task
from telemetra.llm.components import components
from telemetra.session import materialize

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 51, 5  # misses a pair of similarity 0.75 once in a million
UNIVERSE = 1 << 18
SEED = 20_240_601
#: bits (one a coordinate) that must agree before a pair's sets are compared. At similarity 0.75 a bit agrees with
#: probability 0.875: of 255 bits 223 +- 5.3, so this is more than five deviations below.
AGREE = 195
#: members and shingles of a block, about; a task holds two blocks
BLOCK, HELD = 1024, 1_000_000

_EMPTY = np.zeros(0, dtype=np.uint64)


_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
with np.errstate(over="ignore"):
    _SPREAD = mix(np.arange(64 << 8, dtype=np.uint64) + np.uint64(SEED))  # hashes of (place, byte); later places: the same rule


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text: the sum over a word's bytes of a hash of byte and place."""
    data = np.frombuffer(text, dtype=np.uint8)
    at = np.flatnonzero(~_GAP[data])
    if not len(at):
        return _EMPTY
    begin = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
    at = (place << 8) + data[at]
    spread = _SPREAD[at] if at.max() < len(_SPREAD) else mix(at.astype(np.uint64) + np.uint64(SEED))
    return mix(np.add.reduceat(spread, begin))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; a shorter text is one shingle, no word gives none."""
    with np.errstate(over="ignore"):
        h = word_hashes(text.encode("utf-8", "surrogatepass").lower())
        if not len(h):
            return _EMPTY
        n = max(1, len(h) - size + 1)
        out = np.full(n, np.uint64(min(size, len(h))), dtype=np.uint64)
        for k in range(min(size, len(h))):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


class Circulant:
    """Signatures of ``k`` coordinates from two permutations of the universe."""

    def __init__(self, k: int = BANDS * ROWS, universe: int = UNIVERSE, seed: int = SEED):
        pi = np.random.default_rng(seed).permutation(universe).astype(np.uint32)
        self.slices = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:k]]), k)
        self.k, self.universe = k, universe

    def signature(self, sets: np.ndarray) -> np.ndarray:
        """The first permutation is a hash of the shingle; coordinate i is the least of the second, shifted by i."""
        at = (mix(sets ^ np.uint64(SEED)) & np.uint64(self.universe - 1)).astype(np.int64)
        least = self.slices[at[0]].copy()
        for i in range(0, len(at), 4096):
            np.minimum(least, self.slices[at[i : i + 4096]].min(axis=0), out=least)
        return least


_circulants: dict[int, Circulant] = {}

SKETCH = "doc_id long, n_shingles long, set_key string, bits array<long>, bands array<long>"


def _sketch(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task()
        made = _circulants.setdefault(bands * rows, None) or Circulant(bands * rows)
        _circulants[bands * rows] = made
        with np.errstate(over="ignore"):
            salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
            for batch in batches:
                ids, sizes, keys, made_from, least = batch.column(0).to_pylist(), [], [], [], []
                for i, text in enumerate(batch.column(1)):
                    own = shingles(text.as_py())
                    sizes.append(len(own))
                    keys.append(f"{len(own)}:{int(own.sum()):x}:{int(mix(own + np.uint64(SEED)).sum()):x}" if len(own) else None)
                    if len(own):
                        made_from.append(i)
                        least.append(made.signature(own))
                bits, keyed = [None] * len(ids), [None] * len(ids)
                if least:
                    signatures = np.stack(least).astype(np.uint64)
                    packed = np.packbits((mix(signatures) & np.uint64(1)).astype(np.uint8), axis=1)
                    hashed = np.broadcast_to(salt, (len(least), bands))
                    for k in range(rows):
                        hashed = mix(hashed * np.uint64(31) + signatures[:, k::rows])
                    for i, own_bits, own_bands in zip(made_from, packed, hashed.view(np.int64)):
                        bits[i], keyed[i] = np.pad(own_bits, (0, -len(own_bits) % 8)).view(np.int64), own_bands
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip((ids, sizes, keys, bits, keyed), kinds)],
                    names=[x.split()[0] for x in SKETCH.split(", ")],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            sets = [shingles(t.as_py()).view(np.int64) for t in some.column(1)]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"]
            )


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v, further columns) whose full sets have a Jaccard similarity of ``percent`` or more, stored. Each
    pair row carries two sets while it streams through the joins."""
    both = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("_a")), "u").join(
        sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("_b")), "v"
    )
    both = both.withColumn("_common", F.size(F.array_intersect("_a", "_b")))
    enough = 100 * F.col("_common") >= percent * (F.size("_a") + F.size("_b") - F.col("_common"))
    return materialize(both.where(enough).select(*pairs.columns), "links")


def still_open(inside: DataFrame) -> DataFrame:
    """The members (band, component, ...) of bands that hold several components."""
    ends = inside.groupBy("band").agg(F.min("component").alias("_a"), F.max("component").alias("_b"))
    return inside.join(ends.where("_a < _b").select("band"), "band", "left_semi")


def meet_drawn(inside: DataFrame, sets: DataFrame, salt: int, percent: int, agree: int) -> DataFrame:
    """Links (u, v, component_u, component_v) between each member of a band and the one that ``salt`` draws there."""
    drawn = F.min(F.struct(F.xxhash64("doc_id", F.lit(salt)).alias("at"), *FACTS)).alias("drawn")
    centres = inside.groupBy("band").agg(drawn).select("band", *[F.col(f"drawn.{c}").alias(n + "u") for c, n in NAMED])
    pairs = inside.select("band", *[F.col(c).alias(n + "v") for c, n in NAMED]).join(centres, "band")
    pairs = pairs.where(F.expr("component_u != component_v") & _alike(percent, agree))
    return verify(pairs.select("u", "v", "component_u", "component_v").distinct(), sets, percent)


def deal(inside: DataFrame, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """The members of open bands dealt to tiles: ``tile, side`` and their facts.

    A component beyond a block's size has blocks of its own, the others of a band share blocks. A tile is two blocks
    of a band, or one with itself, that hold more than one component between them; side tells the two apart.
    """
    need = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("w") / held))
    own = inside.groupBy("band", "component").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w"))
    own = own.withColumn("parts", need)
    shared = own.where("parts = 1").groupBy("band").agg(F.sum("m").alias("m"), F.sum("w").alias("w"))
    own = own.join(shared.select("band", need.alias("shared")), "band", "left")
    rows = inside.join(own.select("band", "component", "parts", "shared"), ["band", "component"])
    apart = F.concat_ws(":", "component", F.pmod(F.xxhash64("doc_id"), "parts"))
    mixed = F.concat_ws(":", F.lit("-"), F.pmod(F.xxhash64("component"), "shared"))
    rows = rows.withColumn("block", F.when(F.col("parts") > 1, apart).otherwise(mixed)).select("band", "block", *FACTS)
    rows = materialize(rows, "dealt")  # read by the blocks, on both sides of a tile, and by the members of tiles
    blocks = rows.groupBy("band", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    blocks = materialize(blocks, "blocks")
    two = blocks.select("band", *[F.col(c).alias(f"{c}_2") for c in ("block", "lo", "hi")])
    tiles = blocks.join(two, "band").where("block <= block_2 and least(lo, lo_2) < greatest(hi, hi_2)")
    name = F.concat_ws("|", "band", "block", "block_2").alias("tile")
    sides = F.expr("if(block = block_2, array(block), array(block, block_2))")
    spots = tiles.select("band", name, F.posexplode(sides).alias("side", "block"))
    return rows.join(spots, ["band", "block"]).select("tile", "side", *FACTS)


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition("tile").sortWithinPartitions("tile")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Each tile of sorted rows, and the places of its two sides; the same places twice for a block with itself."""

    def sides(parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks()
        second = rows["side"].to_numpy() == 1
        left, right = np.flatnonzero(~second), np.flatnonzero(second)
        return rows, left, right if len(right) else left

    parts: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        tile = batch.column("tile")
        new = pc.not_equal(tile.slice(1), tile.slice(0, max(0, len(tile) - 1))).to_numpy(zero_copy_only=False)
        for begin, end in pairwise([0, *(np.flatnonzero(new) + 1), len(tile)]):
            if begin == end:
                continue
            name = tile[begin].as_py()
            if parts and name != last:
                yield sides(parts)
                parts = []
            last = name
            parts.append(batch.slice(begin, end - begin))
    if parts:
        yield sides(parts)


def _likely(percent: int, agree: int):
    """For ``mapInArrow``: the members of a tile with a partner in another component, by sizes and signature bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task()
        for rows, left, right in _tiles(batches):
            component, n = rows["component"].to_numpy(), rows["n_shingles"].to_numpy()
            bits = pc.list_flatten(rows["bits"]).to_numpy().view(np.uint64).reshape(len(n), -1)
            found = np.zeros(len(n), dtype=bool)
            for at in range(0, len(left), 64):
                some = left[at : at + 64, None]
                apart = np.bitwise_count(bits[some] ^ bits[right]).sum(axis=2, dtype=np.int64)
                fits = 100 * np.minimum(n[some], n[right]) >= percent * np.maximum(n[some], n[right])
                fits &= (BANDS * ROWS - apart >= agree) & (component[some] != component[right])
                found[left[at : at + 64]] |= fits.any(axis=1)
                found[right] |= fits.any(axis=0)
            if found.any():
                yield from rows.select(["tile", "side", "doc_id", "component"]).filter(pa.array(found)).combine_chunks().to_batches()

    return run


def _forest(percent: int):
    """For ``mapInArrow``: of the links between full sets of a tile those that join its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task()
        for rows, left, right in _tiles(batches):
            ids, component = rows["doc_id"].to_numpy(), rows["component"].to_numpy()
            sets = [s.values.to_numpy() for s in rows["shingles"]]
            sizes = np.array([len(s) for s in sets])
            # the shingles of the right side in order, with the rows that hold them
            held = np.concatenate([sets[j] for j in right])
            row = np.repeat(np.arange(len(right)), sizes[right])
            order = np.argsort(held, kind="stable")
            held, row = held[order], row[order]
            top: dict[int, int] = {}

            def root(c: int) -> int:
                while c in top:
                    c = top[c]
                return c

            links = []
            for i in left:
                begin, end = np.searchsorted(held, sets[i], "left"), np.searchsorted(held, sets[i], "right")
                times = end - begin
                at = np.arange(times.sum()) + np.repeat(begin - np.r_[0, np.cumsum(times)[:-1]], times)
                common = np.bincount(row[at], minlength=len(right))
                enough = 100 * common >= percent * (sizes[i] + sizes[right] - common)
                for j in right[enough & (component[right] != component[i])]:
                    a, b = root(int(component[i])), root(int(component[j]))
                    if a != b:
                        top[a] = b
                        links.append((int(ids[i]), int(ids[j])))
            if links:
                u, v = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def across(inside: DataFrame, sets: DataFrame, percent: int, agree: int, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """Links (u, v), stored, that join all components of a band with similar enough members, at most one fewer a tile
    than it has components."""
    likely = _by_tile(deal(inside, block, held)).mapInArrow(_likely(percent, agree), "tile string, side int, doc_id long, component long")
    likely = materialize(likely, "likely")
    links = _by_tile(likely.join(sets, "doc_id")).mapInArrow(_forest(percent), "u long, v long")
    return materialize(links, "links")


def near_duplicates(
    docs: DataFrame,
    bands: int = BANDS,
    rows: int = ROWS,
    percent: int = PERCENT,
    agree: int = AGREE,
    block: int = BLOCK,
    held: int = HELD,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked doc_id, itself included), kept.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing. Documents are
    told apart by doc_id: of rows that repeat an id, each is returned, and their texts are linked through the id.
    A row with a null id is linked with nothing. An empty table gives no rows.
    """
    docs = documents(docs)
    sketches = materialize(docs.mapInArrow(_sketch(bands, rows), SKETCH), "sketches")
    known = sketches.where("n_shingles > 0 and doc_id is not null")
    # equal sets first: the smallest id of a class stands for it. Only classes of several ids are joined, by slots, so
    # that a third of all rows in one class is not one task
    many = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last")
    many = many.select("set_key", "rep", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int")
    classes = known.select("doc_id", "set_key", slot.alias("slot")).join(many, ["set_key", "slot"])
    classes = materialize(classes.select("doc_id", "set_key", "rep"), "classes")
    others = classes.where("doc_id != rep").select("doc_id", "set_key")
    reps = known.join(others, ["doc_id", "set_key"], "left_anti").dropDuplicates(["doc_id", "n_shingles", "bits"])
    reps = materialize(reps.select("doc_id", "n_shingles", "bits", "bands"), "reps")
    # a bucket of one member is of no use; least and greatest id combine before the shuffle
    keyed = reps.select("doc_id", F.explode("bands").alias("band"))
    heads = keyed.groupBy("band").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last")
    members = materialize(keyed.join(heads.select("band", "head"), "band").select("doc_id", "band", "head"), "members")
    met = members.select("doc_id").distinct()
    sets = docs.join(met, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles array<long>")
    sets = materialize(sets.dropDuplicates(["doc_id"]), "sets")
    facts = reps.select("doc_id", "n_shingles", "bits")

    def with_facts(pairs: DataFrame) -> DataFrame:
        for side in "uv":
            own = facts.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
            pairs = pairs.join(own, side)
        return pairs

    star = members.where("doc_id != head").select(F.col("head").alias("u"), F.col("doc_id").alias("v")).distinct()
    links = verify(with_facts(star).where(_alike(percent, agree)).select("u", "v"), sets, percent)
    first = components(links)
    edges = first.select(F.col("component").alias("u"), F.col("node").alias("v"))

    # every pair with the head of a bucket is settled: what the others of several components still need
    inside = members.where("doc_id != head").select("doc_id", "band").join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    inside = still_open(inside.withColumn("component", F.coalesce("component", "doc_id")))
    inside = materialize(inside.join(facts, "doc_id").select("band", *FACTS), "inside")
    salt = 0
    while True:
        drawn = meet_drawn(inside, sets, salt, percent, agree)
        edges = edges.union(drawn.select("u", "v"))
        # a round that merges few components would only repeat the comparisons of the tiles, which settle every pair
        if drawn.count() * WORTH <= inside.select("component").distinct().count():
            break
        merged = components(drawn.select(F.col("component_u").alias("u"), F.col("component_v").alias("v")))
        merged = merged.select(F.col("node").alias("component"), F.col("component").alias("_into"))
        inside = inside.join(merged, "component", "left").withColumn("component", F.coalesce("_into", "component"))
        inside = materialize(still_open(inside).select("band", *FACTS), "inside")
        salt += 1

    edges = edges.union(across(inside, sets, percent, agree, block, held))

    # stars found before, new links between them, and the members of classes: a round or two from the end
    edges = edges.union(classes.select(F.col("rep").alias("u"), F.col("doc_id").alias("v")))
    found = components(edges).withColumnRenamed("node", "doc_id")
    out = sketches.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


SLOTS = 16  # parts of a class of equal sets
WORTH = 20  # a round is followed by another if it links more than one in so many open components
FACTS = ("doc_id", "component", "n_shingles", "bits")
NAMED = (("doc_id", ""), ("component", "component_"), ("n_shingles", "n_"), ("bits", "bits_"))


def _alike(percent: int, agree: int):
    """Sizes that allow the similarity, and signature bits that agree often enough."""
    apart = " + ".join(f"bit_count(bits_u[{i}] ^ bits_v[{i}])" for i in range(-(-BANDS * ROWS // 64)))
    sizes = F.expr(f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)")
    return sizes & (F.lit(BANDS * ROWS) - F.expr(apart) >= agree)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)
), pairs AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(doc_id, r) AS (SELECT u, v FROM pairs UNION SELECT reach.doc_id, pairs.v FROM reach JOIN pairs ON pairs.u = reach.r),
least AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY 1)
SELECT docs.doc_id, coalesce(n, 0) AS n_shingles, least(docs.doc_id, coalesce(r, docs.doc_id)) AS component_id,
  docs.doc_id = least(docs.doc_id, coalesce(r, docs.doc_id)) AS kept
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
