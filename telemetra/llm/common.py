"""Column helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the whole ``text``; null text is empty. Further columns, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("")).cast("binary")) % parts


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, a permutation of the 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_emptied: list[Callable[[], None]] = []  # what empties each cache of this worker
_stage: list[int | None] = [None]


def worker_cache(empty: Callable[[], None]) -> None:
    """Names the function that empties a cache a module keeps between tasks."""
    _emptied.append(empty)


def start_task() -> None:
    """To be called first by every task with a cache, and by tasks that need memory: a worker that runs another stage
    than before gives up what the tasks of that stage kept."""
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _stage[0]:
        for empty in _emptied:
            empty()
        pa.default_memory_pool().release_unused()
        _stage[0] = stage


class Words:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, bound: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.bound = bound

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.bound:
            known.clear()
        try:
            found = [known[w] for w in words]
        except KeyError:
            import xxhash

            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            found = [known[w] for w in words]
        return np.array(found, dtype=np.uint64)
