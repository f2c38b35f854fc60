"""A corpus pipeline of five stages: language, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and returns a DataFrame, which is
written as Parquet and reread. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm import decontaminate, dedup, language, packing, secrets
from telemetra.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: share of a text's n-grams that its language must know; far below that of any text in a learned language
KNOWN_SHARE = 0.1


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language: no letter, or too few n-grams of any language learned from the
    rows that carry one. ``lang`` stays as it is."""
    rows = docs.select(*COLUMNS)
    held = spark.sparkContext.broadcast(language.fit(rows))  # slots, of fixed size

    return rows.mapInArrow(language.keeping(held, KNOWN_SHARE), rows.schema)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group. Of several rows with one id the least (text, source, lang,
    n_chars) stays, nulls first, however the rows are dealt; rows without an id stay. An empty table gives no rows."""
    rows = docs.select(*COLUMNS)
    found = materialize(dedup.near_duplicates(rows).select("doc_id", "kept"), "kept")
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    left = rows.join(dropped, "doc_id", "left_anti")
    least = F.min(F.struct("text", "source", "lang", "n_chars")).alias("least")
    one = left.where("doc_id is not null").groupBy("doc_id").agg(least).select("doc_id", "least.*").select(*COLUMNS)
    return one.unionByName(left.where("doc_id is null").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs.select(*COLUMNS), benchmark)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; ``n_chars`` follows the text. No document goes."""
    return docs.select(*COLUMNS).mapInArrow(secrets.cleaning(), docs.select(*COLUMNS).schema)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language", by_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: tokens, learned languages and entropy windows are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
