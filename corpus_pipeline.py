"""From documents to shards: five stages, each written as Parquet before the next reads it.

Rows without key are judged by their text. Every stage works
on all that its predecessor kept, and takes benchmark and labels from sf_dir.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import decontaminate, minhash, mixing, sharding, toxicity
from cellweave.llm.common import fold, read, stored

#: Token weights of the languages that the mixture aims at, and how far it grows for that at least.
TARGETS = {"en": 0.55, "de": 0.17, "fr": 0.16, "es": 0.12}
GROWTH = 1.2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's threshold; learned from the labels that op10 learns from."""
    trained = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    text, lang = (names[docs.columns.index(c)] for c in ("text", "lang"))
    scored = toxicity.score_toxicity(docs.toDF(*names), trained, names, text, lang)
    return scored.filter("not flagged").select(names).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return minhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.without_overlaps(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, and again as its rate says."""
    rates, _ = mixing.mixture(docs, read(spark, sf_dir, "labels").select("doc_id"), TARGETS, growth=GROWTH, least_rate=1.0)
    return mixing.repeated(docs, rates)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, shard and slot."""
    return sharding.shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The stages learn models and compare similarities, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
