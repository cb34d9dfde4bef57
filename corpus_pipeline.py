"""Corpus pipeline: toxicity → near duplicates → decontamination → mixing → shards.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet and read again as the next stage's documents.  All but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vulnlake.llm import decontaminate, minhash, mixing, sharding, toxicity
from vulnlake.llm.common import staged
from vulnlake.sources.views import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go; the model is
    trained on the labelled documents among ``docs``.  Null and empty texts
    stay.  Repeated rows are judged alike."""
    return toxicity.keep_clean(spark, docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five-word shingles,
    similarity 0.8) stays, that of the least id.  Texts without words stay."""
    return minhash.keep_first(spark, docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go.  Null and empty texts
    hold no item and stay; repeated rows are judged alike; an empty table, of
    documents or of items, changes nothing."""
    return decontaminate.keep_uncontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's share of the mix takes it, in
    whole texts: the one document of a source on which the fraction runs out
    is taken if at least half of it is due.  Texts without words, null ones
    included, stay once; repeated rows count one by one; documents without a
    source are a source of their own; an empty table stays empty."""
    return mixing.repeat_documents(spark, docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their shard; shards hold nearly equal bytes.
    Null and empty texts have the size of a bare row; repeated rows are placed
    one by one; an empty table has no shards."""
    return sharding.shard_documents(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The trained toxicity model has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
