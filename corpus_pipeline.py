"""A corpus pipeline of five stages over the given documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. `run` writes what a stage returns
as Parquet in the session's shared folder and reads it again for the next, so that a lost
executor never costs more than the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm.decontaminate import without_leaks
from tallyframe.llm.mixing import mixed
from tallyframe.llm.ngram_join import keep_one
from tallyframe.llm.sharding import with_shards
from tallyframe.llm.toxicity import without_toxic
from tallyframe.session import configure, settle

SHARDS = 16
#: The stages fit a model, follow links to their ends and permute by a hash: not for SQL.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine trained on the labelled ones doesn't call toxic."""
    return without_toxic(docs, _table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each component of 0.8 similar five-word shingle sets."""
    return keep_one(docs, size=5, threshold=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of their sources takes them."""
    return mixed(docs, SHARDS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it, in the order of the mix."""
    return with_shards(docs, SHARDS, kept=True)


STAGES = [("toxicity", toxicity), ("ngram-join", deduplicate), ("decontamination", decontaminate), ("mix", mix), ("shards", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
