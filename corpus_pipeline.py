"""From raw documents to sharded training data: STAGES in order, each over what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import decontaminate, langid, mixing, near_dedup, sharding
from textquarry.llm.common import Tables, temporary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return near_dedup.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of test items out; drops documents that consist of them."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that sources have their target weights."""
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each document."""
    return sharding.assign(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("mix", mix_sources),
    ("shard", assign_shards),
]

#: The first three stages can't be told in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is a written table, read by the next stage.

    What a stage has written for itself is deleted when its result stands, a stage's result when the next one's does.
    Nulls, empty and long texts, repeated rows, empty tables and extra columns: as each stage's operator says.
    """
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        with temporary():
            docs = tables.write(stage(spark, docs, sf_dir))
        if number:
            tables.drop(number)
    return docs
