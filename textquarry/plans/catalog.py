"""The registered queries of the retrieval engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.plans import corpus, graphs, registry, text, vectors  # noqa: F401  (they register their queries)
from textquarry.plans.registry import Query


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each benchmark item, by BM25."""
    return text.bm25_batch_benchmark(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
