"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import decontaminate, exact_dedup, langid, licenses, line_dedup, mixing, near_dedup, pii, repeats, sharding


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(documents(spark, sf_dir))


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir)).select("doc_id", "shard")


def op3_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedupe(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.identifiers(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.notices(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(documents(spark, sf_dir)).drop("cid")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), copy="copy").select("doc_id", "source", "copy")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_repeats,
        op2_rendezvous_sharding,
        op3_line_chunk_dedup,
        op4_pii,
        op5_license_scan,
        op6_decontamination,
        op7_near_dedup,
        op8_language_id,
        op9_exact_dedup,
        op10_mixing,
    )
}

SQL: dict[str, str] = {
    "op2_rendezvous_sharding": sharding.assign_sql("documents", "d.doc_id"),
    "op3_line_chunk_dedup": line_dedup.dedupe_sql(),
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_mixing": mixing.mix_sql("documents", "doc_id, source, copy"),
}
