"""The registered queries over the training-data operators, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import decontaminate, licenses, mixing, neardup, pii, sharding, substrings, tokencount, topk, toxicity
from .textkit import bound_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(_table(spark, sf_dir, "documents")).drop("spans")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def sharding_64k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 at a limit of 64 KiB, at which small tables split too."""
    return sharding.assign(_table(spark, sf_dir, "documents"), 1 << 16)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_pii": op2_pii,
    "op3_sharding": op3_sharding,
    "sharding_64k": sharding_64k,
    "op4_decontamination": op4_decontamination,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_licenses": op8_licenses,
    "op9_topk": op9_topk,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op3_sharding": sharding.oracle(),
    "sharding_64k": sharding.oracle(1 << 16),
    "op7_mixing": mixing.ORACLE,
    "op9_topk": topk.ORACLE,
}
