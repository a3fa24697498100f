"""Evidence quality of extracted fields, per entity and over a project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import band
from .memory import flag, of_project

WEAKEST = 5


def judged(facts: DataFrame, project_id: str) -> DataFrame:
    """Each fact with its verdict: missing, mismatched or supported, and band and default flag if supported.

    ``facts`` has one row for each entity and expected field.
    """
    verdict = F.when(F.col("is_missing"), "missing").when(F.col("is_mismatched"), "mismatched").otherwise("supported")
    good = verdict == "supported"
    return of_project(facts, project_id).withColumns({"verdict": verdict, "band": F.when(good, band(F.col("confidence"))), "is_default": good & F.col("evidence").startswith("default:")})


def by_entity(facts: DataFrame, project_id: str) -> DataFrame:
    """Summary of each entity, with its weakest supported fields."""
    rows = judged(facts, project_id)
    weak = F.slice(F.array_sort(F.collect_list(F.when(F.col("verdict") == "supported", F.struct("confidence", "field")))), 1, WEAKEST)
    return rows.groupBy("entity_key").agg(
        flag(F.col("verdict") != "missing").alias("field_count"), flag(F.col("verdict") == "supported").alias("supported"),
        *[flag(F.col("band") == b).alias(b) for b in ("high", "medium", "low")],
        flag(F.col("verdict") == "missing").alias("missing"), flag(F.col("verdict") == "mismatched").alias("mismatched"), flag(F.col("is_default")).alias("defaults"),
        F.array_join(F.transform(weak, lambda s: s["field"]), ",").alias("weakest"))


def by_field(facts: DataFrame, project_id: str) -> DataFrame:
    """How often each field is low, missing, mismatched or a default, one scan for all."""
    return judged(facts, project_id).groupBy("field").agg(
        flag(F.col("band") == "low").alias("low"), flag(F.col("verdict") == "missing").alias("missing"), flag(F.col("verdict") == "mismatched").alias("mismatched"), flag(F.col("is_default")).alias("defaults"))


def by_method(facts: DataFrame, project_id: str) -> DataFrame:
    """Supported facts of each extraction method."""
    return judged(facts, project_id).where("verdict = 'supported'").groupBy(F.coalesce(F.nullif("extraction_method", F.lit("")), F.lit("unknown")).alias("extraction_method")).agg(F.count("*").alias("n"))


def project_totals(facts: DataFrame, project_id: str) -> DataFrame:
    """One row: entities with and without evidence, facts, bands."""
    one = by_entity(facts, project_id)
    return one.agg(
        F.count("*").alias("entities"), flag(F.col("field_count") > 0).alias("with_evidence"), flag(F.col("field_count") == 0).alias("without_evidence"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("field_count", "supported", "high", "medium", "low")])


def report_analytics(entities: DataFrame, project_id: str) -> DataFrame:
    """One row for the report: totals, distinct sellers, and prices of relevant entities."""
    relevant, price = F.col("is_relevant"), F.when(F.col("is_relevant"), F.col("last_price"))
    seller = F.trim(F.coalesce("seller", F.lit("")))
    return of_project(entities, project_id).agg(
        F.count("*").alias("total"), flag(relevant).alias("relevant"), F.count(price).alias("priced"), F.countDistinct(F.when(relevant & (seller != ""), seller)).alias("sellers"),
        F.min(price).alias("min_price"), F.median(price).alias("median_price"), F.max(price).alias("max_price"))


def category_counts(entities: DataFrame, project_id: str) -> DataFrame:
    return of_project(entities, project_id).where("is_relevant").groupBy("category").agg(F.count("*").alias("n"))
