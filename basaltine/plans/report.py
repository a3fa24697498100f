"""HTML report of a project, rendered from small aggregates."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence

CARDS = 200


def render(entities: DataFrame, domains: DataFrame, project_id: str) -> str:
    """Report page: totals, categories, domains and the first CARDS entities, relevant ones first."""
    total = evidence.report_analytics(entities, project_id).first()
    categories = evidence.category_counts(entities, project_id).orderBy(F.desc("n"), "category").limit(CARDS).collect()
    rows = entities.where(F.col("project_id") == project_id).orderBy(~F.col("is_relevant"), F.lower("title"), "entity_key").limit(CARDS).collect()
    hosts = domains.where(F.col("project_id") == project_id).groupBy("status").agg(F.count("*").alias("n")).orderBy("status").collect()
    cell = lambda *values: "<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in values) + "</tr>"
    return (
        f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(project_id)}</title></head><body><h1>{escape(project_id)}</h1><table>"
        + "".join(cell(name, value) for name, value in total.asDict().items()) + "</table><h2>Categories</h2><table>" + "".join(cell(r.category, r.n) for r in categories)
        + "</table><h2>Domains</h2><table>" + "".join(cell(r.status, r.n) for r in hosts) + "</table><h2>Entities</h2><table>"
        + "".join(cell(r.title, r.last_price, (r.seller or "").strip(), r.source_domain) for r in rows) + "</table></body></html>")
