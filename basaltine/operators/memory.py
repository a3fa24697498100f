"""Research memory: yield of queries and sources over the accumulated history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_AFTER_DAYS = 30.0


def clamp(limit: int, most: int = 1000) -> int:
    """A limit of at least 1 and at most ``most``."""
    return max(1, min(int(limit), most))


def flag(condition: Column) -> Column:
    """Number of rows for which a condition holds."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where whole is 0."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def of_project(df: DataFrame, project_id: str) -> DataFrame:
    return df.where(F.col("project_id") == project_id)


def query_memory(discoveries: DataFrame, project_id: str, limit: int = 20) -> DataFrame:
    """Yield of each search query: events, distinct domains, actions, rates; best first."""
    action, domain = F.col("action"), F.col("target_domain")
    productive = action.isin("activated", "known")
    rows = of_project(discoveries, project_id).where(F.coalesce("query_text", F.lit("")) != "").groupBy("provider", "query_text").agg(
        F.count("*").alias("result_events"), F.countDistinct(domain).alias("unique_domains"),
        *[flag(action == a).alias(a) for a in ("activated", "known", "blocked", "recorded")],
        F.countDistinct("run_id").alias("runs"), F.max("discovered_at").alias("last_used"),
        F.countDistinct(F.when(productive, domain)).alias("productive_domains"), F.countDistinct(F.when(action == "blocked", domain)).alias("blocked_domains"),
    )
    ranked = rows.orderBy(F.desc("productive_domains"), F.desc("activated"), F.desc("unique_domains"), F.desc("result_events"), "query_text", "provider").limit(clamp(limit))
    return ranked.withColumn("provider", F.coalesce("provider", F.lit(""))).withColumns({
        "activation_rate": ratio(F.col("activated"), F.col("result_events")),
        "productive_domain_rate": ratio(F.col("productive_domains"), F.col("unique_domains")),
    })


def _searched(runs: DataFrame, project_id: str) -> DataFrame:
    return of_project(runs, project_id).where("search_queries_issued > 0 OR search_results_seen > 0 OR search_provider_errors > 0")


def search_duplication(runs: DataFrame, project_id: str) -> DataFrame:
    """One row: what searches returned over all runs, and how much of it was seen before."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    sums = _searched(runs, project_id).agg(
        F.count("*").alias("runs"), total("search_queries_issued", "queries"), total("search_results_seen", "raw_results"),
        total("search_results_unique", "unique_results"), total("search_results_duplicates", "duplicates"), total("search_provider_errors", "provider_errors"))
    return _with_filtered(sums)


def _with_filtered(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "filtered_results": F.greatest(F.lit(0), F.col("raw_results") - F.col("unique_results") - F.col("duplicates")).cast("long"),
        "duplicate_rate": ratio(F.col("duplicates"), F.col("raw_results")),
    })


def recent_search_runs(runs: DataFrame, project_id: str, limit: int = 20) -> DataFrame:
    """The same for each run, newest first."""
    rows = _searched(runs, project_id).orderBy(F.desc("id")).limit(clamp(limit))
    return _with_filtered(rows.select(
        F.col("id").alias("run_id"), "started_at", "finished_at", F.col("search_queries_issued").alias("queries"), F.col("search_results_seen").alias("raw_results"),
        F.col("search_results_unique").alias("unique_results"), F.col("search_results_duplicates").alias("duplicates"), F.col("search_provider_errors").alias("provider_errors")))


def age_days(at: Column, now: Column) -> Column:
    """Days from ``at`` to ``now``, not below 0; null stays null."""
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.when(at.isNotNull(), F.greatest(F.lit(0.0), seconds / F.lit(86400e6)))


def source_profiles(
    domains: DataFrame, visits: DataFrame, feeds: DataFrame, discoveries: DataFrame, observations: DataFrame, entities: DataFrame, project_id: str,
    limit: int | None = 50, stale_after_days: float = STALE_AFTER_DAYS, as_of: datetime | None = None, domain: str | None = None,
) -> DataFrame:
    """Track record of each source: visits, feeds, discoveries, observations, freshness.

    Each side is aggregated to one row a domain before it is joined.  With
    ``domain`` only that source is computed, whatever its rank.
    """
    outcome = F.col("outcome")
    one = lambda df, c="domain": of_project(df, project_id) if domain is None else of_project(df, project_id).where(F.col(c) == domain)
    visited = one(visits).groupBy("domain").agg(
        F.count("*").alias("visit_count"), F.countDistinct("run_id").alias("crawl_runs"), flag(outcome == "html_ok").alias("successful_visits"),
        flag(F.lower(outcome).startswith("http_error:") | outcome.isin("unsafe_redirect", "http_status")).alias("failed_visits"), F.max("visited_at").alias("last_visit"))
    fed = one(feeds).groupBy("domain").agg(F.count("*").alias("feed_count"), F.max("last_success").alias("last_feed_success"))
    found = one(discoveries, "target_domain").groupBy(F.col("target_domain").alias("domain")).agg(
        F.count("*").alias("discovery_events"), flag(F.col("action") == "activated").alias("activated_events"),
        flag(F.col("action") == "blocked").alias("blocked_events"), F.max("discovered_at").alias("last_discovered"))
    named = one(entities, "source_domain").where(F.coalesce("source_domain", F.lit("")) != "").select("entity_key", F.col("source_domain").alias("domain"))
    seen = of_project(observations, project_id).select("entity_key", "run_id", "observed_at").join(named, "entity_key").groupBy("domain").agg(
        F.count("*").alias("observation_count"), F.countDistinct("run_id").alias("productive_runs"), F.max("observed_at").alias("last_useful_at"))
    rows = one(domains)
    for side in (visited, fed, found, seen):
        rows = rows.join(side, "domain", "left")
    counts = ("visit_count", "crawl_runs", "successful_visits", "failed_visits", "feed_count", "discovery_events", "activated_events", "blocked_events", "observation_count", "productive_runs")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    rows = rows.orderBy(F.desc("productive_runs"), F.desc("entities_found"), F.desc("pages_seen"), F.desc("relevance_score"), "domain")
    if limit is not None:
        rows = rows.limit(clamp(limit))
    now = F.lit(as_of) if as_of is not None else F.current_timestamp()
    rows = rows.withColumns({
        "entity_yield": ratio(F.col("entities_found"), F.col("pages_seen")),
        "success_rate": ratio(F.col("successful_visits"), F.col("visit_count")),
        "productive_run_rate": ratio(F.col("productive_runs"), F.col("crawl_runs")),
        "age_since_last_useful_days": age_days(F.col("last_useful_at"), now),
        "age_since_last_crawl_days": age_days(F.col("last_crawled"), now),
        "age_since_last_feed_success_days": age_days(F.col("last_feed_success"), now),
        "stale_reference": F.when(F.col("last_useful_at").isNotNull(), "last_useful_at").when(F.col("last_crawled").isNotNull(), "last_crawled").otherwise("last_seen"),
        "stale_age_days": age_days(F.coalesce("last_useful_at", "last_crawled", "last_seen"), now),
    })
    stale = F.coalesce(F.col("stale_age_days") > max(0.0, float(stale_after_days)), F.lit(False))
    return rows.withColumns({"is_stale": stale, "freshness": F.when(stale, "stale").otherwise("fresh")}).drop("project_id")


def counts_by(df: DataFrame, project_id: str, column: str, run_id: int | None = None) -> DataFrame:
    """Rows of each value of a column, of one run if given."""
    rows = of_project(df, project_id)
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def listing(df: DataFrame, project_id: str, order: list[Column], limit: int | None = None, **equal: object) -> DataFrame:
    """Rows of a project in order; filters given as None are left out."""
    rows = of_project(df, project_id)
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(clamp(limit))


def grouped_trace(discoveries: DataFrame, project_id: str, run_id: int) -> DataFrame:
    """Discoveries of a run grouped by their six descriptive fields, largest groups first."""
    keys = ("target_domain", "action", "reason", "discovered_via", "provider", "query_text")
    rows = of_project(discoveries, project_id).where(F.col("run_id") == run_id)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("relevance_score").alias("max_score"), F.min_by("target_url", "id").alias("first_url")).orderBy(F.desc("n"), "target_domain", "action", "discovered_via")
