"""Clusters, resolution events, merges and traces: what is known of one cluster, domain or run."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import clamp, of_project, source_profiles

#: Kinds of product identity, in the order of reports (fixed values).
SIGNALS = ("gtin", "brand", "manufacturer", "model", "mpn", "sku")
#: Reasons of separate clusters that a person should look at (fixed values).
CONFLICTS = ("identity_conflict", "target_cluster_identity_conflict")

Tables = Mapping[str, DataFrame]


def clusters(tables: Tables, project_id: str) -> DataFrame:
    """Active clusters with the number of their members and sources; the oldest first.

    Members are counted before they meet the clusters, so a cluster is one row of the join.
    """
    active = of_project(tables["entity_clusters"], project_id).where("merged_into_cluster_key = ''")
    domains = of_project(tables["entities"], project_id).select("entity_key", "source_domain")
    linked = of_project(tables["entity_cluster_members"], project_id).select("cluster_key", "entity_key").join(domains, "entity_key", "left")
    counts = linked.groupBy("cluster_key").agg(F.count("*").alias("member_count"), F.countDistinct("source_domain").alias("source_count"))
    rows = active.select("cluster_key", "entity_type", "canonical_title", "first_seen", "last_seen").join(counts, "cluster_key", "left")
    return rows.fillna(0, ["member_count", "source_count"]).orderBy("first_seen", "cluster_key")


def cluster_members(tables: Tables, project_id: str, cluster_key: str | None = None) -> DataFrame:
    """Members of one cluster, or of all, with how often each was observed; in order of linking."""
    rows = of_project(tables["entity_cluster_members"], project_id)
    if cluster_key is not None:
        rows = rows.where(F.col("cluster_key") == cluster_key)
    facts = of_project(tables["entities"], project_id).select("entity_key", "title", "source_url", "source_domain", "last_price", *[c for c in SIGNALS if c in tables["entities"].columns])
    seen = of_project(tables["observations"], project_id).join(rows.select("entity_key"), "entity_key", "left_semi").groupBy("entity_key").agg(F.count("*").alias("observation_count"), F.min("observed_at").alias("first_observed"), F.max("observed_at").alias("last_observed"))
    joined = rows.select("cluster_key", "entity_key", "match_reason", "linked_at").join(facts, "entity_key").join(seen, "entity_key", "left")
    return joined.fillna(0, ["observation_count"]).orderBy("cluster_key", "linked_at", "entity_key")


def identity_signals(members: DataFrame) -> DataFrame:
    """(cluster, signal, value, place): distinct identity values of a cluster's members, numbered as first seen."""
    named = [F.struct(F.lit(k).alias("signal"), F.col(k).cast("string").alias("value")) for k in SIGNALS if k in members.columns]
    values = members.select("cluster_key", "linked_at", "entity_key", F.explode(F.array(*named)).alias("s")).where("s.value <> ''")
    return values.groupBy("cluster_key", "s.signal", "s.value").agg(F.min(F.struct("linked_at", "entity_key")).alias("first"))


def resolution_events(events: DataFrame, project_id: str, run_id: int | None = None, limit: int = 100) -> DataFrame:
    """Logged decisions in order, of one run if given."""
    rows = of_project(events, project_id)
    return (rows if run_id is None else rows.where(F.col("run_id") == run_id)).orderBy("id").limit(clamp(limit))


def _to_review(kind: str) -> Column:
    ambiguous = F.col("decision") == "deferred_ambiguous"
    conflict = (F.col("decision") == "created_separate") & F.col("reason").isin(*CONFLICTS)
    tests = {"ambiguous": ambiguous, "conflict": conflict, "all": ambiguous | conflict}
    if kind.strip().casefold() not in tests:
        raise ValueError(f"kind must be one of {sorted(tests)}")
    return tests[kind.strip().casefold()]


def review_queue(tables: Tables, project_id: str, kind: str = "all", limit: int | None = 100) -> DataFrame:
    """Decisions on active clusters that a person should look at, oldest first."""
    events = of_project(tables["entity_resolution_events"], project_id).where(_to_review(kind))
    facts = of_project(tables["entities"], project_id).select("entity_key", "title", "source_url", "source_domain")
    active = of_project(tables["entity_clusters"], project_id).where("merged_into_cluster_key = ''").select(F.col("cluster_key").alias("selected_cluster_key"), "canonical_title")
    rows = events.join(facts, "entity_key").join(active, "selected_cluster_key")
    rows = rows.select(F.col("id").alias("event_id"), "run_id", "entity_key", "decision", "reason", "selected_cluster_key", "compared_entities", "resolved_at", "title", "source_url", "source_domain", "canonical_title").orderBy("event_id")
    return rows if limit is None else rows.limit(clamp(limit))


def merge_events(events: DataFrame, project_id: str, limit: int = 100) -> DataFrame:
    """Audit of requested merges, in order."""
    return of_project(events, project_id).orderBy("id").limit(clamp(limit))


def apply_merge(tables: Tables, project_id: str, source: str, target: str, verdict: tuple[str, str], at: datetime, event_id: int) -> dict[str, DataFrame]:
    """Tables after a requested merge: members moved, the source marked as merged, one audit row.

    A rejected request changes nothing but the audit.  Every step is a
    projection of its table; only the three counts of the audit meet the driver.
    """
    decision, reason = verdict
    members, known = tables["entity_cluster_members"], tables["entity_clusters"]
    ours = (F.col("project_id") == project_id)
    sizes = {r.cluster_key: r.n for r in of_project(members, project_id).where(F.col("cluster_key").isin(source, target)).groupBy("cluster_key").agg(F.count("*").alias("n")).collect()}
    moved = decision == "merged"
    audit = [(event_id, project_id, source, target, decision, reason, sizes.get(source, 0), sizes.get(target, 0), sizes.get(source, 0) + sizes.get(target, 0) if moved else 0, at)]
    shape = "id long, project_id string, source_cluster_key string, target_cluster_key string, decision string, reason string, source_member_count long, target_member_count long, merged_member_count long, requested_at timestamp"
    out = {"entity_cluster_members": members, "entity_clusters": known, "entity_cluster_merge_events": tables["entity_cluster_merge_events"].unionByName(members.sparkSession.createDataFrame(audit, shape))}
    if moved:
        stamp = F.lit(at).cast("timestamp")
        gone = ours & (F.col("cluster_key") == source)
        out["entity_cluster_members"] = members.withColumn("cluster_key", F.when(gone, target).otherwise(F.col("cluster_key")))
        out["entity_clusters"] = known.withColumns({
            "merged_into_cluster_key": F.when(gone, target).otherwise(F.col("merged_into_cluster_key")),
            "merged_at": F.when(gone, stamp).otherwise(F.col("merged_at")),
            "last_seen": F.when(ours & (F.col("cluster_key") == target), F.greatest("last_seen", stamp)).otherwise(F.col("last_seen"))})
    return out


def reobserved(entities: DataFrame, tables: Tables, project_id: str, at: datetime) -> tuple[DataFrame, DataFrame]:
    """Entities that have no cluster yet, and clusters with ``last_seen`` set where a member came up again."""
    linked = of_project(tables["entity_cluster_members"], project_id).select("entity_key", "cluster_key")
    fresh = entities.join(linked, "entity_key", "left_anti")
    touched = entities.select("entity_key").join(linked, "entity_key").select("cluster_key").distinct().withColumn("_seen", F.lit(True))
    rows = tables["entity_clusters"].join(touched, "cluster_key", "left")
    return fresh, rows.withColumn("last_seen", F.when(F.col("_seen") & (F.col("project_id") == project_id), F.lit(at).cast("timestamp")).otherwise(F.col("last_seen"))).drop("_seen")


def explain_cluster(tables: Tables, project_id: str, cluster_key: str) -> dict[str, DataFrame]:
    """All that is known of one cluster: summary, members, identity signals, events, merges, review items.

    Every table is filtered by the key before it is joined; an unknown key gives empty frames.
    """
    one = of_project(tables["entity_clusters"], project_id).where(F.col("cluster_key") == cluster_key)
    members = cluster_members(tables, project_id, cluster_key)
    totals = members.agg(F.count("*").alias("member_count"), F.countDistinct(F.nullif("source_domain", F.lit(""))).alias("source_count"), F.coalesce(F.sum("observation_count"), F.lit(0)).cast("long").alias("observation_count"))
    events = of_project(tables["entity_resolution_events"], project_id)
    mine = events.join(members.select("entity_key", F.lit(True).alias("_member")), "entity_key", "left").where(F.col("_member") | (F.col("selected_cluster_key") == cluster_key)).drop("_member")
    merges = of_project(tables["entity_cluster_merge_events"], project_id).where((F.col("source_cluster_key") == cluster_key) | (F.col("target_cluster_key") == cluster_key))
    return {
        "summary": one.withColumn("status", F.when(F.col("merged_into_cluster_key") != "", "merged").otherwise("active")).crossJoin(totals).drop("project_id"),
        "members": members, "identity_signals": identity_signals(members), "resolution_events": mine.orderBy("id"), "merge_events": merges.orderBy("id"),
        "review_items": review_queue(tables, project_id, limit=1000).where(F.col("selected_cluster_key") == cluster_key)}


def explain_domain(tables: Tables, project_id: str, domain: str, as_of: datetime | None = None, limit: int = 100) -> dict[str, DataFrame]:
    """All that is known of one domain: profile, newest discoveries and visits, feeds."""
    names = ("domains", "page_visits", "feeds", "domain_discoveries", "observations", "entities")
    newest = lambda name, column: of_project(tables[name], project_id).where(F.col(column) == domain).orderBy(F.desc("id")).limit(clamp(limit))
    return {
        "profile": source_profiles(*[tables[n] for n in names], project_id, limit=None, as_of=as_of, domain=domain),
        "discoveries": newest("domain_discoveries", "target_domain"), "page_visits": newest("page_visits", "domain"),
        "feeds": of_project(tables["feeds"], project_id).where(F.col("domain") == domain).orderBy("feed_url")}


def trace_run(tables: Tables, project_id: str, run_id: int) -> dict[str, DataFrame]:
    """All that one run left behind, each part in order of arrival; observations with their entity and cluster."""
    of_run = lambda name: of_project(tables[name], project_id).where(F.col("run_id") == run_id)
    facts = of_project(tables["entities"], project_id).select("entity_key", F.col("title").alias("entity_title"), "entity_type", F.col("source_url").alias("entity_url"), F.col("source_domain").alias("entity_domain"))
    linked = of_project(tables["entity_cluster_members"], project_id).select("entity_key", "cluster_key", "match_reason")
    seen = of_run("observations").select("id", "entity_key", "observed_at", F.col("price").cast("double").alias("price"), "currency").join(facts, "entity_key", "left").join(linked, "entity_key", "left")
    plain = {c: F.coalesce(c, F.lit("")) for c in ("entity_title", "entity_type", "entity_url", "entity_domain", "currency", "cluster_key", "match_reason")}
    parts = {name: of_run(source).orderBy("id") for name, source in (("page_visits", "page_visits"), ("discoveries", "domain_discoveries"), ("entity_resolution_events", "entity_resolution_events"))}
    if "adaptive_decisions" in tables:
        parts["adaptive_decisions"] = of_run("adaptive_decisions").orderBy("sequence")
    return {"run": of_project(tables["runs"], project_id).where(F.col("id") == run_id), **parts,
            "observations": seen.withColumns(plain).orderBy("id"), "feed_snapshots": of_run("feed_snapshots").orderBy("feed_url")}


def part_counts(parts: Mapping[str, DataFrame]) -> DataFrame:
    """(part, n): rows of each part of a trace or an explanation."""
    out = None
    for name, part in parts.items():
        row = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionAll(row)
    return out


def stop_reason(c: Mapping[str, Column]) -> Column:
    """Why a run ended, from its counters: the first rule that holds.

    ``c``: decided, visited, attempted, max_pages, specific_target, mode,
    candidates_left, probe_domains, max_probe_domains, probe_pages,
    max_probe_pages, occupied, max_domains, over_budget.
    """
    probing = (
        F.when(c["candidates_left"] == 0, "search_candidates_exhausted")
        .when((c["max_probe_domains"] <= 0) | (c["max_probe_pages"] <= 0), "probe_budget_disabled")
        .when(c["probe_domains"] >= c["max_probe_domains"], "probe_domain_budget_exhausted")
        .when(c["probe_pages"] >= c["max_probe_pages"], "probe_page_budget_exhausted").otherwise("search_candidates_unreached"))
    return (
        F.when(F.coalesce(c["decided"], F.lit("")) != "", c["decided"]).when(c["visited"] >= c["max_pages"], "max_pages").when(c["attempted"] >= c["max_pages"], "max_page_attempts")
        .when(c["specific_target"], "discovery_exhausted").when(c["mode"] == "expedition", probing)
        .when((c["occupied"] >= c["max_domains"]) & c["over_budget"], "max_domains").otherwise("budget_exhausted"))


def coverage_status(reason: Column, specific_target: Column) -> Column:
    """What a stop reason says about coverage."""
    limited = ("max_pages", "max_page_attempts", "max_domains", "probe_budget_disabled", "probe_domain_budget_exhausted", "probe_page_budget_exhausted", "search_candidates_unreached")
    return (
        F.when(specific_target, "specific_target").when(reason == "search_candidates_exhausted", "candidate_pool_exhausted")
        .when(reason.isin("saturation_reached", "diminishing_returns"), "adaptive_stop").when(reason.isin(*limited), "resource_limited").otherwise("other"))
