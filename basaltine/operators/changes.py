"""Change detection between two runs: entities, sources, fields, domains and feeds.

Each class of change is one join of the two runs' snapshots on its key; events
share one schema and are joined by union.  A coverage filter keeps only events
whose source pages the other run had reached.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .memory import of_project

# The change types in their order of output.
CHANGE_TYPES = (
    "NEW_ENTITY", "ENTITY_DISAPPEARED", "PRICE_DROP", "PRICE_INCREASE", "SELLER_CHANGED", "DESCRIPTION_CHANGED", "IMAGE_CHANGED", "SOURCE_CHANGED",
    "DOMAIN_FAILED", "DOMAIN_RECOVERED", "FEED_APPEARED", "FEED_DISAPPEARED", "FEED_NEW_ENTRIES", "FEED_FAILED", "FEED_RECOVERED",
)
MIN_CONFIDENCE = 0.70
FIELDS = (("seller", "SELLER_CHANGED"), ("description", "DESCRIPTION_CHANGED"), ("image_url", "IMAGE_CHANGED"))


def visit_state(outcome: Column, status: Column) -> Column:
    """reachable, failed or ignored; any HTTP status below 500 counts as reachable."""
    return (
        F.when(outcome.isin("html_ok", "non_html"), "reachable")
        .when((outcome == "http_status") & status.isNotNull(), F.when(status >= 500, "failed").otherwise("reachable"))
        .when(outcome.startswith("http_error:"), "failed").otherwise("ignored"))


def domain_states(visits: DataFrame, project_id: str, run_id: int) -> DataFrame:
    """State of each visited domain of a run; one reachable visit suffices."""
    state = visit_state(F.col("outcome"), F.col("http_status"))
    rows = of_project(visits, project_id).where((F.col("run_id") == run_id) & (F.coalesce("domain", F.lit("")) != ""))
    return rows.groupBy("domain").agg(
        F.when(F.bool_or(state == "reachable"), "reachable").when(F.bool_or(state == "failed"), "failed").otherwise("unknown").alias("state"),
        F.count("*").alias("visits"))


def reachable_urls(visits: DataFrame, project_id: str, run_id: int) -> DataFrame:
    """URLs, requested or final, that a run reached."""
    rows = of_project(visits, project_id).where((F.col("run_id") == run_id) & (F.coalesce("domain", F.lit("")) != "") & (visit_state(F.col("outcome"), F.col("http_status")) == "reachable"))
    return rows.select(F.explode(F.array("url", "final_url")).alias("source_url")).where("source_url <> ''").distinct()


def entity_snapshot(observations: DataFrame, members: DataFrame, project_id: str, run_id: int) -> DataFrame:
    """Last observation of each entity in a run, under today's clusters."""
    rows = of_project(observations, project_id).where(F.col("run_id") == run_id).drop("project_id", "run_id")
    last = rows.groupBy("entity_key").agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns if c != "entity_key"]), "id").alias("o"), F.min("id").alias("first_id"))
    joined = last.select("entity_key", "o.*", "first_id").join(of_project(members, project_id).select("entity_key", F.col("cluster_key").alias("_cluster")), "entity_key", "left")
    return joined.withColumn("cluster_key", F.coalesce("_cluster", "entity_key")).drop("_cluster")


def cluster_snapshot(entities: DataFrame) -> DataFrame:
    """One row a cluster: title of the entity first seen with one, and its sources."""
    return entities.groupBy("cluster_key").agg(
        F.coalesce(F.min_by(F.when(F.col("title") != "", F.col("title")), F.when(F.col("title") != "", F.col("first_id"))), F.lit("")).alias("title"),
        F.array_sort(F.collect_set(F.struct("source_domain", "source_url"))).alias("sources"))


_EVENT = ("change_type", "cluster_key", "entity_key", "title", "source_url", "source_domain", "before", "after")


def _event(df: DataFrame, kind: str | Column, cluster: Column | None = None, entity: Column | None = None, title: Column | None = None, url: Column | None = None, domain: Column | None = None, before: Column | None = None, after: Column | None = None, added: Column | None = None, removed: Column | None = None) -> DataFrame:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")
    urls = lambda c: F.array_distinct(F.filter(F.transform(c, lambda s: s["source_url"]), lambda u: u != "")) if c is not None else F.array().cast("array<string>")
    change = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(change.alias("change_type"), *[text(c).alias(n) for n, c in zip(_EVENT[1:], (cluster, entity, title, url, domain, before, after))], urls(added).alias("added_urls"), urls(removed).alias("removed_urls"))


def _text(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def entity_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """New, vanished, re-sourced and re-priced entities, and changed fields."""
    b, a = cluster_snapshot(old).alias("b"), cluster_snapshot(new).alias("a")
    both = b.join(a, F.col("b.cluster_key") == F.col("a.cluster_key"), "full_outer").select(
        F.coalesce("b.cluster_key", "a.cluster_key").alias("cluster_key"), F.col("b.cluster_key").isNotNull().alias("had"), F.col("a.cluster_key").isNotNull().alias("has"),
        F.col("b.title").alias("old_title"), F.col("a.title").alias("new_title"), F.col("b.sources").alias("old"), F.col("a.sources").alias("new"))
    kind = F.when(~F.col("had"), "NEW_ENTITY").when(~F.col("has"), "ENTITY_DISAPPEARED").when(F.col("old") != F.col("new"), "SOURCE_CHANGED")
    sources = F.col("old"), F.col("new")
    first = F.coalesce(F.col("new"), F.col("old"))
    clusters = _event(
        both.where(kind.isNotNull()), kind, F.col("cluster_key"), None, F.coalesce(F.nullif("new_title", F.lit("")), "old_title"), F.when(kind != "SOURCE_CHANGED", first[0]["source_url"]), F.when(kind != "SOURCE_CHANGED", first[0]["source_domain"]),
        F.to_json(F.when(kind != "NEW_ENTITY", sources[0])), F.to_json(F.when(kind != "ENTITY_DISAPPEARED", sources[1])),
        F.when(F.col("had") & F.col("has"), F.array_except(*sources[::-1])).otherwise(F.when(~F.col("had"), sources[1])), F.when(F.col("had") & F.col("has"), F.array_except(*sources)).otherwise(F.when(~F.col("has"), sources[0])))
    pair = old.select([F.col(c).alias(f"o_{c}") for c in old.columns]).join(new, F.col("o_entity_key") == F.col("entity_key"))
    shared = (F.col("cluster_key"), F.col("entity_key"), F.coalesce(F.nullif("title", F.lit("")), "o_title"), F.col("source_url"), F.col("source_domain"))
    priced = pair.where((F.coalesce("o_currency", F.lit("")) != "") & (F.col("o_currency") == F.col("currency")) & (F.col("o_price") != F.col("price")))
    events = [clusters, _event(priced, F.when(F.col("price") < F.col("o_price"), "PRICE_DROP").otherwise("PRICE_INCREASE"), *shared, F.col("o_price"), F.col("price"))]
    for field, change in FIELDS:
        if field not in new.columns or f"{field}_fact" not in new.columns:
            continue
        supported = lambda p: (_text(F.col(f"{p}{field}")) == _text(F.col(f"{p}{field}_fact"))) & (F.col(f"{p}{field}_confidence") >= MIN_CONFIDENCE)
        changed = pair.where(supported("o_") & supported("") & (_text(F.col(f"o_{field}")) != _text(F.col(field))))
        events.append(_event(changed, change, *shared, F.col(f"o_{field}"), F.col(field)))
    return reduce(DataFrame.unionByName, events)


def domain_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """Domains of both runs that went from reachable to failed or back."""
    both = before.select("domain", F.col("state").alias("old")).join(after.select("domain", F.col("state").alias("new")), "domain")
    kind = F.when((F.col("old") == "reachable") & (F.col("new") == "failed"), "DOMAIN_FAILED").when((F.col("old") == "failed") & (F.col("new") == "reachable"), "DOMAIN_RECOVERED")
    return _event(both.where(kind.isNotNull()), kind, F.concat(F.lit("domain:"), F.col("domain")), None, F.col("domain"), None, F.col("domain"), F.col("old"), F.col("new"))


def feed_events(before: DataFrame, after: DataFrame, reached: DataFrame) -> DataFrame:
    """Feeds that came, went (only where their domain was reached), failed, recovered or grew."""
    side = lambda df, p: df.select("feed_url", *[F.col(c).alias(f"{p}_{c}") for c in ("domain", "status", "new_entries")])
    up = reached.where(F.col("state") == "reachable").select(F.col("domain").alias("old_domain"), F.lit(True).alias("up"))
    both = side(before, "old").join(side(after, "new"), "feed_url", "full_outer").join(up, "old_domain", "left")
    had, has = F.col("old_status").isNotNull(), F.col("new_status").isNotNull()
    was, now = F.col("old_status"), F.col("new_status")
    kinds = F.array_compact(F.array(
        F.when(~had, "FEED_APPEARED"), F.when(~has & F.col("up"), "FEED_DISAPPEARED"), F.when((was == "active") & (now == "error"), "FEED_FAILED"), F.when((was == "error") & (now == "active"), "FEED_RECOVERED"),
        F.when((now == "active") & (F.col("new_new_entries") > F.col("old_new_entries")), "FEED_NEW_ENTRIES")))
    rows = both.withColumn("kind", F.explode(kinds))
    grown = F.col("kind") == "FEED_NEW_ENTRIES"
    value = lambda p: F.when(grown, F.col(f"{p}_new_entries").cast("string")).otherwise(F.col(f"{p}_status"))
    domain = F.coalesce("new_domain", "old_domain")
    return _event(rows, F.col("kind"), F.concat(F.lit("feed:"), F.col("feed_url")), None, F.col("feed_url"), F.col("feed_url"), domain, value("old"), value("new"))


def compare_runs(tables: dict[str, DataFrame], project_id: str, before: int, after: int) -> DataFrame:
    """All change events from run ``before`` to run ``after``; equal runs are refused."""
    if before == after:
        raise ValueError("a run cannot be compared with itself")
    # Each snapshot feeds five branches; it is written once instead of being made again for each.
    snap = lambda r: checkpointed(entity_snapshot(tables["observations"], tables["entity_cluster_members"], project_id, r))
    states = [checkpointed(domain_states(tables["page_visits"], project_id, r)) for r in (before, after)]
    feeds = [of_project(tables["feed_snapshots"], project_id).where(F.col("run_id") == r) for r in (before, after)]
    return entity_events(snap(before), snap(after)).unionByName(domain_events(*states)).unionByName(feed_events(*feeds, states[1]))


def coverage(events: DataFrame, visits: DataFrame, project_id: str, before: int, after: int) -> DataFrame:
    """Events with ``suppressed`` (null if kept), by whether the other run reached their source pages.

    Whether all of an event's URLs were reached is a count over its exploded
    URLs; reached URLs are never collected.
    """
    judged = events.where(F.col("change_type").isin("NEW_ENTITY", "ENTITY_DISAPPEARED", "SOURCE_CHANGED"))
    reach = {side: reachable_urls(visits, project_id, run).withColumn("reached", F.lit(True)) for side, run in (("added", before), ("removed", after))}
    sides = []
    for side, urls in reach.items():
        one = judged.select("change_type", "cluster_key", F.explode(f"{side}_urls").alias("source_url")).join(urls, "source_url", "left")
        sides.append(one.groupBy("change_type", "cluster_key").agg(F.count("*").alias(f"{side}_n"), F.count("reached").alias(f"{side}_reached")))
    rows = events
    for one in sides:
        rows = rows.join(one, ["change_type", "cluster_key"], "left")
    whole = lambda side: F.coalesce((F.col(f"{side}_n") > 0) & (F.col(f"{side}_n") == F.col(f"{side}_reached")), F.lit(False))
    kind = F.col("change_type")
    reason = (
        F.when((kind == "NEW_ENTITY") & ~whole("added"), "source_url_not_rechecked_in_before_run")
        .when((kind == "ENTITY_DISAPPEARED") & ~whole("removed"), "source_url_not_rechecked_in_after_run")
        .when((kind == "SOURCE_CHANGED") & ~(whole("added") & whole("removed")), "source_set_not_comparably_rechecked"))
    return rows.withColumn("suppressed", reason).drop("added_n", "added_reached", "removed_n", "removed_reached")


def change_counts(events: DataFrame) -> DataFrame:
    """Events of each type, types without any included, in order of output."""
    types = events.sparkSession.createDataFrame([(i, t) for i, t in enumerate(CHANGE_TYPES)], "position int, change_type string")
    return types.join(events.groupBy("change_type").agg(F.count("*").alias("n")), "change_type", "left").select("position", "change_type", F.coalesce("n", F.lit(0)).alias("n"))


def ordered(events: DataFrame) -> DataFrame:
    """Events in order of type, cluster, entity and source."""
    place = F.array_position(F.array(*[F.lit(t) for t in CHANGE_TYPES]), F.col("change_type"))
    return events.orderBy(place, "cluster_key", "entity_key", "source_url")


def previous_finished_run(runs: DataFrame, project_id: str) -> DataFrame:
    """For each run, the finished run before it (null for the first)."""
    rows = of_project(runs, project_id)
    before = Window.partitionBy("project_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(F.col("id").alias("run_id"), F.max(F.when(F.col("finished_at").isNotNull(), F.col("id"))).over(before).alias("previous_run_id"))
