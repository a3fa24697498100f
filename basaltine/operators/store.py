"""Keyed tables: merges of new rows into stored ones, appends, run lifecycle."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _any(names: Iterable[str]) -> Column:
    """Whether one of some columns, of any types, is not null."""
    return reduce(or_, [F.col(n).isNotNull() for n in names])


def merge(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Old and new rows as one table, one row a key.

    Columns follow a rule: new (the default), old (first value stays), greatest,
    add, coalesce (new unless null), filled (old unless empty), known (new unless 'unknown').
    """
    o = old.select([F.col(c).alias(f"o_{c}") for c in old.columns])
    both = o.join(new, [F.col(f"o_{k}").eqNullSafe(F.col(k)) for k in keys], "full_outer").withColumns({"_had": _any(f"o_{k}" for k in keys), "_has": _any(keys)})

    def pick(name: str) -> Column:
        was, now = F.col(f"o_{name}"), F.col(name)
        both_ = {
            "new": now, "old": was, "greatest": F.greatest(was, now), "add": F.coalesce(was, F.lit(0)) + F.coalesce(now, F.lit(0)), "coalesce": F.coalesce(now, was),
            "filled": F.coalesce(F.nullif(was, F.lit("")), now), "known": F.when(F.coalesce(now, F.lit("unknown")) == "unknown", was).otherwise(now), "status": domain_status(was, now),
        }[rules.get(name, "new")] if name not in keys else F.coalesce(now, was)
        return F.when(F.col("_had") & F.col("_has"), both_).when(F.col("_has"), now).otherwise(was).alias(name)

    return both.select(*[pick(c) for c in old.columns])


def domain_status(was: Column, now: Column) -> Column:
    """Blocked stays; rejected gives way to active only; active does not fall back to candidate."""
    return F.when(was == "blocked", was).when((was == "rejected") & (now != "active"), was).when((was == "active") & (now == "candidate"), was).otherwise(now)


DOMAIN_RULES = {"status": "status", "discovered_from_url": "filled", "relevance_score": "greatest", "robots_status": "known", "sitemap_status": "known", "sitemap_urls_found": "greatest", "pages_seen": "add", "entities_found": "add", "first_seen": "old", "last_crawled": "coalesce"}
ENTITY_RULES = {"first_seen": "old"}


def save_domains(old: DataFrame, new: DataFrame) -> DataFrame:
    """Domain registry with this run's counts added; a seed stays a seed."""
    merged = merge(old, new, ["project_id", "domain"], DOMAIN_RULES)
    if "discovered_via" not in old.columns:
        return merged
    seeds = old.where("discovered_via = 'seed'").select("project_id", "domain", F.lit(True).alias("_seed"))
    return merged.join(seeds, ["project_id", "domain"], "left").withColumn("discovered_via", F.when(F.col("_seed"), "seed").otherwise(F.col("discovered_via"))).select(*old.columns)


def upsert_entities(old: DataFrame, found: DataFrame, project_id: str, run_id: int, at: datetime) -> tuple[DataFrame, DataFrame]:
    """Entities after a run, and its observations.

    ``found`` holds entity columns, a stable_key and an arrival number.  An item
    takes the key of the stored entity with its address and title, else the
    stable key of the first item of the run with both; first_seen stays, of
    several finds of one entity the last is kept, and each is an observation.
    """
    kept = old.where(F.col("project_id") == project_id).groupBy("source_url", "title").agg(F.min("entity_key").alias("_known"))
    first = found.groupBy("source_url", "title").agg(F.min_by("stable_key", "arrival").alias("_first"))
    keys = first.join(kept, ["source_url", "title"], "left").select("source_url", "title", F.coalesce("_known", "_first").alias("entity_key"))
    stamp = F.lit(at).cast("timestamp")
    keyed = found.drop("entity_key").join(keys, ["source_url", "title"]).withColumns({"project_id": F.lit(project_id), "first_seen": stamp, "last_seen": stamp})
    last = keyed.groupBy("project_id", "entity_key").agg(F.max_by(F.struct(*[c for c in old.columns if c not in ("project_id", "entity_key")]), "arrival").alias("e")).select("project_id", "entity_key", "e.*")
    observations = keyed.select("project_id", F.lit(run_id).cast("long").alias("run_id"), "entity_key", stamp.alias("observed_at"), F.col("last_price").alias("price"), "currency", "arrival")
    return merge(old, last.select(*old.columns), ["project_id", "entity_key"], ENTITY_RULES), observations


def save_feeds(feeds: DataFrame, snapshots: DataFrame, states: DataFrame, run_id: int, at: datetime) -> tuple[DataFrame, DataFrame]:
    """Feeds and feed snapshots after a run: one row a feed with its first_seen kept, one row a run and feed."""
    stamp, run = F.lit(at).cast("timestamp"), F.lit(run_id).cast("long")
    now = states.withColumns({"first_seen": stamp, "last_seen": stamp, "run_id": run, "observed_at": stamp})
    return merge(feeds, now.select(*feeds.columns), ["project_id", "feed_url"], {"first_seen": "old"}), merge(snapshots, now.select(*snapshots.columns), ["project_id", "run_id", "feed_url"], {})


def numbered(rows: DataFrame, run: str, arrival: str) -> DataFrame:
    """Rows of each run numbered from 1 in order of arrival."""
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy(run).orderBy(arrival)))


def append(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ("project_id", "run_id")) -> None:
    """Add rows to a log, one folder for each project and run."""
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def run_view(started: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs with what they finished with, null while they run."""
    return started.join(finished.drop("project_id"), "id", "left")


def copy_database(source: str, target: str, spark, tables: tuple[str, ...], force: bool = False) -> None:
    """Copy tables to another folder, which must be new unless forced."""
    for name in tables:
        spark.read.parquet(f"{source}/{name}").write.mode("overwrite" if force else "errorifexists").parquet(f"{target}/{name}")
