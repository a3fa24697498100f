"""Domain registry decisions: what to do with a link, a search result or a feed entry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import DOMAIN_REASONS, host_key, safety


@dataclass(frozen=True)
class Policy:
    mode: str = "discovery"
    threshold: float = 0.3
    depth: int = 4
    max_domains: int = 20
    kind: str = "link"


#: Reasons by kind of candidate: too low a score, and activated.
BELOW = {"link": "below_threshold", "search": "below_search_threshold", "feed": "below_threshold"}
REACHED = {"link": "relevance_threshold", "search": "search_relevance_threshold", "feed": "feed_relevance_threshold"}


def decide(candidates: DataFrame, domains: DataFrame, policy: Policy, active: int = 0, held: DataFrame | None = None) -> DataFrame:
    """Action, reason and domain status of each candidate (url, score 0..1, depth, place).

    ``domains``: domain, status and, where kept, reason; ``held``: domains that
    have a slot of this run already, ``active`` of them.  A slot goes to the
    domains that ask for one in the order of their first asking: persisted
    active ones at any score, new ones once a candidate passes the threshold.
    From then on all candidates of a domain are known, whatever their score.
    The slots are a top-k of claims, so no window spans all domains.
    """
    kept = domains.select("domain", "status", (F.nullif("reason", F.lit("")) if "reason" in domains.columns else F.lit(None).cast("string")).alias("kept_reason"))
    slots = candidates.sparkSession.createDataFrame([], "domain string") if held is None else held.select("domain").distinct()
    rows = candidates.withColumns({"domain": host_key(F.col("url")), "unsafe": safety(F.col("url"))}).join(kept, "domain", "left").join(slots.withColumn("held", F.lit(True)), "domain", "left")
    fixed = lambda action, reason: F.struct(F.lit(action).alias("action"), reason.alias("reason"))
    persisted = (
        F.when(F.col("unsafe") != "ok", fixed("blocked", F.col("unsafe")))
        .when(F.col("status") == "blocked", fixed("blocked", F.coalesce("kept_reason", F.lit("persisted_blocked"))))
        .when(F.col("status") == "rejected", fixed("recorded", F.coalesce("kept_reason", F.lit("persisted_rejected"))))
        .when(F.col("held") & (F.col("status") == "candidate") & (F.col("kept_reason") == "nonproductive_source"), fixed("recorded", F.col("kept_reason"))))
    refused = (
        F.when(F.lit(policy.mode == "domain" and policy.kind != "search"), F.lit("domain_mode"))
        .when(F.lit(policy.kind == "search" and policy.mode != "expedition"), "not_expedition_mode")
        .when(F.col("score") < policy.threshold, BELOW[policy.kind])
        .when(F.lit(policy.kind != "search") & (F.col("depth") > policy.depth), "depth_limit"))
    rows = rows.withColumns({"persisted": persisted, "refused": refused, "was_active": F.coalesce(F.col("status") == "active", F.lit(False))})
    claims = rows.where("persisted IS NULL AND held IS NULL AND (was_active OR refused IS NULL)").groupBy("domain").agg(F.min("place").alias("first"))
    taken = claims.orderBy("first").limit(max(0, policy.max_domains - active))
    out = rows.join(taken, "domain", "left")
    known = F.coalesce(F.col("held") & F.col("was_active"), F.lit(False)) | F.coalesce(F.col("was_active") & F.col("first").isNotNull(), F.lit(False)) | F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    verdict = F.coalesce("persisted", F.when(known, fixed("known", F.lit("already_active")))
        .when(F.col("was_active"), fixed("recorded", F.lit("domain_budget_reached")))
        .when(F.col("place") == F.col("first"), fixed("activated", F.lit(REACHED[policy.kind])))
        .when(F.col("refused").isNotNull(), fixed("recorded", F.col("refused")))
        .when(F.col("held"), fixed("activated", F.lit(REACHED[policy.kind])))
        .otherwise(fixed("recorded", F.lit("domain_budget_reached"))))
    status = F.when(F.col("unsafe").isin(*DOMAIN_REASONS), "blocked").when(verdict["action"].isin("activated", "known"), "active").otherwise(F.coalesce("status", F.lit("candidate")))
    return out.select(*candidates.columns, "domain", verdict["action"].alias("action"), verdict["reason"].alias("reason"), status.alias("domain_status"))


def outcome(status: Column, content_type: Column, error: Column, allowed: Column, safe: Column) -> Column:
    """What became of a visit: robots, error, redirect, status, content."""
    return (
        F.when(~F.coalesce(allowed, F.lit(True)), "robots_blocked").when(error.isNotNull(), F.concat(F.lit("http_error:"), error)).when(~F.coalesce(safe, F.lit(True)), "unsafe_redirect")
        .when(status != 200, "http_status").when(~F.contains(F.lower(F.coalesce(content_type, F.lit("text/html"))), F.lit("html")), "non_html").otherwise("html_ok"))


def priority(kind: Column, score: Column, ratio: Column, internal: Column, promising: Column, penalty: Column) -> Column:
    """Place of a page in the frontier by where it came from."""
    link = 20 + score + F.when(internal, 15).otherwise(0) + F.when(promising, 101).otherwise(0) - penalty
    return (
        F.when(kind == "seed", F.lit(100)).when(kind == "search", 80 + score).when(kind == "bootstrap", 70 + F.greatest(score, F.lit(0))).when(kind == "backfill", 75 + score)
        .when(kind == "probe", 65 + score).when(kind == "feed", 55 + score).when(kind == "deferred", 55 + F.bround(ratio * 100).cast("int")).when(kind == "sitemap", 30 + score).otherwise(link))


def robots_allowed(visits: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether the first matching line of a host's rules lets a path be fetched; no rules let all.

    ``rules``: host, line_no, path, allow.
    """
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("/"))
    rows = visits.select("url").distinct().withColumns({"host": host_key(F.col("url")), "target": path})
    hits = rows.join(rules.where("path <> ''"), "host").where(F.startswith("target", "path"))
    first = hits.groupBy("url").agg(F.min_by("allow", "line_no").alias("allow"))
    return visits.join(first, "url", "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")


def politeness(delay: float, floor: float, cap: float, pressured: list[bool]) -> float:
    """Delay of a host after a series of answers: doubled under pressure, halved by success."""
    for bad in pressured:
        delay = min(cap, max(floor, delay * 2)) if bad else max(floor, delay / 2)
    return delay
