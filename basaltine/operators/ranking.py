"""Ranking of search hits by corpus-local BM25, field matches and source history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.urls import host_key

K1, B = 1.5, 0.75


def bm25(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """bm25 of every hit for the terms of its query; the corpus is the query's own hits.

    ``hits``: query, url, title, snippet, provider_index; ``terms``: query, term
    (distinct).  Only tokens that are query terms go on after the scan.
    """
    path = lambda u: F.coalesce(F.try_url_decode(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit(""))), F.lit(""))
    host = lambda u: F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit(""))
    docs = hits.select("query", "provider_index", "url", tokens(F.concat_ws(" ", "title", "snippet", path(F.col("url")), host(F.col("url")))).alias("words"))
    each = Window.partitionBy("query")
    docs = docs.withColumn("length", F.size("words")).withColumns({"n": F.count("*").over(each), "total": F.sum("length").over(each)})
    found = docs.withColumn("term", F.explode("words")).join(terms, ["query", "term"]).groupBy("query", "provider_index", "term", "length", "n", "total").agg(F.count("*").alias("tf"))
    found = found.withColumn("df", F.count("*").over(Window.partitionBy("query", "term")))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") * F.col("n") / F.col("total"))
    scores = found.groupBy("query", "provider_index").agg(F.sum(idf * F.col("tf") * (K1 + 1) / norm).alias("bm25"), F.count("*").alias("matched_terms"))
    return hits.select("query", "provider_index", "url").join(scores, ["query", "provider_index"], "left").withColumns({"bm25": F.coalesce("bm25", F.lit(0.0)), "matched_terms": F.coalesce("matched_terms", F.lit(0))})


def memory_state() -> Column:
    """Band of a source by its record: blocked, productive (fresh or stale), nonproductive, untested."""
    return (
        F.when(F.col("status").isNull(), "untested").when(F.col("status").isin("blocked", "rejected"), F.col("status"))
        .when(F.col("productive_runs") > 0, F.when(F.col("is_stale"), "productive_stale").otherwise("productive_fresh"))
        .when(F.col("crawl_runs") > 0, "nonproductive").otherwise("untested"))


def _words(phrases: list[str]) -> list[str]:
    return sorted({t for p in phrases for t in "".join(c if c.isalnum() else " " for c in p.casefold()).split()})


def match_counts(hits: DataFrame, terms: DataFrame, target: list[str] = (), anchors: list[str] = (), negative: list[str] = ()) -> DataFrame:
    """How many terms of its query stand in a hit's title, path and host, and how many of the target's, its anchors' and of negative phrases anywhere.

    Target words count only where anchors are given too.  A query's terms are
    one short array, so each hit is read once.
    """
    part = lambda name: F.coalesce(F.try_parse_url("url", F.lit(name)), F.lit(""))
    asked = terms.groupBy("query").agg(F.collect_set("term").alias("asked"))
    rows = hits.join(asked, "query", "left").withColumns({
        "asked": F.coalesce("asked", F.array().cast("array<string>")), "title_": F.lower(F.coalesce("title", F.lit(""))), "snippet_": F.lower(F.coalesce("snippet", F.lit(""))),
        "path_": F.lower(F.coalesce(F.try_url_decode(part("PATH")), F.lit(""))), "host_": F.lower(part("HOST"))})
    hay = F.concat_ws(" ", "title_", "snippet_", "path_", "host_")
    everywhere = F.array_distinct(tokens(hay))
    need, fixed = _words(list(target)), _words(list(anchors))
    if not need or not fixed:
        need, fixed = [], []
    common = lambda words, have: F.size(F.array_intersect(words, have))
    listed = lambda words: F.array(*[F.lit(w) for w in words]).cast("array<string>")
    bad = sum((F.contains(hay, F.lit(w)).cast("int") for w in (n.casefold() for n in negative) if w.strip()), F.lit(0))
    out = rows.select("query", "provider_index", "url", host_key(F.col("url")).alias("domain"), common(F.col("asked"), tokens(F.col("title_"))).alias("title_matches"), common(F.col("asked"), tokens(F.col("path_"))).alias("path_matches"),
                      common(F.col("asked"), tokens(F.col("host_"))).alias("domain_matches"), common(listed(need), everywhere).alias("target_matches"), common(listed(fixed), everywhere).alias("anchor_matches"), bad.alias("negative_matches"))
    label = F.concat_ws(" ", *[F.concat(F.lit(f"{name}="), F.col(column).cast("string")) for name, column in (("title", "title_matches"), ("path", "path_matches"), ("domain", "domain_matches"), ("target", "target_matches"), ("anchor", "anchor_matches"), ("negative", "negative_matches"))])
    return out.withColumn("audit", label)


def rank_hits(hits: DataFrame, terms: DataFrame, profiles: DataFrame, negative: list[str] = (), target: list[str] = (), anchors: list[str] = ()) -> DataFrame:
    """Hits of each query by twelve keys: anchor and target matches, source band and rates, negative phrases, relevance, field matches, provider order."""
    scored = bm25(hits, terms).drop("url").join(match_counts(hits, terms, target, anchors, negative), ["query", "provider_index"])
    known = profiles.select("domain", "status", "productive_runs", "crawl_runs", "is_stale", "productive_run_rate", "entity_yield", "success_rate")
    rows = scored.join(known, "domain", "left").withColumn("state", memory_state())
    bands = F.array(*[F.lit(s) for s in ("productive_fresh", "untested", "productive_stale", "nonproductive", "blocked")])
    order = F.array_position(bands, F.when(F.col("state") == "rejected", "blocked").otherwise(F.col("state")))
    rate = lambda c: F.desc(F.when(F.col("state").startswith("productive"), F.coalesce(c, F.lit(0.0))).otherwise(0.0))
    within = Window.partitionBy("query").orderBy(
        F.desc("anchor_matches"), F.desc("target_matches"), order, rate("productive_run_rate"), rate("entity_yield"), rate("success_rate"),
        F.col("negative_matches") > 0, F.desc(F.round("bm25", 9)), F.desc("title_matches"), F.desc("path_matches"), F.desc("domain_matches"), "provider_index")
    return rows.select("query", "provider_index", "url", "domain", "state", (F.col("negative_matches") > 0).alias("negative"), "bm25", "title_matches", "path_matches", "domain_matches", "target_matches", "anchor_matches", "negative_matches",
                       F.concat(F.format_string("bm25=%.3f ", "bm25"), "audit").alias("audit"), F.row_number().over(within).alias("rank"))


def candidate_pool(ranked: DataFrame) -> DataFrame:
    """Best place of each URL over all queries, and how often it came up."""
    return ranked.groupBy("url").agg(F.min_by(F.struct("rank", "query"), F.struct("rank", "query")).alias("best"), F.count("*").alias("seen")).select("url", F.col("best.rank").alias("rank"), F.col("best.query").alias("query"), "seen")


def fallback_enrichment(items: DataFrame, text: Column, keywords: list[str], negative: list[str], least_score: float = 0.5) -> DataFrame:
    """Deterministic relevance of a text from keyword hits."""
    hay = F.lower(F.coalesce(text, F.lit("")))
    hits = lambda words: sum((F.when(F.contains(hay, F.lit(w.strip().lower())), 1).otherwise(0) for w in words if w.strip()), F.lit(0))
    good, bad = hits(keywords), hits(negative)
    rows = items.withColumns({"positive_hits": good, "negative_hits": bad})
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.18) + F.col("positive_hits") * 0.10 - F.col("negative_hits") * 0.22))
    return rows.withColumns({"relevance_score": score, "confidence": F.least(F.lit(0.35) + F.col("positive_hits") * 0.08, F.lit(0.85))}).withColumn("is_relevant", F.col("relevance_score") >= least_score)


def wave(frontier: DataFrame, visited: DataFrame, size: int, per_host: int) -> DataFrame:
    """The next pages to fetch: best first, a bounded number for each host.

    ``frontier``: url, host, priority, place; ``visited``: host, pages so far.
    """
    open_ = frontier.where("host <> ''").join(visited, "host", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("priority"), "place"))
    return open_.withColumn("turn", place).where(F.col("turn") + F.col("pages") <= per_host).orderBy(F.desc("priority"), "place").limit(size).select("url", "host", "priority", "place")


def streaks(pages: DataFrame, window: int) -> DataFrame:
    """First page of each run at which ``window`` pages in a row found nothing new."""
    order = Window.partitionBy("run_id").orderBy("page_no")
    island = F.sum(F.when(F.col("found") > 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = pages.withColumn("island", island)
    length = F.sum(F.when(F.col("found") > 0, 0).otherwise(1)).over(Window.partitionBy("run_id", "island").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("streak", length).groupBy("run_id").agg(F.max("streak").alias("longest_streak"), F.min(F.when(F.col("streak") >= window, F.col("page_no"))).alias("stop_page"))
