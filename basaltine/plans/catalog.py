"""Registered queries of the engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import changes, evidence, lineage, memory, ranking, registry, resolution, store
from ..sources import web
from .views import PROJECT, table, with_views

AS_OF = datetime(2024, 2, 20, tzinfo=timezone.utc)
BEFORE, AFTER = 4, 5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


@query("""
SELECT coalesce(provider, '') AS provider, query_text, count(*) AS result_events, count(DISTINCT target_domain) AS unique_domains,
  count(*) FILTER (action = 'activated') AS activated, count(*) FILTER (action = 'known') AS known,
  count(*) FILTER (action = 'blocked') AS blocked, count(*) FILTER (action = 'recorded') AS recorded,
  count(DISTINCT run_id) AS runs, max(discovered_at) AS last_used,
  count(DISTINCT target_domain) FILTER (action IN ('activated', 'known')) AS productive_domains,
  count(DISTINCT target_domain) FILTER (action = 'blocked') AS blocked_domains,
  count(*) FILTER (action = 'activated') / count(*) AS activation_rate,
  count(DISTINCT target_domain) FILTER (action IN ('activated', 'known')) / count(DISTINCT target_domain) AS productive_domain_rate
FROM domain_discoveries WHERE coalesce(query_text, '') <> '' GROUP BY provider, query_text
ORDER BY productive_domains DESC, activated DESC, unique_domains DESC, result_events DESC, query_text, provider LIMIT 20""", "domain_discoveries")
def query_memory(spark: SparkSession, sf: str) -> DataFrame:
    return memory.query_memory(table(spark, sf, "domain_discoveries"), PROJECT)


_DUPLICATION = """greatest(0, {raw} - {unique} - {dup})::BIGINT AS filtered_results, CASE WHEN {raw} > 0 THEN {dup} / {raw} ELSE 0.0 END AS duplicate_rate"""


@query(f"""
SELECT *, {_DUPLICATION.format(raw='raw_results', unique='unique_results', dup='duplicates')} FROM (
  SELECT count(*) AS runs, coalesce(sum(search_queries_issued), 0)::BIGINT AS queries, coalesce(sum(search_results_seen), 0)::BIGINT AS raw_results,
    coalesce(sum(search_results_unique), 0)::BIGINT AS unique_results, coalesce(sum(search_results_duplicates), 0)::BIGINT AS duplicates,
    coalesce(sum(search_provider_errors), 0)::BIGINT AS provider_errors
  FROM runs WHERE search_queries_issued > 0 OR search_results_seen > 0 OR search_provider_errors > 0)""", "runs")
def search_duplication_memory(spark: SparkSession, sf: str) -> DataFrame:
    return memory.search_duplication(table(spark, sf, "runs"), PROJECT)


@query(f"""
SELECT id AS run_id, started_at, finished_at, search_queries_issued AS queries, search_results_seen AS raw_results, search_results_unique AS unique_results,
  search_results_duplicates AS duplicates, search_provider_errors AS provider_errors,
  {_DUPLICATION.format(raw='search_results_seen', unique='search_results_unique', dup='search_results_duplicates')}
FROM runs WHERE search_queries_issued > 0 OR search_results_seen > 0 OR search_provider_errors > 0 ORDER BY id DESC LIMIT 20""", "runs")
def recent_search_runs(spark: SparkSession, sf: str) -> DataFrame:
    return memory.recent_search_runs(table(spark, sf, "runs"), PROJECT)


_PROFILES = ("domains", "page_visits", "feeds", "domain_discoveries", "observations", "entities")
_AGE = "greatest(0.0, (epoch_us(TIMESTAMP '2024-02-20 00:00:00') - epoch_us({})) / 86400e6)"


@query(f"""
SELECT d.* EXCLUDE (project_id), coalesce(visit_count, 0) AS visit_count, coalesce(crawl_runs, 0) AS crawl_runs, coalesce(successful_visits, 0) AS successful_visits,
  coalesce(failed_visits, 0) AS failed_visits, last_visit, coalesce(feed_count, 0) AS feed_count, last_feed_success,
  coalesce(discovery_events, 0) AS discovery_events, coalesce(activated_events, 0) AS activated_events, coalesce(blocked_events, 0) AS blocked_events, last_discovered,
  coalesce(observation_count, 0) AS observation_count, coalesce(productive_runs, 0) AS productive_runs, last_useful_at,
  CASE WHEN pages_seen > 0 THEN entities_found / pages_seen ELSE 0.0 END AS entity_yield,
  CASE WHEN visit_count > 0 THEN successful_visits / visit_count ELSE 0.0 END AS success_rate,
  CASE WHEN crawl_runs > 0 THEN coalesce(productive_runs, 0) / crawl_runs ELSE 0.0 END AS productive_run_rate,
  CASE WHEN last_useful_at IS NOT NULL THEN {_AGE.format('last_useful_at')} END AS age_since_last_useful_days,
  CASE WHEN last_crawled IS NOT NULL THEN {_AGE.format('last_crawled')} END AS age_since_last_crawl_days,
  CASE WHEN last_feed_success IS NOT NULL THEN {_AGE.format('last_feed_success')} END AS age_since_last_feed_success_days,
  CASE WHEN last_useful_at IS NOT NULL THEN 'last_useful_at' WHEN last_crawled IS NOT NULL THEN 'last_crawled' ELSE 'last_seen' END AS stale_reference,
  {_AGE.format('coalesce(last_useful_at, last_crawled, last_seen)')} AS stale_age_days,
  {_AGE.format('coalesce(last_useful_at, last_crawled, last_seen)')} > 30 AS is_stale,
  CASE WHEN {_AGE.format('coalesce(last_useful_at, last_crawled, last_seen)')} > 30 THEN 'stale' ELSE 'fresh' END AS freshness
FROM domains d
LEFT JOIN (SELECT domain, count(*) AS visit_count, count(DISTINCT run_id) AS crawl_runs, count(*) FILTER (outcome = 'html_ok') AS successful_visits,
    count(*) FILTER (starts_with(lower(outcome), 'http_error:') OR outcome IN ('unsafe_redirect', 'http_status')) AS failed_visits, max(visited_at) AS last_visit
  FROM page_visits GROUP BY domain) v USING (domain)
LEFT JOIN (SELECT domain, count(*) AS feed_count, max(last_success) AS last_feed_success FROM feeds GROUP BY domain) f USING (domain)
LEFT JOIN (SELECT target_domain AS domain, count(*) AS discovery_events, count(*) FILTER (action = 'activated') AS activated_events,
    count(*) FILTER (action = 'blocked') AS blocked_events, max(discovered_at) AS last_discovered FROM domain_discoveries GROUP BY target_domain) x USING (domain)
LEFT JOIN (SELECT e.source_domain AS domain, count(*) AS observation_count, count(DISTINCT o.run_id) AS productive_runs, max(o.observed_at) AS last_useful_at
  FROM observations o JOIN entities e USING (entity_key) GROUP BY e.source_domain) o USING (domain)
ORDER BY coalesce(productive_runs, 0) DESC, entities_found DESC, pages_seen DESC, relevance_score DESC, domain LIMIT 50""", *_PROFILES)
def source_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return memory.source_profiles(*[table(spark, sf, n) for n in _PROFILES], PROJECT, as_of=AS_OF)


@query("SELECT status, count(*) AS n FROM domains GROUP BY status", "domains")
def domain_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return memory.counts_by(table(spark, sf, "domains"), PROJECT, "status")


@query("SELECT action, count(*) AS n FROM domain_discoveries WHERE run_id = 5 GROUP BY action", "domain_discoveries")
def discovery_action_counts(spark: SparkSession, sf: str) -> DataFrame:
    return memory.counts_by(table(spark, sf, "domain_discoveries"), PROJECT, "action", run_id=5)


@query("SELECT * EXCLUDE (project_id) FROM domains WHERE status = 'active' ORDER BY relevance_score DESC, domain", "domains")
def list_domains(spark: SparkSession, sf: str) -> DataFrame:
    return memory.listing(table(spark, sf, "domains"), PROJECT, [F.desc("relevance_score"), F.col("domain")], status="active").drop("project_id")


@query("SELECT * EXCLUDE (project_id) FROM domain_discoveries WHERE action = 'activated' ORDER BY id DESC LIMIT 100", "domain_discoveries")
def list_domain_discoveries(spark: SparkSession, sf: str) -> DataFrame:
    return memory.listing(table(spark, sf, "domain_discoveries"), PROJECT, [F.desc("id")], 100, action="activated").drop("project_id")


@query("SELECT * EXCLUDE (project_id) FROM feeds WHERE status = 'error'", "feeds")
def list_feeds(spark: SparkSession, sf: str) -> DataFrame:
    return memory.listing(table(spark, sf, "feeds"), PROJECT, [F.col("domain"), F.col("feed_url")], status="error").drop("project_id")


@query("SELECT * EXCLUDE (project_id) FROM feed_snapshots WHERE run_id = 5", "feed_snapshots")
def feed_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return memory.listing(table(spark, sf, "feed_snapshots"), PROJECT, [F.col("feed_url")], run_id=AFTER).drop("project_id")


@query("""
SELECT target_domain, action, reason, discovered_via, provider, query_text, count(*) AS n, max(relevance_score) AS max_score, arg_min(target_url, id) AS first_url
FROM domain_discoveries WHERE run_id = 5 GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY target_domain, action, reason, discovered_via, provider, query_text"), "domain_discoveries")
def trace_discoveries(spark: SparkSession, sf: str) -> DataFrame:
    return memory.grouped_trace(table(spark, sf, "domain_discoveries"), PROJECT, 5)


@query("SELECT id AS run_id, max(CASE WHEN finished_at IS NOT NULL THEN id END) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_run_id FROM runs", "runs")
def previous_finished_run(spark: SparkSession, sf: str) -> DataFrame:
    return changes.previous_finished_run(table(spark, sf, "runs"), PROJECT)


_STATE = """CASE WHEN outcome IN ('html_ok', 'non_html') THEN 'reachable' WHEN outcome = 'http_status' AND http_status IS NOT NULL THEN CASE WHEN http_status >= 500 THEN 'failed' ELSE 'reachable' END
  WHEN starts_with(outcome, 'http_error:') THEN 'failed' ELSE 'ignored' END"""
_DOMAINS = f"""SELECT run_id, domain, CASE WHEN bool_or(s = 'reachable') THEN 'reachable' WHEN bool_or(s = 'failed') THEN 'failed' ELSE 'unknown' END AS state, count(*) AS visits
  FROM (SELECT *, {_STATE} AS s FROM page_visits) GROUP BY run_id, domain"""


@query(f"SELECT domain, state, visits FROM ({_DOMAINS}) WHERE run_id = 5", "page_visits")
def domain_states(spark: SparkSession, sf: str) -> DataFrame:
    return changes.domain_states(table(spark, sf, "page_visits"), PROJECT, AFTER)


_CHANGE_TABLES = ("observations", "entity_cluster_members", "page_visits", "feed_snapshots")
_CHANGES = f"""
WITH states AS ({_DOMAINS}),
snap AS (SELECT o.* EXCLUDE (rn), coalesce(m.cluster_key, o.entity_key) AS cluster_key FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, entity_key ORDER BY id DESC) AS rn, min(id) OVER (PARTITION BY run_id, entity_key) AS first_id FROM observations) o
  LEFT JOIN entity_cluster_members m USING (entity_key) WHERE rn = 1),
clusters AS (SELECT run_id, cluster_key, list_sort(list(DISTINCT source_domain || ' ' || source_url)) AS sources FROM snap GROUP BY ALL),
b AS (SELECT * FROM snap WHERE run_id = {BEFORE}), a AS (SELECT * FROM snap WHERE run_id = {AFTER}),
cb AS (SELECT * FROM clusters WHERE run_id = {BEFORE}), ca AS (SELECT * FROM clusters WHERE run_id = {AFTER}),
fb AS (SELECT * FROM feed_snapshots WHERE run_id = {BEFORE}), fa AS (SELECT * FROM feed_snapshots WHERE run_id = {AFTER}),
events AS (
  SELECT CASE WHEN cb.cluster_key IS NULL THEN 'NEW_ENTITY' WHEN ca.cluster_key IS NULL THEN 'ENTITY_DISAPPEARED' ELSE 'SOURCE_CHANGED' END AS change_type,
    coalesce(cb.cluster_key, ca.cluster_key) AS cluster_key, '' AS entity_key
  FROM cb FULL JOIN ca ON cb.cluster_key = ca.cluster_key WHERE cb.cluster_key IS NULL OR ca.cluster_key IS NULL OR cb.sources <> ca.sources
  UNION ALL SELECT CASE WHEN a.price < b.price THEN 'PRICE_DROP' ELSE 'PRICE_INCREASE' END, a.cluster_key, a.entity_key FROM a JOIN b USING (entity_key) WHERE a.currency <> '' AND a.currency = b.currency AND a.price <> b.price
  UNION ALL SELECT 'SELLER_CHANGED', a.cluster_key, a.entity_key FROM a JOIN b USING (entity_key)
    WHERE a.seller_confidence >= 0.7 AND b.seller_confidence >= 0.7 AND a.seller_fact <> b.seller_fact
  UNION ALL SELECT CASE WHEN o.state = 'reachable' THEN 'DOMAIN_FAILED' ELSE 'DOMAIN_RECOVERED' END, 'domain:' || o.domain, '' FROM states o JOIN states n USING (domain)
    WHERE o.run_id = {BEFORE} AND n.run_id = {AFTER} AND ((o.state = 'reachable' AND n.state = 'failed') OR (o.state = 'failed' AND n.state = 'reachable'))
  UNION ALL SELECT 'FEED_APPEARED', 'feed:' || feed_url, '' FROM fa WHERE feed_url NOT IN (SELECT feed_url FROM fb)
  UNION ALL SELECT 'FEED_DISAPPEARED', 'feed:' || feed_url, '' FROM fb WHERE feed_url NOT IN (SELECT feed_url FROM fa) AND domain IN (SELECT domain FROM states WHERE run_id = {AFTER} AND state = 'reachable')
  UNION ALL SELECT CASE WHEN fb.status = 'active' THEN 'FEED_FAILED' ELSE 'FEED_RECOVERED' END, 'feed:' || feed_url, '' FROM fa JOIN fb USING (feed_url) WHERE fa.status <> fb.status
  UNION ALL SELECT 'FEED_NEW_ENTRIES', 'feed:' || feed_url, '' FROM fa JOIN fb USING (feed_url) WHERE fa.status = 'active' AND fa.new_entries > fb.new_entries)
"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return changes.compare_runs({n: table(spark, sf, n) for n in _CHANGE_TABLES}, PROJECT, BEFORE, AFTER)


@query(_CHANGES + "SELECT * FROM events", *_CHANGE_TABLES)
def compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("change_type", "cluster_key", "entity_key")


@query(_CHANGES + "SELECT t.position::INTEGER AS position, t.change_type, (SELECT count(*) FROM events e WHERE e.change_type = t.change_type) AS n FROM (SELECT unnest(range(15)) AS position, unnest(["
       + ", ".join(f"'{t}'" for t in changes.CHANGE_TYPES) + "]) AS change_type) t", *_CHANGE_TABLES)
def change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return changes.change_counts(_events(spark, sf))


@query(_CHANGES + f""", reached AS (SELECT DISTINCT run_id, unnest([url, final_url]) AS u FROM page_visits WHERE {_STATE} = 'reachable'),
rb AS (SELECT u FROM reached WHERE run_id = {BEFORE} AND u <> ''), ra AS (SELECT u FROM reached WHERE run_id = {AFTER} AND u <> ''),
src AS (SELECT DISTINCT run_id, cluster_key, source_domain, source_url FROM snap),
added AS (SELECT cluster_key, bool_and(source_url IN (SELECT u FROM rb)) AS ok FROM (SELECT cluster_key, source_url FROM src x WHERE run_id = {AFTER} AND NOT EXISTS (SELECT 1 FROM src y WHERE y.run_id = {BEFORE} AND y.cluster_key = x.cluster_key AND y.source_url = x.source_url AND y.source_domain = x.source_domain)) GROUP BY ALL),
removed AS (SELECT cluster_key, bool_and(source_url IN (SELECT u FROM ra)) AS ok FROM (SELECT cluster_key, source_url FROM src x WHERE run_id = {BEFORE} AND NOT EXISTS (SELECT 1 FROM src y WHERE y.run_id = {AFTER} AND y.cluster_key = x.cluster_key AND y.source_url = x.source_url AND y.source_domain = x.source_domain)) GROUP BY ALL)
SELECT change_type, suppressed, count(*) AS n FROM (SELECT e.change_type, CASE
    WHEN change_type = 'NEW_ENTITY' AND NOT coalesce(added.ok, false) THEN 'source_url_not_rechecked_in_before_run'
    WHEN change_type = 'ENTITY_DISAPPEARED' AND NOT coalesce(removed.ok, false) THEN 'source_url_not_rechecked_in_after_run'
    WHEN change_type = 'SOURCE_CHANGED' AND NOT (coalesce(added.ok, false) AND coalesce(removed.ok, false)) THEN 'source_set_not_comparably_rechecked' END AS suppressed
  FROM events e LEFT JOIN added USING (cluster_key) LEFT JOIN removed USING (cluster_key)) GROUP BY change_type, suppressed""", *_CHANGE_TABLES)
def watch_coverage(spark: SparkSession, sf: str) -> DataFrame:
    kept = changes.coverage(_events(spark, sf), table(spark, sf, "page_visits"), PROJECT, BEFORE, AFTER)
    return kept.groupBy("change_type", "suppressed").agg(F.count("*").alias("n"))


_JUDGED = """(SELECT *, CASE WHEN is_missing THEN 'missing' WHEN is_mismatched THEN 'mismatched' ELSE 'supported' END AS verdict,
  CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS band FROM field_evidence)"""


@query(f"""SELECT entity_key, count(*) FILTER (verdict <> 'missing') AS field_count, count(*) FILTER (verdict = 'supported') AS supported,
  count(*) FILTER (verdict = 'supported' AND band = 'high') AS high, count(*) FILTER (verdict = 'supported' AND band = 'medium') AS medium, count(*) FILTER (verdict = 'supported' AND band = 'low') AS low,
  count(*) FILTER (verdict = 'missing') AS missing, count(*) FILTER (verdict = 'mismatched') AS mismatched, count(*) FILTER (verdict = 'supported' AND starts_with(evidence, 'default:')) AS defaults,
  coalesce(array_to_string((list(field ORDER BY confidence, field) FILTER (verdict = 'supported'))[1:5], ','), '') AS weakest
FROM {_JUDGED} GROUP BY entity_key""", "field_evidence")
def evidence_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.by_entity(table(spark, sf, "field_evidence"), PROJECT)


@query(f"""SELECT field, count(*) FILTER (verdict = 'supported' AND band = 'low') AS low, count(*) FILTER (verdict = 'missing') AS missing, count(*) FILTER (verdict = 'mismatched') AS mismatched,
  count(*) FILTER (verdict = 'supported' AND starts_with(evidence, 'default:')) AS defaults FROM {_JUDGED} GROUP BY field""", "field_evidence")
def evidence_by_field(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.by_field(table(spark, sf, "field_evidence"), PROJECT)


@query(f"SELECT extraction_method, count(*) AS n FROM {_JUDGED} WHERE verdict = 'supported' GROUP BY extraction_method", "field_evidence")
def evidence_by_method(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.by_method(table(spark, sf, "field_evidence"), PROJECT)


@query("""SELECT count(*) AS total, count(*) FILTER (is_relevant) AS relevant, count(last_price) FILTER (is_relevant) AS priced,
  count(DISTINCT CASE WHEN trim(seller) <> '' THEN trim(seller) END) FILTER (is_relevant) AS sellers, min(last_price) FILTER (is_relevant) AS min_price,
  median(last_price) FILTER (is_relevant) AS median_price, max(last_price) FILTER (is_relevant) AS max_price FROM entities""", "entities")
def report_analytics(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.report_analytics(table(spark, sf, "entities"), PROJECT)


@query("SELECT category, count(*) AS n FROM entities WHERE is_relevant GROUP BY category", "entities")
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.category_counts(table(spark, sf, "entities"), PROJECT)


@query("""SELECT host, count(*) AS pages, sum(n_links)::BIGINT AS links FROM (SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host,
  len(regexp_extract_all(html, '<a\\s[^>]*?href=["'']([^"'']*)["'']')) AS n_links FROM pages) GROUP BY host""")
def page_hosts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select(urls.host_key(F.col("url")).alias("host"), F.size(urls.links(F.col("html"))).alias("n"))
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.sum("n").alias("links"))


@query()
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", "url", F.posexplode(urls.links(F.col("html"))).alias("position", "link"))
    rows = rows.withColumn("target", urls.normal_url(urls.absolute_url("url", "link"))).where("target <> ''")
    return rows.select("page_id", "position", "target", urls.host_key(F.col("target")).alias("host"), urls.safety(F.col("target")).alias("safety"), urls.relevance(F.col("target"), F.lit(""), keywords=["product", "shop"]).alias("score"))


_TERMS = """(SELECT DISTINCT query, unnest(regexp_extract_all(lower(first_title), '[\\p{L}\\p{N}]+')) AS term FROM (SELECT query, arg_min(title, provider_index) AS first_title FROM search_hits GROUP BY query))"""


def _terms(hits: DataFrame) -> DataFrame:
    from ..functions.text import tokens

    first = hits.groupBy("query").agg(F.min_by("title", "provider_index").alias("first_title"))
    return first.select("query", F.explode(F.array_distinct(tokens(F.col("first_title")))).alias("term"))


@query(f"""
WITH docs AS (SELECT query, provider_index, regexp_extract_all(lower(concat_ws(' ', title, snippet, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), regexp_extract(url, '^[a-z]+://([^/]+)', 1))), '[\\p{{L}}\\p{{N}}]+') AS words FROM search_hits),
stats AS (SELECT *, len(words) AS length, count(*) OVER (PARTITION BY query) AS n, sum(len(words)) OVER (PARTITION BY query) AS total FROM docs),
tf AS (SELECT query, provider_index, term, length, n, total, count(*) AS tf FROM (SELECT * EXCLUDE (words), unnest(words) AS term FROM stats) JOIN {_TERMS} t USING (query, term) GROUP BY ALL),
df AS (SELECT *, count(*) OVER (PARTITION BY query, term) AS df FROM tf)
SELECT query, provider_index, count(*) AS matched_terms, floor(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length * n / total))) * 1000 + 0.0001)::BIGINT AS bm25_milli FROM df GROUP BY query, provider_index""", "search_hits")
def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "search_hits")
    scored = ranking.bm25(hits, _terms(hits)).where("matched_terms > 0")
    return scored.select("query", "provider_index", "matched_terms", F.floor(F.col("bm25") * 1000 + 0.0001).alias("bm25_milli"))


_TARGET, _ANCHORS, _NEGATIVE = ["that", "the", "and"], ["that"], [" in ", "der "]
_SIGNALS = f"""SELECT query, provider_index, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS domain, len(list_intersect(q, tt)) AS title_matches, len(list_intersect(q, pt)) AS path_matches, len(list_intersect(q, dt)) AS domain_matches,
  len(list_intersect(['that', 'the', 'and'], list_distinct(tt || st || pt || dt))) AS target_matches, len(list_intersect(['that'], list_distinct(tt || st || pt || dt))) AS anchor_matches,
  contains(hay, ' in ')::INTEGER + contains(hay, 'der ')::INTEGER AS negative_matches
FROM (SELECT *, list_distinct(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+')) AS tt, list_distinct(regexp_extract_all(lower(snippet), '[\\p{{L}}\\p{{N}}]+')) AS st,
    list_distinct(regexp_extract_all(lower(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)), '[\\p{{L}}\\p{{N}}]+')) AS pt, list_distinct(regexp_extract_all(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '[\\p{{L}}\\p{{N}}]+')) AS dt,
    lower(concat_ws(' ', title, snippet, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), regexp_extract(url, '^[a-z]+://([^/]+)', 1))) AS hay FROM search_hits) h
JOIN (SELECT query, list(term) AS q FROM {_TERMS} GROUP BY query) USING (query)"""


@query(_SIGNALS, "search_hits")
def hit_signals(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "search_hits")
    return ranking.match_counts(hits, _terms(hits), _TARGET, _ANCHORS, _NEGATIVE).drop("url", "audit")


_BM25 = ORACLES["bm25_scores"].replace("floor(sum(", "sum(").replace(" * 1000 + 0.0001)::BIGINT AS bm25_milli", " AS bm25")


@query(f"""
WITH p AS ({ORACLES["source_profiles"].rsplit("ORDER BY", 1)[0]}), b AS ({_BM25}), g AS ({with_views(_SIGNALS, "search_hits")}),
s AS (SELECT g.*, coalesce(b.bm25, 0) AS bm25, productive_run_rate, entity_yield, success_rate, CASE WHEN p.status IS NULL THEN 'untested' WHEN p.status IN ('blocked', 'rejected') THEN p.status
    WHEN productive_runs > 0 THEN CASE WHEN is_stale THEN 'productive_stale' ELSE 'productive_fresh' END WHEN crawl_runs > 0 THEN 'nonproductive' ELSE 'untested' END AS state
  FROM g LEFT JOIN b USING (query, provider_index) LEFT JOIN p USING (domain))
SELECT query, provider_index, domain, state, title_matches, target_matches, anchor_matches, negative_matches, row_number() OVER (PARTITION BY query ORDER BY anchor_matches DESC, target_matches DESC,
  CASE state WHEN 'productive_fresh' THEN 0 WHEN 'untested' THEN 1 WHEN 'productive_stale' THEN 2 WHEN 'nonproductive' THEN 3 ELSE 4 END,
  CASE WHEN state LIKE 'productive%' THEN -productive_run_rate ELSE 0 END, CASE WHEN state LIKE 'productive%' THEN -entity_yield ELSE 0 END, CASE WHEN state LIKE 'productive%' THEN -success_rate ELSE 0 END,
  negative_matches > 0, round(bm25, 9) DESC, title_matches DESC, path_matches DESC, domain_matches DESC, provider_index) AS rank FROM s""")
def ranked_hits(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "search_hits")
    profiles = memory.source_profiles(*[table(spark, sf, n) for n in _PROFILES], PROJECT, limit=None, as_of=AS_OF)
    ranked = ranking.rank_hits(hits, _terms(hits), profiles, _NEGATIVE, _TARGET, _ANCHORS)
    return ranked.select("query", "provider_index", "domain", "state", "title_matches", "target_matches", "anchor_matches", "negative_matches", "rank")


@query("""
WITH v AS (SELECT domain AS host, count(*) AS pages FROM page_visits WHERE run_id = 5 GROUP BY domain),
f AS (SELECT target_url AS url, target_domain AS host, (relevance_score * 100)::INTEGER AS priority, min(id) AS place FROM domain_discoveries WHERE run_id = 6 GROUP BY ALL),
t AS (SELECT f.*, coalesce(v.pages, 0) AS pages, row_number() OVER (PARTITION BY f.host ORDER BY priority DESC, place) AS turn FROM f LEFT JOIN v USING (host))
SELECT url, host, priority, place FROM t WHERE turn + pages <= 6 ORDER BY priority DESC, place LIMIT 40""".replace("GROUP BY ALL)", "GROUP BY target_url, target_domain, relevance_score)"), "page_visits", "domain_discoveries")
def fetch_wave(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "domain_discoveries").where("run_id = 6").groupBy("target_url", "target_domain", "relevance_score").agg(F.min("id").alias("place"))
    frontier = found.select(F.col("target_url").alias("url"), F.col("target_domain").alias("host"), F.bround(F.col("relevance_score") * 100).cast("int").alias("priority"), "place")
    visited = table(spark, sf, "page_visits").where("run_id = 5").groupBy(F.col("domain").alias("host")).agg(F.count("*").alias("pages"))
    return ranking.wave(frontier, visited, 40, 6)


@query("""
WITH p AS (SELECT run_id, id AS page_no, CASE WHEN outcome = 'html_ok' AND id % 3 = 0 THEN 1 ELSE 0 END AS found FROM page_visits),
i AS (SELECT *, sum(found) OVER (PARTITION BY run_id ORDER BY page_no) AS island FROM p),
s AS (SELECT *, sum(1 - found) OVER (PARTITION BY run_id, island ORDER BY page_no) AS streak FROM i)
SELECT run_id, max(streak)::BIGINT AS longest_streak, min(page_no) FILTER (streak >= 8) AS stop_page FROM s GROUP BY run_id""", "page_visits")
def saturation_stop(spark: SparkSession, sf: str) -> DataFrame:
    found = F.when((F.col("outcome") == "html_ok") & (F.col("id") % 3 == 0), 1).otherwise(0)
    return ranking.streaks(table(spark, sf, "page_visits").select("run_id", F.col("id").alias("page_no"), found.alias("found")), 8)


@query("""SELECT doc_id, (contains(h, 'tion')::INT + contains(h, 'ment')::INT)::INTEGER AS positive_hits, contains(h, 'lich')::INTEGER AS negative_hits,
  least(1.0, greatest(0.0, 0.18 + (contains(h, 'tion')::INT + contains(h, 'ment')::INT)::INT * 0.10::DOUBLE - contains(h, 'lich')::INT * 0.22::DOUBLE)) >= 0.2 AS is_relevant
FROM (SELECT doc_id, lower(text) AS h FROM documents)""")
def keyword_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranking.fallback_enrichment(table(spark, sf, "documents").select("doc_id", "text"), F.col("text"), ["tion", "ment"], ["lich"], 0.2)
    return rows.select("doc_id", "positive_hits", "negative_hits", "is_relevant")


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entities").withColumn("ord", F.col("n"))


@query()
def resolution_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.assign_clusters(_entities(spark, sf))


@query("""
WITH i AS (SELECT n AS ord, entity_key, source_domain, regexp_replace(lower(brand), '[^a-z0-9]+', ' ', 'g') || '|' || regexp_replace(upper(model), '[^0-9A-Z]', '', 'g') AS mm,
  CASE WHEN sku <> '' THEN source_domain || '|' || sku END AS ls FROM entities)
SELECT kind, key, count(*) AS n FROM (SELECT 'maker_model_exact' AS kind, 'product|' || mm AS key FROM i UNION ALL SELECT 'source_sku_exact', 'product|' || ls FROM i WHERE ls IS NOT NULL) GROUP BY kind, key""", "entities")
def identity_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = resolution.strong_keys(resolution.identities(_entities(spark, sf)))
    return keys.groupBy("kind", "key").agg(F.count("*").alias("n"))


@query("SELECT cluster_key, count(*) AS members, count(DISTINCT source_domain) AS sources FROM entity_cluster_members LEFT JOIN entities USING (entity_key) GROUP BY cluster_key", "entity_cluster_members", "entities")
def cluster_summary(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.cluster_summary(table(spark, sf, "entity_cluster_members"), table(spark, sf, "entities"))


@query("SELECT entity_key, count(*) OVER (ORDER BY n, entity_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS compared FROM entities", "entities")
def compared_entities(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.compared_entities(_entities(spark, sf))


@query("""SELECT entity_key, CASE WHEN contains(t, 'red') AND contains(t, 'widget') THEN 'confirmed' WHEN contains(t, 'widget') THEN 'uncertain' ELSE 'rejected' END AS target_status
FROM (SELECT entity_key, list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) AS t FROM entities)""".replace("contains(t,", "list_contains(t,"), "entities")
def target_gate(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.target_gate(table(spark, sf, "entities"), F.col("title"), ["red", "widget"], ["widget"]).select("entity_key", "target_status")


@query("""
WITH c AS (SELECT id AS place, target_domain AS domain, relevance_score AS score FROM domain_discoveries WHERE run_id = 7),
e AS (SELECT c.*, d.status FROM c LEFT JOIN domains d USING (domain)),
t AS (SELECT domain, min(place) AS first FROM e WHERE status = 'active' OR (coalesce(status, 'candidate') = 'candidate' AND score >= 0.3) GROUP BY domain ORDER BY first LIMIT 20),
v AS (SELECT place, e.domain, status, CASE WHEN status = 'blocked' THEN 'blocked,persisted_blocked' WHEN status = 'rejected' THEN 'recorded,persisted_rejected'
  WHEN first < place OR (status = 'active' AND first IS NOT NULL) THEN 'known,already_active' WHEN status = 'active' THEN 'recorded,domain_budget_reached'
  WHEN first = place THEN 'activated,relevance_threshold' WHEN score < 0.3 THEN 'recorded,below_threshold' ELSE 'recorded,domain_budget_reached' END AS verdict FROM e LEFT JOIN t USING (domain))
SELECT place, domain, split_part(verdict, ',', 1) AS action, split_part(verdict, ',', 2) AS reason,
  CASE WHEN split_part(verdict, ',', 1) IN ('activated', 'known') THEN 'active' ELSE coalesce(status, 'candidate') END AS domain_status FROM v""", "domain_discoveries", "domains")
def registry_decisions(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "domain_discoveries").where("run_id = 7").select(F.col("id").alias("place"), F.col("target_url").alias("url"), F.col("relevance_score").alias("score"), F.lit(1).alias("depth"))
    return registry.decide(found, table(spark, sf, "domains"), registry.Policy()).select("place", "domain", "action", "reason", "domain_status")


@query("""
WITH n AS (SELECT target_domain AS domain, count(*) AS pages_seen, max(relevance_score) AS relevance_score, CASE WHEN bool_or(action = 'activated') THEN 'active' ELSE 'candidate' END AS status FROM domain_discoveries WHERE run_id = 8 GROUP BY target_domain)
SELECT coalesce(d.domain, n.domain) AS domain, CASE WHEN n.domain IS NULL THEN d.status WHEN d.domain IS NULL THEN n.status WHEN d.status = 'blocked' THEN 'blocked' WHEN d.status = 'rejected' AND n.status <> 'active' THEN 'rejected'
    WHEN d.status = 'active' AND n.status = 'candidate' THEN 'active' ELSE n.status END AS status,
  coalesce(d.pages_seen, 0) + coalesce(n.pages_seen, 0) AS pages_seen, greatest(d.relevance_score, n.relevance_score) AS relevance_score
FROM domains d FULL JOIN n ON d.domain = n.domain""", "domains", "domain_discoveries")
def save_domains(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "domains").select("project_id", "domain", "status", "pages_seen", "relevance_score")
    rows = table(spark, sf, "domain_discoveries").where("run_id = 8").groupBy("project_id", F.col("target_domain").alias("domain"))
    new = rows.agg(F.when(F.bool_or(F.col("action") == "activated"), "active").otherwise("candidate").alias("status"), F.count("*").alias("pages_seen"), F.max("relevance_score").alias("relevance_score"))
    return store.save_domains(old, new).drop("project_id")


@query("SELECT run_id, id, row_number() OVER (PARTITION BY run_id ORDER BY id) AS sequence FROM domain_discoveries", "domain_discoveries")
def adaptive_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return store.numbered(table(spark, sf, "domain_discoveries").select("run_id", "id"), "run_id", "id").withColumn("sequence", F.col("sequence").cast("long"))


_LINEAGE = (*_PROFILES, "runs", "feed_snapshots", "entity_clusters", "entity_cluster_members", "entity_resolution_events", "entity_cluster_merge_events")


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf, n) for n in _LINEAGE}


@query(ORACLES["source_profiles"].rsplit("ORDER BY", 1)[0].rstrip() + " WHERE d.domain = 'd5.example'")
def explain_domain(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.explain_domain(_tables(spark, sf), PROJECT, "d5.example", AS_OF)["profile"]


@query("""SELECT 'discoveries' AS part, id, run_id, action AS outcome FROM (SELECT * FROM domain_discoveries WHERE target_domain = 'd5.example' ORDER BY id DESC LIMIT 100)
UNION ALL SELECT 'page_visits', id, run_id, outcome FROM (SELECT * FROM page_visits WHERE domain = 'd5.example' ORDER BY id DESC LIMIT 100)""", "domain_discoveries", "page_visits")
def explain_domain_history(spark: SparkSession, sf: str) -> DataFrame:
    parts = lineage.explain_domain(_tables(spark, sf), PROJECT, "d5.example", AS_OF)
    rows = lambda name, outcome: parts[name].select(F.lit(name).alias("part"), "id", "run_id", F.col(outcome).alias("outcome"))
    return rows("discoveries", "action").unionAll(rows("page_visits", "outcome"))


@query("""SELECT c.cluster_key, c.entity_type, canonical_title, first_seen, last_seen, count(m.entity_key) AS member_count, count(DISTINCT e.source_domain) AS source_count
FROM entity_clusters c LEFT JOIN entity_cluster_members m ON m.cluster_key = c.cluster_key LEFT JOIN entities e ON e.entity_key = m.entity_key
WHERE merged_into_cluster_key = '' GROUP BY c.cluster_key, c.entity_type, canonical_title, first_seen, last_seen""", "entity_clusters", "entity_cluster_members", "entities")
def cluster_list(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.clusters(_tables(spark, sf), PROJECT)


@query("""SELECT m.cluster_key, m.entity_key, match_reason, linked_at, e.title, e.source_url, e.source_domain, e.last_price, e.brand, e.model, e.sku, count(o.id) AS observation_count, min(o.observed_at) AS first_observed, max(o.observed_at) AS last_observed
FROM entity_cluster_members m JOIN entities e ON e.entity_key = m.entity_key LEFT JOIN observations o ON o.entity_key = m.entity_key GROUP BY m.cluster_key, m.entity_key, match_reason, linked_at, e.title, e.source_url, e.source_domain, e.last_price, e.brand, e.model, e.sku""", "entity_cluster_members", "entities", "observations")
def cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.cluster_members(_tables(spark, sf), PROJECT)


@query("""WITH m AS (SELECT m.entity_key, source_domain, (SELECT count(*) FROM observations o WHERE o.entity_key = m.entity_key) AS n FROM entity_cluster_members m JOIN entities USING (entity_key) WHERE cluster_key = 'c7')
SELECT cluster_key, entity_type, canonical_title, first_seen, last_seen, merged_into_cluster_key, merged_at, CASE WHEN merged_into_cluster_key <> '' THEN 'merged' ELSE 'active' END AS status,
  (SELECT count(*) FROM m) AS member_count, (SELECT count(DISTINCT nullif(source_domain, '')) FROM m) AS source_count, (SELECT coalesce(sum(n), 0)::BIGINT FROM m) AS observation_count
FROM entity_clusters WHERE cluster_key = 'c7'""", "entity_clusters", "entity_cluster_members", "entities", "observations")
def explain_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.explain_cluster(_tables(spark, sf), PROJECT, "c7")["summary"]


@query("""SELECT id, run_id, entity_key, decision, reason, selected_cluster_key, compared_entities, resolved_at FROM entity_resolution_events
WHERE selected_cluster_key = 'c7' OR entity_key IN (SELECT entity_key FROM entity_cluster_members WHERE cluster_key = 'c7')""", "entity_resolution_events", "entity_cluster_members")
def explain_cluster_events(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.explain_cluster(_tables(spark, sf), PROJECT, "c7")["resolution_events"].drop("project_id")


@query("SELECT * EXCLUDE (project_id) FROM entity_resolution_events WHERE run_id = 3 ORDER BY id LIMIT 100", "entity_resolution_events")
def resolution_event_list(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.resolution_events(table(spark, sf, "entity_resolution_events"), PROJECT, 3).drop("project_id")


@query("""SELECT r.id AS event_id, run_id, r.entity_key, decision, reason, selected_cluster_key, compared_entities, resolved_at, title, source_url, source_domain, canonical_title
FROM entity_resolution_events r JOIN entities e ON e.entity_key = r.entity_key JOIN entity_clusters c ON c.cluster_key = r.selected_cluster_key
WHERE (decision = 'deferred_ambiguous' OR (decision = 'created_separate' AND reason IN ('identity_conflict', 'target_cluster_identity_conflict'))) AND merged_into_cluster_key = ''
ORDER BY r.id LIMIT 100""", "entity_resolution_events", "entities", "entity_clusters")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.review_queue(_tables(spark, sf), PROJECT)


@query("SELECT * EXCLUDE (project_id) FROM entity_cluster_merge_events ORDER BY id LIMIT 100", "entity_cluster_merge_events")
def cluster_merges(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.merge_events(table(spark, sf, "entity_cluster_merge_events"), PROJECT).drop("project_id")


@query("""SELECT o.id, o.entity_key, o.observed_at, o.price::DOUBLE AS price, coalesce(o.currency, '') AS currency, coalesce(e.title, '') AS entity_title, coalesce(e.entity_type, '') AS entity_type, coalesce(e.source_url, '') AS entity_url,
  coalesce(e.source_domain, '') AS entity_domain, coalesce(m.cluster_key, '') AS cluster_key, coalesce(m.match_reason, '') AS match_reason
FROM observations o LEFT JOIN entities e ON e.entity_key = o.entity_key LEFT JOIN entity_cluster_members m ON m.entity_key = o.entity_key WHERE o.run_id = 4""", "observations", "entities", "entity_cluster_members")
def trace_observations(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.trace_run(_tables(spark, sf), PROJECT, BEFORE)["observations"]


@query("""SELECT 'run' AS part, count(*) AS n FROM runs WHERE id = 4 UNION ALL SELECT 'page_visits', count(*) FROM page_visits WHERE run_id = 4 UNION ALL SELECT 'discoveries', count(*) FROM domain_discoveries WHERE run_id = 4
UNION ALL SELECT 'entity_resolution_events', count(*) FROM entity_resolution_events WHERE run_id = 4 UNION ALL SELECT 'observations', count(*) FROM observations WHERE run_id = 4 UNION ALL SELECT 'feed_snapshots', count(*) FROM feed_snapshots WHERE run_id = 4""", "runs", "page_visits", "domain_discoveries", "entity_resolution_events", "observations", "feed_snapshots")
def trace_run(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.part_counts(lineage.trace_run(_tables(spark, sf), PROJECT, BEFORE))


@query()
def page_products(spark: SparkSession, sf: str) -> DataFrame:
    return web.products(table(spark, sf, "pages"))
