"""Expected values of the research operators on small fixtures."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from basaltine.functions import text, urls
from basaltine.operators import changes, evidence, lineage, memory, ranking, registry, resolution, store
from basaltine.sources import web
from basaltine.streaming.watch import Hooks, watch


def _discoveries(spark, rows):
    return spark.createDataFrame([("p", r, "fake", "q", d, a, datetime(2024, 1, 1)) for r, d, a in rows], "project_id string, run_id long, provider string, query_text string, target_domain string, action string, discovered_at timestamp")


def test_query_memory(spark):
    one = memory.query_memory(_discoveries(spark, [(1, "market", "activated"), (1, "bad", "blocked")]), "p").first()
    assert (one.result_events, one.activated, one.blocked, one.productive_domains, one.blocked_domains, one.activation_rate, one.productive_domain_rate) == (2, 1, 1, 1, 1, 0.5, 0.5)
    two = memory.query_memory(_discoveries(spark, [(1, "m", "activated"), (1, "b", "blocked"), (1, "r", "recorded"), (2, "m", "known"), (2, "b", "blocked"), (2, "r", "recorded")]), "p").first()
    assert (two.runs, two.result_events, two.unique_domains, two.known, two.recorded) == (2, 6, 3, 1, 2)
    assert abs(two.activation_rate - 1 / 6) < 1e-12 and abs(two.productive_domain_rate - 1 / 3) < 1e-12
    assert memory.query_memory(_discoveries(spark, []), "p").collect() == []


def test_duplication(spark):
    rows = [(1, "p", None, None, 2, 5, 3, 2, 0), (2, "p", None, None, 1, 4, 2, 1, 1), (3, "p", None, None, 0, 0, 0, 0, 0)]
    runs = spark.createDataFrame(rows, "id long, project_id string, started_at timestamp, finished_at timestamp, search_queries_issued long, search_results_seen long, search_results_unique long, search_results_duplicates long, search_provider_errors long")
    total = memory.search_duplication(runs, "p").first()
    assert (total.runs, total.queries, total.raw_results, total.unique_results, total.duplicates, total.filtered_results, total.provider_errors) == (2, 3, 9, 5, 3, 1, 1)
    assert [r.duplicate_rate for r in memory.recent_search_runs(runs, "p").orderBy(F.desc("run_id")).collect()] == [0.25, 0.4]


def test_domain_health(spark):
    outcomes = {"a": ("html_ok", None), "b": ("http_status", 404), "c": ("http_status", 503), "d": ("http_error:Timeout", None), "e": ("robots_blocked", None), "f": ("non_html", None)}
    rows = [(k, "p", 1, f"u{k}", "", d, o, s) for k, (d, (o, s)) in enumerate(outcomes.items())] + [(99, "p", 1, "u", "", "c", "non_html", None)]
    visits = spark.createDataFrame(rows, "id long, project_id string, run_id long, url string, final_url string, domain string, outcome string, http_status int")
    got = {r.domain: r.state for r in changes.domain_states(visits, "p", 1).collect()}
    assert got == {"a": "reachable", "b": "reachable", "c": "reachable", "d": "failed", "e": "unknown", "f": "reachable"}


def _observed(spark, rows):
    return spark.createDataFrame([(k, "p", r, e, e, f"http://{s}/{e}", s, float(price), cur, seller, fact, conf) for k, (r, e, s, price, cur, seller, fact, conf) in enumerate(rows)],
                                 "id long, project_id string, run_id long, entity_key string, title string, source_url string, source_domain string, price double, currency string, seller string, seller_fact string, seller_confidence double")


def test_entity_diff(spark):
    same = ("x", "x", 0.9)
    rows = [(1, "drop", "s", 100, "EUR", *same), (2, "drop", "s", 90, "EUR", *same), (1, "up", "s", 50, "EUR", *same), (2, "up", "s", 65, "EUR", *same), (1, "gone", "s", 1, "EUR", *same), (2, "new", "s", 1, "EUR", *same),
            (1, "a", "source-a", 5, "EUR", *same), (2, "b", "source-b", 5, "EUR", *same), (1, "cur", "s", 10, "EUR", *same), (2, "cur", "s", 8, "USD", *same),
            (1, "sell", "s", 1, "EUR", "one", "one", 0.9), (2, "sell", "s", 1, "EUR", "two", "two", 0.9), (1, "low", "s", 1, "EUR", "one", "one", 0.62), (2, "low", "s", 1, "EUR", "two", "two", 0.62), (1, "stale", "s", 1, "EUR", "one", "old", 0.9), (2, "stale", "s", 1, "EUR", "two", "two", 0.9)]
    members = spark.createDataFrame([("p", "a", "ab"), ("p", "b", "ab")], "project_id string, entity_key string, cluster_key string")
    observed = _observed(spark, rows)
    events = changes.entity_events(*[changes.entity_snapshot(observed, members, "p", r) for r in (1, 2)])
    got = sorted((r.change_type, r.cluster_key) for r in events.collect())
    assert got == [("ENTITY_DISAPPEARED", "gone"), ("NEW_ENTITY", "new"), ("PRICE_DROP", "drop"), ("PRICE_INCREASE", "up"), ("SELLER_CHANGED", "sell"), ("SOURCE_CHANGED", "ab")]
    visits = lambda urls: spark.createDataFrame([(k, "p", r, u, "", "s", "html_ok", None) for k, (r, u) in enumerate(urls)], "id long, project_id string, run_id long, url string, final_url string, domain string, outcome string, http_status int")
    kept = lambda v: sorted(r.change_type for r in changes.coverage(events, v, "p", 1, 2).where("suppressed IS NULL").collect())
    assert "NEW_ENTITY" not in kept(visits([(2, "http://s/new")])) and "NEW_ENTITY" in kept(visits([(1, "http://s/new")]))
    assert "SOURCE_CHANGED" in kept(visits([(1, "http://source-b/b"), (2, "http://source-a/a")])) and "SOURCE_CHANGED" not in kept(visits([(1, "http://source-b/b")]))


def test_feed_events(spark):
    shape = "feed_url string, domain string, status string, new_entries long"
    before = spark.createDataFrame([("grow", "d", "active", 2), ("fail", "d", "active", 1), ("heal", "d", "error", 1), ("same", "d", "active", 8), ("reset", "d", "active", 10), ("gone", "d", "active", 1), ("unseen", "x", "active", 1)], shape)
    after = spark.createDataFrame([("grow", "d", "active", 5), ("fail", "d", "error", 1), ("heal", "d", "active", 1), ("same", "d", "active", 8), ("reset", "d", "active", 2), ("new", "d", "active", 1)], shape)
    reached = spark.createDataFrame([("d", "reachable")], "domain string, state string")
    got = sorted((r.change_type, r.cluster_key) for r in changes.feed_events(before, after, reached).collect())
    assert got == [("FEED_APPEARED", "feed:new"), ("FEED_DISAPPEARED", "feed:gone"), ("FEED_FAILED", "feed:fail"), ("FEED_NEW_ENTRIES", "feed:grow"), ("FEED_RECOVERED", "feed:heal")]


def test_compare_refuses_equal_runs(spark):
    with pytest.raises(ValueError):
        changes.compare_runs({}, "p", 1, 1)


def test_text_functions(spark):
    row = spark.createDataFrame([("4006 381333931", "036000291452", "4006381333932", "X-1", " Straße_Ä ", "1.299,00", "12,5 EUR")], "a string, b string, c string, d string, e string, f string, g string")
    got = row.select(*[text.gtin(F.col(c)) for c in "abc"], text.normal_code(F.col("d")), text.normal_text("e"), text.price(F.col("f")), text.price(F.col("g"))).first()
    assert tuple(got) == ("4006381333931", "036000291452", "", "X1", "strasse ä", 1.29, 12.5)
    prices = spark.createDataFrame([("5 10 EUR",), ("1\u00a0299,00",), ("none",)], "p string")
    assert [r[0] for r in prices.select(text.price(F.col("p"))).collect()] == [5.0, 1299.0, None]


def test_url_functions(spark):
    row = spark.createDataFrame([("HTTPS://WWW.Shop.Example//a//b/?utm_source=x&q=1+2&ref=z#f",)], "u string")
    got = row.select(urls.normal_url("u"), urls.host_key(F.col("u"))).first()
    assert tuple(got) == ("https://www.shop.example/a/b?q=1+2", "shop.example")
    cases = {"ftp://x": "unsupported_scheme", "http://localhost/": "local_host", "http://10.0.0.1/": "non_public_ip", "https://m.facebook.com/x": "blocked_host", "https://a.example/privacy": "blocked_path", "https://a.example/x.PDF": "binary_or_static_file", "https://a.example/item/1": "ok"}
    frame = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r[0]: r[1] for r in frame.select("u", urls.safety(F.col("u"))).collect()} == cases
    score = frame.where("u LIKE '%item%'").select(urls.relevance(F.col("u"), F.lit("big chair"), keywords=["chair"], negative=["sofa"])).first()[0]
    assert score == 10 + 35 + 4


def test_resolution(spark):
    shape = "entity_key string, entity_type string, source_domain string, title string, gtin string, brand string, manufacturer string, model string, mpn string, sku string, ord int"
    rows = [("a", "product", "s1", "Lamp", "4006381333931", "Acme", "", "X-1", "", "", 1), ("b", "product", "s2", "Lamp", "4006381333931", "", "", "", "", "", 2), ("c", "product", "s3", "Lamp", "", "", "", "", "", "", 3),
            ("d", "product", "s4", "Other", "", "", "ACME", "X1", "", "", 4), ("e", "product", "s5", "Other", "036000291452", "Acme", "", "X1", "", "", 5), ("f", "product", "s6", "N", "", "", "", "", "", "K9", 6), ("g", "product", "s6", "M", "", "", "", "", "", "K9", 7)]
    frame = spark.createDataFrame(rows, shape)
    got = {r.entity_key: (r.cluster_key, r.decision, r.reason) for r in resolution.assign_clusters(frame).collect()}
    assert got["a"] == ("a", "new_cluster", "no_candidates") and got["b"] == ("a", "linked", "gtin_exact") and got["c"] == ("c", "new_cluster", "no_strong_match")
    assert got["d"] == ("a", "linked", "maker_model_exact") and got["g"] == ("f", "linked", "source_sku_exact")
    assert got["e"] == ("e", "created_separate", "target_cluster_identity_conflict")
    again = {r.entity_key: (r.cluster_key, r.decision, r.reason) for r in resolution.assign_clusters(frame.repartition(5)).collect()}
    assert again == got
    assert resolution.review_queue(resolution.assign_clusters(frame), "conflict").count() == 1
    ids = resolution.identities(frame).cache()
    pairs = ids.select(F.struct("*").alias("a")).crossJoin(ids.select(F.struct("*").alias("b"))).where("a.entity_key < b.entity_key").select("a.entity_key", F.col("b.entity_key").alias("other"), resolution.decision("a", "b").alias("d"))
    found = {(r[0], r[1]): (r.d.outcome, r.d.reason) for r in pairs.collect()}
    assert found["a", "b"] == ("match", "gtin_exact") and found["a", "e"] == ("conflict", "gtin_conflict") and found["a", "c"] == ("insufficient", "supporting_signals_only")
    clusters = spark.createDataFrame([("a", "product", None), ("f", "product", None), ("e", "product", None)], "cluster_key string, entity_type string, merged_into_cluster_key string")
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("e", "e"), ("f", "f")], "entity_key string, cluster_key string")
    verdict = lambda s, t: resolution.merge_verdict(clusters, members, ids, s, t)[1]
    assert [verdict("a", "a"), verdict("a", "zz"), verdict("e", "a"), verdict("f", "a")] == ["same_cluster", "cluster_not_found", "identity_conflict", "no_strong_identity_match"]


def _assigned_in_pairs(rows):
    """Each entity is held against all earlier ones: entity: cluster, decision, reason, candidates, conflicts."""
    def pair(x, y):
        if x["gtin"] and y["gtin"]:
            return "gtin_exact" if x["gtin"] == y["gtin"] else "conflict"
        maker = x["brand"] and x["brand"] == y["brand"]
        for name, same in (("maker_model_exact", maker and x["model"] and x["model"] == y["model"]), ("maker_mpn_exact", maker and x["mpn"] and x["mpn"] == y["mpn"]),
                           ("source_sku_exact", x["sku"] and x["sku"] == y["sku"] and x["source_domain"] == y["source_domain"])):
            if same:
                return name
        return None

    got = {}
    for n, x in enumerate(rows):
        match, conflict = {}, set()
        for y in rows[:n]:
            if (found := pair(x, y)) == "conflict":
                conflict.add(got[y["entity_key"]][0])
            elif found:
                match.setdefault(got[y["entity_key"]][0], found)
        key, clash, open_ = x["entity_key"], sorted(set(match) & conflict), sorted(set(match) - conflict)
        if len(open_) == 1:
            row = open_[0], "linked", match[open_[0]], ""
        elif open_:
            row = key, "deferred_ambiguous", "ambiguous_multiple_clusters", ",".join(open_)
        else:
            row = (key, "created_separate", "target_cluster_identity_conflict", "") if clash else (key, "new_cluster", "no_strong_match" if n else "no_candidates", "")
        got[key] = *row, ",".join(clash)
    return got


_ENTITY = "entity_key string, entity_type string, source_domain string, gtin string, brand string, model string, mpn string, sku string, ord int"


@pytest.mark.parametrize("numbered, seed", [(0.0, 1), (0.3, 2), (0.7, 3)])
def test_resolution_as_in_pairs(spark, monkeypatch, numbered, seed):
    monkeypatch.setattr(resolution, "CELL", 64, raising=False)
    dice = random.Random(seed)
    some = lambda of, n, rate: f"{of}{dice.randrange(n)}" if dice.random() < rate else ""
    numbers = ["12345670", "96385074", "40170725", "73513537"]
    rows = [{"entity_key": f"e{dice.random()}", "entity_type": "product", "source_domain": f"d{dice.randrange(3)}", "gtin": dice.choice(numbers) if dice.random() < numbered else "", "brand": some("b", 3, 0.8),
             "model": some("M", 12, 0.5), "mpn": some("P", 12, 0.3), "sku": some("S", 9, 0.3), "ord": n} for n in range(240)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], _ENTITY).repartition(3)
    got = {r.entity_key: (r.cluster_key, r.decision, r.reason, r.candidates, r.conflicts) for r in resolution.assign_clusters(frame).collect()}
    assert got == _assigned_in_pairs(rows)
    assert {r[1] for r in got.values()} >= {"new_cluster", "linked", "deferred_ambiguous"} and any(r[4] for r in got.values()) == (numbered > 0)


def test_lists_of_one_key_are_written_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(resolution, "CELL", 1 << 16, raising=False)
    monkeypatch.setattr(resolution, "TASK", 1 << 16, raising=False)
    rows = [("a", "product", "d", "", "b", "M", "", "", 0), ("b", "product", "d", "", "", "", "", "S", 1), ("c", "product", "d", "", "b", "M", "", "S", 2)]
    rows += [(f"e{n:04}", "product", "d", "", "b", "M", "", "", n) for n in range(3, 1000)]
    made = resolution.assign_clusters(spark.createDataFrame(rows, _ENTITY)).withColumn("task", F.spark_partition_id()).where("decision = 'deferred_ambiguous'").collect()
    assert len(made) == 998 and len({r.task for r in made if r.entity_key != "c"}) > 3
    assert {r.entity_key: r.candidates for r in made}["e0999"] == ",".join(["a", "c", *(f"e{n:04}" for n in range(3, 999))])


def test_target_gate(spark):
    frame = spark.createDataFrame([("Bambu P1S Combo",), ("Bambu P2S Combo 3D",), ("BAMBU LAB",), ("P1S 3D printeris",)], "t string")
    got = [(r.target_status, r.target_reason) for r in resolution.target_gate(frame, F.col("t"), ["P1S", "Combo"], ["P1S"]).collect()]
    assert got == [("confirmed", "target_identity_confirmed"), ("rejected", "target_model_conflict"), ("rejected", "target_model_missing"), ("uncertain", "target_identity_incomplete")]


def test_extraction(spark):
    ld = '<script type="application/ld+json">{"@type":"Product","name":"Chair","offers":{"price":"199.00","priceCurrency":"USD"},"gtin13":"4006381333931"}</script>'
    og = '<meta property="og:title" content="chair"><meta property="og:type" content="product"><meta property="og:description" content="Fine"><meta property="product:price:amount" content="149.50">'
    micro = '<div itemscope itemtype="https://schema.org/Product"><h2 itemprop="name">Desk</h2><div itemprop="offers" itemscope><meta itemprop="price" content="179.90"><meta itemprop="priceCurrency" content="USD"></div><span itemprop="sku">K1</span></div>'
    dom = '<h1>Wooden box</h1><div class="price">129.99 EUR</div><button class="buy">x</button>'
    pages = spark.createDataFrame([("http://a.example/1", ld), ("http://a.example/2", og), ("http://a.example/3", ld + og), ("http://a.example/4", micro), ("http://a.example/5", dom), ("http://a.example/6", "<p>nothing"), ("http://a.example/7", None)], "url string, html string")
    got = {r.url[-1]: r for r in web.products(pages).collect()}
    assert set(got) == set("12345")
    assert (got["1"].price, got["1"].currency, got["1"].confidences["price"], got["1"].gtin) == (199.0, "USD", 0.98, "4006381333931")
    assert (got["2"].price, got["2"].confidences["price"], got["2"].currency, got["2"].confidences["currency"], got["2"].notes) == (149.5, 0.88, "EUR", 0.5, {"currency": "default:EUR"})
    assert (got["3"].method, got["3"].price, got["3"].description, got["3"].confidences["description"]) == ("json-ld", 199.0, "Fine", 0.88)
    assert (got["4"].title, got["4"].price, got["4"].currency, got["4"].sku, got["4"].confidences["price"]) == ("Desk", 179.9, "USD", "K1", 0.93)
    assert (got["5"].method, got["5"].title, got["5"].price, got["5"].confidences["price"]) == ("dom-fallback", "Wooden box", 129.99, 0.68)


def test_money():
    cases = {"5 10 EUR": (10.0, "EUR"), "1 299 SEK": (1299.0, "SEK"), "£12": None, "chf 12,5": (12.5, "CHF"), "now 1 299.90 €": (1299.9, "EUR"), "$ 5": None}
    assert {k: web.money(k) for k in cases} == cases
    assert (web.amount("5 10"), web.amount("1 299,00"), web.amount(None), len(web.clean("x" * 5000))) == (5.0, 1299.0, None, 4000)


def test_feeds_and_sitemaps(spark):
    rss = "<rss><channel><item><guid>new-2</guid><link>http://a/2</link><title>B</title></item><item><guid>old-1</guid><link>http://a/1</link></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>a2</id><link href="http://a/2"/><title>T</title></entry></feed>'
    rows = [("rss", rss), ("atom", atom), ("json", '{"items":[{"id":"j2","url":"http://j"}]}'), ("bad", "<rss>")]
    entries = web.feeds(spark.createDataFrame(rows, "feed_url string, body string"))
    assert sorted((r.feed_url, r.kind, r.entry_id) for r in entries.collect()) == [("atom", "atom", "a2"), ("json", "jsonfeed", "j2"), ("rss", "rss", "new-2"), ("rss", "rss", "old-1")]
    state = spark.createDataFrame([("rss", "old-1", None)], "feed_url string, last_entry_id string, last_published string")
    assert sorted(r.entry_id for r in web.new_entries(entries, state).collect()) == ["a2", "j2", "new-2"]
    maps = [("m", "<urlset><url><loc>http://a/1</loc></url><url><loc>http://a/2</loc></url></urlset>"), ("i", "<sitemapindex><sitemap><loc>http://a/s.xml</loc></sitemap></sitemapindex>"), ("b", "<urlset>")]
    got = web.sitemaps(spark.createDataFrame(maps, "sitemap_url string, body string")).collect()
    assert sorted((r.sitemap_url, r.kind, r.position) for r in got) == [("i", "sitemapindex", 0), ("m", "urlset", 0), ("m", "urlset", 1)]
    hits = spark.createDataFrame([("q", '{"results":[{"url":"u1","title":"a"},{"url":"u2"},{"url":"u1"}]}')], "query string, body string")
    assert sorted((r.url, r.provider_index) for r in web.search_hits(hits).collect()) == [("u1", 0), ("u2", 1)]


def test_registry(spark):
    domains = spark.createDataFrame([("seed.example", "active"), ("bad.example", "rejected")], "domain string, status string")
    rows = [("http://seed.example/x", 0.9, 1, 1), ("http://new.example/x", 0.7, 1, 2), ("http://low.example/x", 0.1, 1, 3), ("http://facebook.com/x", 0.9, 1, 4), ("http://ok.example/privacy", 0.9, 1, 5), ("http://new.example/y", 0.7, 1, 6), ("http://late.example/", 0.8, 1, 7), ("http://bad.example/", 0.8, 1, 8)]
    frame = spark.createDataFrame(rows, "url string, score double, depth int, place int")
    got = {r.place: (r.action, r.reason) for r in registry.decide(frame, domains, registry.Policy(max_domains=1)).collect()}
    assert got == {1: ("known", "already_active"), 2: ("recorded", "domain_budget_reached"), 3: ("recorded", "below_threshold"), 4: ("blocked", "blocked_host"), 5: ("blocked", "blocked_path"), 6: ("recorded", "domain_budget_reached"), 7: ("recorded", "domain_budget_reached"), 8: ("recorded", "persisted_rejected")}
    got = {r.place: (r.action, r.reason, r.domain_status) for r in registry.decide(frame, domains, registry.Policy(max_domains=2)).collect()}
    assert (got[2], got[6], got[7][1]) == (("activated", "relevance_threshold", "active"), ("known", "already_active", "active"), "domain_budget_reached")
    reasons = spark.createDataFrame([("bad.example", "rejected", "spam"), ("new.example", "candidate", "nonproductive_source")], "domain string, status string, reason string")
    held = spark.createDataFrame([("new.example",)], "domain string")
    got = {r.place: (r.action, r.reason) for r in registry.decide(frame, reasons, registry.Policy(kind="feed"), 1, held).collect()}
    assert (got[1], got[2], got[8]) == (("activated", "feed_relevance_threshold"), ("recorded", "nonproductive_source"), ("recorded", "spam"))
    answers = spark.createDataFrame([(200, None), (204, None), (301, None), (200, "Timeout")], "status int, error string")
    kind = registry.outcome(F.col("status"), F.lit("text/html"), F.col("error"), F.lit(True), F.lit(True))
    assert [r[0] for r in answers.select(kind).collect()] == ["html_ok", "http_status", "http_status", "http_error:Timeout"]
    rules = spark.createDataFrame([("a.example", 1, "/x/ok", True), ("a.example", 2, "/x", False)], "host string, line_no int, path string, allow boolean")
    visits = spark.createDataFrame([("http://a.example/x/ok",), ("http://a.example/x/no",), ("http://b.example/x",)], "url string")
    assert {r.url[-4:]: r.allowed for r in registry.robots_allowed(visits, rules).collect()} == {"x/ok": True, "x/no": False, "le/x": True}


def test_store_merge(spark):
    shape = "project_id string, domain string, status string, pages_seen long, relevance_score double, discovered_via string"
    old = spark.createDataFrame([("p", "a", "blocked", 1, 0.5, "seed"), ("p", "b", "active", 2, 0.9, "link"), ("p", "c", "rejected", 0, 0.1, "link")], shape)
    new = spark.createDataFrame([("p", "a", "active", 1, 0.7, "link"), ("p", "b", "candidate", 3, 0.2, "search"), ("p", "c", "active", 1, 0.1, "link"), ("p", "d", "candidate", 1, 0.3, "link")], shape)
    got = sorted(tuple(r)[1:] for r in store.save_domains(old, new).collect())
    assert got == [("a", "blocked", 2, 0.7, "seed"), ("b", "active", 5, 0.9, "search"), ("c", "active", 1, 0.1, "link"), ("d", "candidate", 1, 0.3, "link")]


def test_evidence(spark):
    rows = [("title", 0.98, "json-ld", False, False, ""), ("price", 0.68, "dom-fallback", False, False, ""), ("currency", 0.55, "json-ld", False, False, "default:EUR"), ("seller", 0.74, "x", False, False, ""), ("description", 0.9, "y", False, True, ""), ("image_url", 0.0, "", True, False, "")]
    facts = spark.createDataFrame([("p", "e", *r) for r in rows], "project_id string, entity_key string, field string, confidence double, extraction_method string, is_missing boolean, is_mismatched boolean, evidence string")
    one = evidence.by_entity(facts, "p").first()
    assert (one.field_count, one.supported, one.high, one.medium, one.low, one.missing, one.mismatched, one.defaults, one.weakest) == (5, 4, 1, 1, 2, 1, 1, 1, "currency,price,seller,title")


def test_bm25_order(spark):
    hits = spark.createDataFrame([("q", "http://a/x", "ergonomic chair", "lumbar support chair", 1), ("q", "http://b/x", "chair", "wood", 0), ("q", "http://c/x", "table", "oak", 2)], "query string, url string, title string, snippet string, provider_index long")
    terms = spark.createDataFrame([("q", t) for t in ("ergonomic", "chair", "lumbar", "support")], "query string, term string")
    got = [r.provider_index for r in ranking.bm25(hits, terms).orderBy(F.desc("bm25")).collect()]
    assert got == [1, 0, 2]


def test_watch(spark, tmp_path):
    same = ("x", "x", 0.9)
    observed = _observed(spark, [(1, "e", "s", 100, "EUR", *same), (2, "e", "s", 90, "EUR", *same)])
    shape = "id long, project_id string, run_id long, url string, final_url string, domain string, outcome string, http_status int"
    tables = {
        "observations": observed, "entity_cluster_members": spark.createDataFrame([], "project_id string, entity_key string, cluster_key string"), "page_visits": spark.createDataFrame([], shape),
        "feed_snapshots": spark.createDataFrame([], "project_id string, run_id long, feed_url string, domain string, status string, new_entries long"),
        "runs": spark.createDataFrame([(1, "p", datetime(2024, 1, 1)), (2, "p", datetime(2024, 1, 2))], "id long, project_id string, finished_at timestamp"),
    }
    path = str(tmp_path / "runs")
    tables["runs"].write.parquet(path)
    seen = []
    hooks = Hooks(on_cycle=[lambda r, e: seen.append((r, e.count()))], on_change=[lambda r, e: 1 / 0])
    query = watch(spark, spark.readStream.schema(tables["runs"].schema).parquet(path), lambda: tables, "p", str(tmp_path / "cp"), str(tmp_path / "out"), hooks)
    query.awaitTermination(120)
    assert seen == [(2, 1)] and hooks.failures[0][0] == "change"
    line = spark.read.text(str(tmp_path / "out")).first()[0]
    assert '"change_type":"PRICE_DROP"' in line and line.index('"after"') < line.index('"before"') < line.index('"change_type"')


def _cluster_tables(spark):
    at = datetime(2024, 1, 2)
    make = spark.createDataFrame
    return {
        "entity_clusters": make([("p", "c1", "product", "One", at, at, "", None), ("p", "c2", "product", "Two", at, at, "", None), ("p", "c3", "product", "Gone", at, at, "c1", at)],
                                "project_id string, cluster_key string, entity_type string, canonical_title string, first_seen timestamp, last_seen timestamp, merged_into_cluster_key string, merged_at timestamp"),
        "entity_cluster_members": make([("p", "e1", "c1", "gtin_exact", at), ("p", "e2", "c1", "gtin_exact", datetime(2024, 1, 1)), ("p", "e3", "c2", "no_strong_match", at), ("q", "e1", "c2", "other", at)],
                                       "project_id string, entity_key string, cluster_key string, match_reason string, linked_at timestamp"),
        "entities": make([("p", "e1", "A", "u1", "a.example", 1.0, "Acme", "X1"), ("p", "e2", "B", "u2", "b.example", None, "Acme", ""), ("p", "e3", "C", "u3", "", 2.0, None, None)],
                         "project_id string, entity_key string, title string, source_url string, source_domain string, last_price double, brand string, model string"),
        "observations": make([(1, "p", 1, "e1", at), (2, "p", 2, "e1", at), (3, "q", 1, "e2", at)], "id long, project_id string, run_id long, entity_key string, observed_at timestamp"),
        "entity_resolution_events": make([(1, "p", 1, "e1", "new_cluster", "no_candidates", "c1", 0, at), (2, "p", 1, "e3", "deferred_ambiguous", "many", "c2", 2, at), (3, "p", 1, "e2", "created_separate", "identity_conflict", "c3", 1, at), (4, "p", 2, "e3", "created_separate", "other", "c2", 1, at), (5, "p", 2, "e9", "linked", "gtin_exact", "c1", 1, at)],
                                         "id long, project_id string, run_id long, entity_key string, decision string, reason string, selected_cluster_key string, compared_entities long, resolved_at timestamp"),
        "entity_cluster_merge_events": make([], "id long, project_id string, source_cluster_key string, target_cluster_key string, decision string, reason string, source_member_count long, target_member_count long, merged_member_count long, requested_at timestamp"),
    }


def test_cluster_lineage(spark):
    tables = _cluster_tables(spark)
    assert [(r.cluster_key, r.member_count, r.source_count) for r in lineage.clusters(tables, "p").collect()] == [("c1", 2, 2), ("c2", 1, 1)]
    parts = lineage.explain_cluster(tables, "p", "c1")
    one = parts["summary"].first()
    assert (one.status, one.member_count, one.source_count, one.observation_count) == ("active", 2, 2, 2)
    assert [(r.entity_key, r.observation_count) for r in parts["members"].collect()] == [("e2", 0), ("e1", 2)]
    assert sorted((r.signal, r.value, r.first.entity_key) for r in parts["identity_signals"].collect()) == [("brand", "Acme", "e2"), ("model", "X1", "e1")]
    assert [r.id for r in parts["resolution_events"].collect()] == [1, 3, 5]
    assert lineage.explain_cluster(tables, "p", "none")["summary"].collect() == []
    # The conflict chose a cluster that was merged since, so it is no longer open.
    assert [r.event_id for r in lineage.review_queue(tables, "p").collect()] == [2]
    assert lineage.review_queue(tables, "p", "conflict").collect() == []
    with pytest.raises(ValueError):
        lineage.review_queue(tables, "p", "odd")
    assert [r.id for r in lineage.resolution_events(tables["entity_resolution_events"], "p", 2).collect()] == [4, 5]


def test_merge_of_clusters(spark):
    tables = _cluster_tables(spark)
    at = datetime(2024, 2, 1)
    after = lineage.apply_merge(tables, "p", "c2", "c1", ("merged", "explicit_strong_identity_match"), at, 9)
    assert sorted((r.project_id, r.entity_key, r.cluster_key) for r in after["entity_cluster_members"].collect()) == [("p", "e1", "c1"), ("p", "e2", "c1"), ("p", "e3", "c1"), ("q", "e1", "c2")]
    known = {r.cluster_key: r for r in after["entity_clusters"].collect()}
    assert (known["c2"].merged_into_cluster_key, known["c2"].merged_at, known["c1"].last_seen, known["c1"].merged_into_cluster_key) == ("c1", at, at, "")
    audit = lineage.merge_events(after["entity_cluster_merge_events"], "p").first()
    assert (audit.decision, audit.source_member_count, audit.target_member_count, audit.merged_member_count) == ("merged", 1, 2, 3)
    refused = lineage.apply_merge(tables, "p", "c2", "c1", ("rejected", "identity_conflict"), at, 9)
    assert refused["entity_clusters"] is tables["entity_clusters"] and refused["entity_cluster_merge_events"].first().merged_member_count == 0
    fresh, seen = lineage.reobserved(spark.createDataFrame([("e1",), ("e7",)], "entity_key string"), tables, "p", at)
    assert [r.entity_key for r in fresh.collect()] == ["e7"]
    assert {r.cluster_key: r.last_seen for r in seen.collect()}["c1"] == at


def test_stop_reasons(spark):
    base = {"decided": "", "visited": 3, "attempted": 3, "max_pages": 10, "specific_target": False, "mode": "expedition", "candidates_left": 2, "probe_domains": 0, "max_probe_domains": 2, "probe_pages": 0, "max_probe_pages": 5, "occupied": 1, "max_domains": 4, "over_budget": False}
    cases = [({}, "search_candidates_unreached", "resource_limited"), ({"decided": "saturation_reached"}, "saturation_reached", "adaptive_stop"), ({"visited": 10}, "max_pages", "resource_limited"), ({"attempted": 10}, "max_page_attempts", "resource_limited"),
             ({"specific_target": True}, "discovery_exhausted", "specific_target"), ({"candidates_left": 0}, "search_candidates_exhausted", "candidate_pool_exhausted"), ({"max_probe_pages": 0}, "probe_budget_disabled", "resource_limited"),
             ({"probe_domains": 2}, "probe_domain_budget_exhausted", "resource_limited"), ({"probe_pages": 5}, "probe_page_budget_exhausted", "resource_limited"), ({"mode": "discovery"}, "budget_exhausted", "other"), ({"mode": "discovery", "occupied": 4, "over_budget": True}, "max_domains", "resource_limited")]
    rows = spark.createDataFrame([(k, *{**base, **change}.values()) for k, (change, _, _) in enumerate(cases)], ["k", *base])
    reason = lineage.stop_reason({c: F.col(c) for c in base})
    got = rows.select("k", reason.alias("r"), lineage.coverage_status(reason, F.col("specific_target")).alias("s")).orderBy("k").collect()
    assert [(r.r, r.s) for r in got] == [(a, b) for _, a, b in cases]


def test_hit_ranking_keys(spark):
    hits = spark.createDataFrame([("red lamp", "http://a.example/x", "lamp", "", 0), ("red lamp", "http://b.example/red/lamp", "red lamp K9", "broken", 1), ("red lamp", "http://lamp.example/", "a lamp", "K9 red", 2)], "query string, url string, title string, snippet string, provider_index int")
    terms = spark.createDataFrame([("red lamp", "red"), ("red lamp", "lamp")], "query string, term string")
    got = {r.provider_index: r for r in ranking.match_counts(hits, terms, ["K9 lamp"], ["K9"], ["broken"]).collect()}
    counts = lambda r: (r.title_matches, r.path_matches, r.domain_matches, r.target_matches, r.anchor_matches, r.negative_matches)
    assert [counts(got[k]) for k in range(3)] == [(1, 0, 0, 1, 0, 0), (2, 2, 0, 2, 1, 1), (1, 0, 1, 2, 1, 0)]
    none = spark.createDataFrame([], "domain string, status string, productive_runs long, crawl_runs long, is_stale boolean, productive_run_rate double, entity_yield double, success_rate double")
    order = ranking.rank_hits(hits, terms, none, ["broken"], ["K9 lamp"], ["K9"]).orderBy("rank")
    assert [r.provider_index for r in order.collect()] == [2, 1, 0]


def test_command_line(spark, tmp_path, capsys):
    from basaltine import cli

    tables = "/root/testdata/sf0.001"
    shown = lambda *words: (cli.main([*words], spark), capsys.readouterr().out)
    common = ("--project", "demo", "--tables", tables, "--derived")
    assert "product_market: ready" in shown("templates")[1] and "generic_products" in shown("presets")[1]
    path = str(tmp_path / "p.json")
    assert shown("create", "--preset", "generic_products", "--output", path)[0] == 0
    assert "generic_products: ok" in shown("validate", path)[1]
    extra = {"explain": ("--domain", "d5.example"), "explain-cluster": ("--cluster", "c7"), "diff": ("--run-a", "4", "--run-b", "5"), "trace": ("--run", "4"), "merge-clusters": ("--source", "c1", "--target", "c2")}
    for name in cli.REPORTS:
        code, out = shown(name, *common, *extra.get(name, ()))
        assert code == 0 and out.startswith("# "), name
    assert '"decision":"rejected"' in shown("merge-clusters", *common, "--source", "c1", "--target", "c1")[1]


def test_entity_and_feed_writes(spark):
    was, now = datetime(2024, 1, 1), datetime(2024, 2, 1)
    shape = "project_id string, entity_key string, source_url string, title string, last_price double, currency string, first_seen timestamp, last_seen timestamp"
    old = spark.createDataFrame([("p", "k1", "u1", "A", 1.0, "EUR", was, was), ("q", "k9", "u2", "B", 9.0, "EUR", was, was)], shape)
    found = spark.createDataFrame([("s1", "u1", "A", 2.0, "EUR", 1), ("s2", "u2", "B", 3.0, "EUR", 2), ("s3", "u2", "B", 4.0, "USD", 3), ("s1", "u1", "Other", None, None, 4)], "stable_key string, source_url string, title string, last_price double, currency string, arrival long")
    entities, seen = store.upsert_entities(old, found, "p", 7, now)
    got = {(r.project_id, r.entity_key): (r.title, r.last_price, r.first_seen, r.last_seen) for r in entities.collect()}
    assert got == {("p", "k1"): ("A", 2.0, was, now), ("q", "k9"): ("B", 9.0, was, was), ("p", "s2"): ("B", 4.0, now, now), ("p", "s1"): ("Other", None, now, now)}
    assert sorted((r.entity_key, r.price) for r in seen.where("arrival < 4").collect()) == [("k1", 2.0), ("s2", 3.0), ("s2", 4.0)]
    feeds = spark.createDataFrame([("p", "f1", "error", was, was)], "project_id string, feed_url string, status string, first_seen timestamp, last_seen timestamp")
    shots = spark.createDataFrame([("p", 7, "f1", "error", was), ("p", 6, "f1", "error", was)], "project_id string, run_id long, feed_url string, status string, observed_at timestamp")
    states = spark.createDataFrame([("p", "f1", "active"), ("p", "f2", "active")], "project_id string, feed_url string, status string")
    feeds, shots = store.save_feeds(feeds, shots, states, 7, now)
    assert sorted((r.feed_url, r.status, r.first_seen) for r in feeds.collect()) == [("f1", "active", was), ("f2", "active", now)]
    assert sorted((r.run_id, r.feed_url, r.status) for r in shots.collect()) == [(6, "f1", "error"), (7, "f1", "active"), (7, "f2", "active")]


def test_feed_links(spark):
    html = """<link rel="alternate" type="application/rss+xml" href="/comments/feed"><link rel="alternate stylesheet" type="application/atom+xml; charset=utf-8" href="news.atom">
      <link rel="alternate" type="application/rss+xml" href="https://other.example/feed"><link rel="alternate" type="text/html" href="/en"><link rel="alternate" type="application/json" href="/shop/feed.json"><link rel="alternate" type="application/rss+xml" href="/comments/feed#x">"""
    pages = spark.createDataFrame([("https://a.example/shop", html), ("https://b.example/", None)], "url string, html string")
    got = sorted((r.url[8], r.rank, r.feed_url) for r in web.feed_links(pages).collect())
    assert got == [("a", 1, "https://a.example/shop/feed.json"), ("a", 2, "https://a.example/news.atom"), ("a", 3, "https://a.example/comments/feed")]
    probed = [r.feed_url for r in web.feed_links(pages.where("html IS NULL"), probe=True).orderBy("rank").collect()]
    assert len(probed) == 6 and probed[0] == "https://b.example/feed" and "https://b.example/rss.xml" in probed


def test_nested_sitemaps(spark):
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    urls_ = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    a = "https://a.example/"
    rows = [(a + "s.xml", index(a + "t.xml", a + "u.xml", "https://b.example/x.xml")), (a + "t.xml", index(a + "s.xml", a + "v.xml")), (a + "u.xml", urls_(a + "1", "https://b.example/9")), (a + "v.xml", urls_(a + "1", a + "2")), (a + "w.xml", urls_(a + "never"))]
    responses = spark.createDataFrame(rows, "sitemap_url string, body string")
    roots = spark.createDataFrame([(a + "s.xml",)], "sitemap_url string")
    got = sorted((r.place, r.location, r.level) for r in web.site_locations(responses, roots).collect())
    assert got == [(1, a + "1", 1), (2, a + "2", 2)]
    assert web.site_locations(responses, roots, most=1).count() == 1
    with pytest.raises(ValueError):
        web.site_locations(responses, roots, levels=0)
