"""Web documents as rows: products, feeds, sitemaps, search responses.

HTML, XML and JSON have no robust built-in parser in Spark, so these run in
Arrow batches, one output row for each item found.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.urls import absolute_url, host_key, normal_url, safety
from ..session import checkpointed

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Signs and codes of currencies.
CURRENCIES = ("€", "EUR", "USD", "GBP", "CHF", "SEK", "NOK", "DKK", "PLN")
NUMBER = r"\d{1,9}(?:\s\d{3})*(?:[.,]\d{1,2})?"
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/feed+json", "application/json", "application/xml", "text/xml")
IDENTITY = ("brand", "manufacturer", "model", "mpn", "sku", "gtin")


@dataclass
class Node:
    tag: str = ""
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            one = stack.pop()
            if isinstance(one, str):
                parts.append(one)
            elif one.tag not in ("script", "style"):
                stack += reversed(one.children)
        return " ".join(" ".join(parts).split())

    def raw(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node()
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(text: str) -> Node:
    builder = _Builder()
    builder.feed(text or "")
    builder.close()
    return builder.root


def clean(value: object, limit: int = 4000) -> str:
    """Readable text of any value: entities resolved, white space squeezed, cut at ``limit``."""
    if value is None:
        return ""
    text = json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else str(value)
    return " ".join(html.unescape(text).split())[:limit]


def amount(value: object) -> float | None:
    """First number of a text; a space parts groups of three digits, one or two decimals follow '.' or ','."""
    found = re.search(NUMBER, clean(value, 100))
    return round(float("".join(found[0].split()).replace(",", ".")), 2) if found else None


def money(text: str) -> tuple[float, str] | None:
    """An amount with a currency beside it: a sign or code after it, else a code before it."""
    plain = clean(text, 1200)
    after = re.search(rf"(?<!\d)({NUMBER})\s*({'|'.join(CURRENCIES)})", plain, re.I)
    before = None if after else re.search(rf"\b({'|'.join(CURRENCIES[1:])})\s*({NUMBER})(?!\d)", plain, re.I)
    if not after and not before:
        return None
    number, code = (after[1], after[2]) if after else (before[2], before[1])
    return amount(number), "EUR" if code == "€" else code.upper()


class Product(dict):
    """Fields of a product and, for each, where it came from: field -> (value, confidence, note)."""

    def put(self, name: str, value: object, confidence: float, note: str = "") -> None:
        if value not in (None, "", [], {}):
            self[name] = (value, confidence, note)


def _listed(value: object) -> list:
    return value if isinstance(value, list) else [value]


def _first(value: object) -> object:
    return _listed(value)[0] if _listed(value) else None


def _name(value: object) -> str:
    value = _first(value)
    return clean(value.get("name")) if isinstance(value, dict) else clean(value)


def from_json_ld(page: Node, url: str) -> list[Product]:
    out = []
    for script in page.walk():
        if script.tag != "script" or "ld+json" not in script.attrs.get("type", "").lower():
            continue
        try:
            stack = [json.loads(script.raw())]
        except ValueError:
            continue
        while stack:
            item = stack.pop()
            if isinstance(item, list):
                stack += reversed(item)
                continue
            if not isinstance(item, dict):
                continue
            if "product" in [str(t).lower() for t in _listed(item.get("@type"))]:
                p, offer = Product(), _first(item.get("offers"))
                offer = offer if isinstance(offer, dict) else {}
                p.put("title", clean(item.get("name"), 300), 0.98)
                p.put("description", clean(item.get("description"), 2500), 0.98)
                p.put("price", amount(offer.get("price") or offer.get("lowPrice") or item.get("price")), 0.98)
                currency = clean(offer.get("priceCurrency"))
                p.put("currency", currency or "EUR", 0.98 if currency else 0.55, "" if currency else "default:EUR")
                p.put("seller", _name(offer.get("seller")) or _name(item.get("brand")) or _name(item.get("manufacturer")), 0.98)
                image = _first(item.get("image"))
                p.put("image_url", urljoin(url, str(image.get("url") if isinstance(image, dict) else image)) if image else "", 0.98)
                for name in IDENTITY:
                    value = item.get(name) if name != "gtin" else next((item[k] for k in ("gtin14", "gtin13", "gtin12", "gtin8", "gtin", "ean") if item.get(k)), None)
                    p.put(name, _name(value), 0.98)
                if "title" in p:
                    out.append(p)
            stack += [v for v in reversed(list(item.values())) if isinstance(v, (dict, list))]
    return out


def from_microdata(page: Node, url: str) -> list[Product]:
    def value(node: Node) -> str:
        return next((node.attrs[a] for a in ("content", "href", "src", "datetime") if node.attrs.get(a)), None) or node.text()

    def props(scope: Node) -> dict[str, Node]:
        """Properties of the scope and of its offer, not of scopes further in."""
        found: dict[str, Node] = {}
        stack = [c for c in reversed(scope.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            for name in node.attrs.get("itemprop", "").split():
                found.setdefault(name, node)
            if "itemscope" not in node.attrs or "offers" in node.attrs.get("itemprop", "").split():
                stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        return found

    out = []
    for scope in page.walk():
        if "itemscope" in scope.attrs and re.search(r"schema\.org/Product\b", scope.attrs.get("itemtype", ""), re.I):
            p, have = Product(), props(scope)
            named = lambda n: clean((props(have[n])["name"].text() if "itemscope" in have[n].attrs and "name" in props(have[n]) else value(have[n]))) if n in have else ""  # noqa: E731, B023
            p.put("title", named("name")[:300], 0.93)
            p.put("description", named("description"), 0.93)
            p.put("price", amount(value(have["price"])) if "price" in have else None, 0.93)
            currency = named("priceCurrency")
            p.put("currency", currency or "EUR", 0.93 if currency else 0.52, "" if currency else "default:EUR")
            p.put("seller", named("seller"), 0.90)
            p.put("image_url", urljoin(url, value(have["image"])) if "image" in have else "", 0.93)
            for name in IDENTITY:
                p.put(name, named(name) if name != "gtin" else next((named(k) for k in ("gtin14", "gtin13", "gtin12", "gtin8", "gtin") if k in have), ""), 0.93)
            if "title" in p:
                out.append(p)
    return out


def from_open_graph(page: Node, url: str) -> list[Product]:
    meta: dict[str, str] = {}
    for node in page.walk():
        if node.tag == "meta":
            meta.setdefault(node.attrs.get("property") or node.attrs.get("name", ""), clean(node.attrs.get("content"), 1500))
    number = meta.get("product:price:amount") or meta.get("og:price:amount")
    if not meta.get("og:title") or not (number or "product" in meta.get("og:type", "").lower()):
        return []
    p = Product()
    p.put("title", meta["og:title"][:300], 0.88)
    p.put("description", meta.get("og:description"), 0.88)
    p.put("image_url", urljoin(url, meta["og:image"]) if meta.get("og:image") else "", 0.88)
    currency = meta.get("product:price:currency") or meta.get("og:price:currency")
    p.put("price", amount(number), 0.88)
    seen = None if number else money(page.text())
    if seen:
        p.put("price", seen[0], 0.74)
        p.put("currency", seen[1], 0.74)
    elif "price" in p:
        p.put("currency", currency or "EUR", 0.88 if currency else 0.50, "" if currency else "default:EUR")
    return [p]


def from_markup(page: Node, url: str) -> list[Product]:
    """Last resort: one heading, and a price with a currency in a tag marked as price."""
    nodes = list(page.walk())
    title = next((t for n in nodes if n.tag == "h1" and 3 <= len(t := n.text()) <= 300), "")
    marks = lambda n: " ".join(n.attrs.get(a, "") for a in ("id", "class", "data-testid", "data-role", "data-component")).lower()
    seen = next((m for n in nodes if re.search(r"price|cena", marks(n)) and (m := money(n.text()))), None)
    hints = re.search(r"/product|/item|/p/|/shop|/prece", urlsplit(url).path.lower()) or any(re.search(r"product|add-to-cart|buy", marks(n)) for n in nodes)
    if not title or not seen or not hints:
        return []
    p = Product()
    p.put("title", title, 0.72)
    p.put("price", seen[0], 0.68)
    p.put("currency", seen[1], 0.68)
    p.put("description", next((n.attrs.get("content") for n in nodes if n.tag == "meta" and n.attrs.get("name") == "description"), None), 0.62)
    return [p]


_RICHNESS = {"json-ld": 2, "microdata": 1}


def extract(text: str, url: str) -> list[tuple[str, Product]]:
    """Products of a page; the same title in several notations becomes one, the richest leading."""
    page = tree(text)
    found = [(m, p) for m, f in (("json-ld", from_json_ld), ("microdata", from_microdata), ("opengraph", from_open_graph)) for p in f(page, url)]
    found = found or [("dom-fallback", p) for p in from_markup(page, url)]
    rank = lambda m, p: sum(w for f, w in (("price", 2), ("seller", 1), ("description", 2), ("image_url", 1)) if f in p) + _RICHNESS.get(m, 0)
    merged: dict[str, tuple[str, Product]] = {}
    for method, product in found:
        key = " ".join(product["title"][0].casefold().split())
        if key in merged:
            lead, other = (merged[key], (method, product)) if rank(*merged[key]) >= rank(method, product) else ((method, product), merged[key])
            for name, fact in other[1].items():
                lead[1].setdefault(name, fact)
            merged[key] = lead
        else:
            merged[key] = method, product
    return list(merged.values())


_TEXT = T.StringType()
PRODUCTS = T.StructType([T.StructField(n, _TEXT) for n in ("url", "title", "description", "seller", "currency", "image_url", *IDENTITY)] + [
    T.StructField("price", T.DoubleType()), T.StructField("method", _TEXT), T.StructField("confidences", T.MapType(_TEXT, T.DoubleType())), T.StructField("notes", T.MapType(_TEXT, _TEXT))])


def products(pages: DataFrame) -> DataFrame:
    """One row for each product of each page (url, html)."""

    kinds = to_arrow_schema(PRODUCTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, text in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                for method, p in extract(text or "", url or ""):
                    facts = {"confidences": [(k, v[1]) for k, v in p.items()], "notes": [(k, v[2]) for k, v in p.items() if v[2]]}
                    rows.append({"url": url, "method": method} | facts | {k: v[0] for k, v in p.items()})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return pages.select("url", "html").mapInArrow(run, PRODUCTS)


def stable_key(entity_type, url, title):
    """Key of an entity: digest of its type, address and title."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.sha2(F.concat_ws("|", low(entity_type), low(url), low(title)), 256)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def feed_entries(text: str, limit: int = 200) -> tuple[str, list[dict]]:
    """Kind of a feed and its entries, newest as listed; kind 'invalid' if it is none."""
    body = (text or "").strip()
    if body.startswith("{"):
        try:
            items = json.loads(body).get("items")
        except ValueError:
            return "invalid", []
        if not isinstance(items, list):
            return "invalid", []
        rows = [{"entry_id": str(i.get("id") or i.get("url") or ""), "url": str(i.get("url") or i.get("external_url") or ""), "title": clean(i.get("title")), "published": str(i.get("date_published") or ""), "summary": clean(i.get("summary") or i.get("content_text"))} for i in items if isinstance(i, dict)]
        return "jsonfeed", [r for r in rows if r["url"]][:limit]
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        return "invalid", []
    kind = {"rss": "rss", "rdf": "rss", "feed": "atom"}.get(_local(root.tag), "invalid")
    rows = []
    for node in root.iter():
        if _local(node.tag) not in ("item", "entry"):
            continue
        child = {}
        for c in node:
            child.setdefault(_local(c.tag), c)
        get = lambda *names: next((" ".join("".join(child[n].itertext()).split()) for n in names if n in child), "")  # noqa: E731, B023
        link = next((c.get("href") for c in node if _local(c.tag) == "link" and c.get("href") and c.get("rel", "alternate") == "alternate"), None) or get("link")
        if link:
            rows.append({"entry_id": get("guid", "id") or link, "url": link, "title": get("title"), "published": get("pubdate", "published", "updated", "date"), "summary": get("description", "summary", "content")})
    return kind, rows[:limit] if kind != "invalid" else []


ENTRIES = "feed_url string, kind string, position int, entry_id string, url string, title string, published string, summary string"


def feeds(responses: DataFrame, limit: int = 200) -> DataFrame:
    """One row for each entry of each feed response (feed_url, body)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, body in zip(batch["feed_url"], batch["body"]):
                kind, entries = feed_entries(body, limit)
                rows += [{"feed_url": url, "kind": kind, "position": k, **e} for k, e in enumerate(entries)]
            yield pd.DataFrame(rows, columns=["feed_url", "kind", "position", "entry_id", "url", "title", "published", "summary"])

    return responses.select("feed_url", "body").mapInPandas(run, ENTRIES)


#: What a page's markup may call a feed, and where feeds often are (fixed values).
FEED_MIME = ("application/rss+xml", "application/atom+xml", "application/feed+json")
FEED_PATHS = ("/feed", "/rss", "/rss.xml", "/atom.xml", "/feed.xml", "/feed.json")


def feed_candidates(page: str) -> list[str]:
    """Addresses that a page names as its feeds, as written."""
    out = []
    for node in tree(page).walk():
        kind, href = node.attrs.get("type", "").split(";")[0].strip().lower(), node.attrs.get("href", "").strip()
        named = kind in FEED_MIME or (kind == "application/json" and href.lower().endswith((".json", "/feed")))
        if node.tag == "link" and href and named and "alternate" in node.attrs.get("rel", "").lower().split():
            out.append(href)
    return out


def feed_links(pages: DataFrame, probe: bool = False) -> DataFrame:
    """(url, feed_url, rank): feeds of each page (url, html) on its own host, the likeliest first.

    Only pages that hold 'alternate' reach the parser; with ``probe`` usual
    places are candidates too.  A feed under the page's path leads, comment feeds
    come last, equals stay in the order of the page.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, k, h) for u, page in zip(batch["url"], batch["html"]) for k, h in enumerate(feed_candidates(page))]
            yield pd.DataFrame(rows, columns=["url", "place", "href"])

    shape = "url string, place int, href string"
    found = pages.select("url", "html").where(F.col("html").ilike("%alternate%")).mapInPandas(run, shape)
    if probe:
        common = F.array(*[F.lit(p) for p in FEED_PATHS])
        usual = pages.select("url", F.posexplode(common).alias("place", "href")).select("url", (F.col("place") + (1 << 20)).alias("place"), "href")
        found = found.unionByName(usual)
    found = found.withColumn("feed_url", normal_url(absolute_url("url", "href"))).where("feed_url <> ''").where((host_key(F.col("feed_url")) == host_key(F.col("url"))) & (safety(F.col("feed_url"), feed=True) == "ok"))
    path = lambda c: F.coalesce(F.nullif(F.try_parse_url(c, F.lit("PATH")), F.lit("")), F.lit("/"))
    here, there = F.lower(F.regexp_replace(path("url"), "/+$", "")), F.lower(path("feed_url"))
    score = (
        F.when((here != "") & F.startswith(there, F.concat(here, F.lit("/"))), 50).otherwise(0)
        + F.when(F.contains(there, F.lit("feed")) | there.rlike(r"\.(rss|atom|xml)$"), 10).otherwise(0)
        - F.when(F.contains(there, F.lit("/comments/")) | F.contains(there, F.lit("comments/feed")), 100).otherwise(0))
    once = found.withColumn("score", score).groupBy("url", "feed_url").agg(F.min("place").alias("place"), F.first("score").alias("score"))
    return once.select("url", "feed_url", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("score"), "place")).alias("rank"))


def sitemap_locations(text: str, limit: int = 1000) -> tuple[str, list[str]]:
    """urlset, sitemapindex or invalid, and the addresses in it."""
    try:
        root = ElementTree.fromstring((text or "").strip())
    except ElementTree.ParseError:
        return "invalid", []
    kind = _local(root.tag)
    if kind not in ("urlset", "sitemapindex"):
        return "invalid", []
    return kind, [n.text.strip() for n in root.iter() if _local(n.tag) == "loc" and n.text and n.text.strip()][:limit]


def sitemaps(responses: DataFrame, limit: int = 1000) -> DataFrame:
    """One row for each location of each sitemap response (sitemap_url, body)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, kind, k, loc) for u, b in zip(batch["sitemap_url"], batch["body"]) for kind, locs in [sitemap_locations(b, limit)] for k, loc in enumerate(locs)]
            yield pd.DataFrame(rows, columns=["sitemap_url", "kind", "position", "location"])

    return responses.select("sitemap_url", "body").mapInPandas(run, "sitemap_url string, kind string, position int, location string")


def site_locations(responses: DataFrame, roots: DataFrame, most: int = 1000, levels: int = 10) -> DataFrame:
    """Pages that sitemaps lead to, through indexes of indexes: host, location, level, place; at most ``most`` a host.

    ``responses``: sitemap_url, body; ``roots``: sitemap_url.  Each sitemap is
    read once, level by level, and only addresses of its own host count, so a
    cycle ends.  Sitemaps below ``levels`` indexes are refused with an error.
    """
    known = checkpointed(sitemaps(responses.dropDuplicates(["sitemap_url"]), max(most, 1000)).where(host_key(F.col("location")) == host_key(F.col("sitemap_url"))))
    front, seen, out = roots.select("sitemap_url").distinct(), roots.select("sitemap_url").distinct(), None
    for level in range(levels + 1):
        here = known.join(front, "sitemap_url", "left_semi")
        pages = here.where("kind = 'urlset'").select(host_key(F.col("location")).alias("host"), "location", F.lit(level).alias("level"), "sitemap_url", "position")
        out = pages if out is None else out.unionByName(pages)
        front = checkpointed(here.where("kind = 'sitemapindex'").select(F.col("location").alias("sitemap_url")).distinct().join(seen, "sitemap_url", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    else:
        raise ValueError(f"sitemaps are nested more than {levels} deep")
    first = out.groupBy("host", "location").agg(F.min(F.struct("level", "sitemap_url", "position")).alias("at"))
    place = F.row_number().over(Window.partitionBy("host").orderBy("at", "location"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("host", "location", "at.level", "place")


def new_entries(entries: DataFrame, state: DataFrame) -> DataFrame:
    """Entries that come before the last one seen of their feed; all if that is gone and no time is known."""
    joined = entries.join(state.select("feed_url", "last_entry_id", "last_published"), "feed_url", "left")
    marks = joined.where("entry_id = last_entry_id").groupBy("feed_url").agg(F.min("position").alias("mark"))
    rows = joined.join(marks, "feed_url", "left")
    when, last = (F.coalesce(F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss z")), F.expr(f"try_cast({c} AS TIMESTAMP)")) for c in ("published", "last_published"))
    keep = F.when(F.col("mark").isNotNull(), F.col("position") < F.col("mark")).when(last.isNull() | when.isNull(), True).otherwise(when > last)
    return rows.where(keep).select(*entries.columns)


def search_hits(responses: DataFrame, limit: int = 20) -> DataFrame:
    """Hits of JSON search responses (query, body), first place of each address."""
    shape = "struct<results:array<struct<url:string,title:string,content:string,engine:string,score:double>>>"
    rows = responses.select("query", F.posexplode(F.from_json("body", shape)["results"]).alias("position", "hit")).where("hit.url IS NOT NULL AND hit.url <> ''")
    once = rows.groupBy("query", F.col("hit.url").alias("url")).agg(F.min_by("hit", "position").alias("hit"), F.min("position").alias("position"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("position"))
    return once.withColumn("provider_index", place - 1).where(F.col("provider_index") < limit).select("query", "url", F.col("hit.title").alias("title"), F.col("hit.content").alias("snippet"), F.col("hit.engine").alias("engine"), F.col("hit.score").alias("provider_score"), "provider_index")
