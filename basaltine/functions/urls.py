"""URL functions as columns: normal form, host key, safety, relevance."""

from __future__ import annotations

import ipaddress
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Hosts and paths that are never visited.
BLOCKED_HOSTS = ("facebook.com", "instagram.com", "tiktok.com", "youtube.com", "youtu.be", "twitter.com", "x.com", "linkedin.com", "pinterest.com", "google.com", "google.lv", "doubleclick.net")
BLOCKED_PATHS = ("/login", "/logout", "/register", "/registr", "/cart", "/checkout", "/admin", "/account", "/privacy", "/privat", "/terms", "/noteikumi")
STATIC_FILE = r"\.(jpg|jpeg|png|gif|webp|svg|pdf|zip|rar|7z|css|js|xml|mp4|mp3|woff|woff2)$"
TRACKING = ("fbclid", "gclid", "ref")
DOMAIN_REASONS = ("blocked_host", "local_host", "non_public_ip")
ITEM_PATHS = ("/msg/", "/item/", "/listing/")
SHOP_PATHS = ("/product", "/produk", "/katalog", "/shop", "/veikal")


@pandas_udf(T.StringType())
def normal_url(url: pd.Series) -> pd.Series:
    """Comparable form of a web address, '' for other schemes.

    Re-encoding the query as browsers do has no built-in form.
    """

    def one(value: str) -> str:
        try:
            parts = urlsplit(value)
        except ValueError:
            return ""
        if parts.scheme.lower() not in ("http", "https"):
            return ""
        kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in TRACKING and not k.lower().startswith("utm_")]
        path = parts.path or "/"
        while "//" in path:
            path = path.replace("//", "/")
        # Parameters after ';' of the last segment are not part of the page.
        head, slash, last = path.rpartition("/")
        path = head + slash + last.partition(";")[0]
        if len(path) > 1 and path.endswith("/"):
            path = path[:-1]
        query = urlencode(kept)
        return f"{parts.scheme.lower()}://{parts.netloc.lower()}{path}{'?' + query if query else ''}"

    return url.fillna("").map(one)


@pandas_udf(T.StringType())
def absolute_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link as seen from its page."""

    def one(b: str, x: str) -> str:
        try:
            return urljoin(b, x)
        except ValueError:
            return ""

    return pd.Series([one(b or "", x or "") for b, x in zip(base, link)])


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def host_key(url_or_host: Column) -> Column:
    """Lower-case host without outer dots and one leading 'www.'."""
    host = F.when(F.contains(url_or_host, F.lit("://")), host_of(url_or_host)).otherwise(F.lower(url_or_host))
    return F.regexp_replace(F.regexp_replace(F.coalesce(host, F.lit("")), r"^\.+|\.+$", ""), r"^www\.", "")


@pandas_udf(T.BooleanType())
def public_address(host: pd.Series) -> pd.Series:
    """False for literal addresses that are not public, true for all else."""

    def one(value: str) -> bool:
        try:
            ip = ipaddress.ip_address(value.strip("[]"))
        except ValueError:
            return True
        return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)

    return host.fillna("").map(one)


def safety(url: Column, feed: bool = False) -> Column:
    """'ok' or the first reason against visiting a URL.

    Only hosts that look like an address reach the Python check.
    """
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), host_of(url)
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    any_of = lambda tests: tests[0] if len(tests) == 1 else tests[0] | any_of(tests[1:])
    blocked = any_of([(host == b) | host.endswith("." + b) for b in BLOCKED_HOSTS])
    static = path.rlike(STATIC_FILE)
    if feed:
        static = static & ~path.rlike(r"\.(xml|rss|atom)$")
    literal = host.rlike(r"^\[?[0-9a-f:.]+\]?$")
    return (
        F.when(~F.coalesce(scheme.isin("http", "https"), F.lit(False)), "unsupported_scheme").when(host == "", "missing_host")
        .when((host == "localhost") | host.endswith(".local"), "local_host").when(literal & ~public_address(F.when(literal, host).otherwise("")), "non_public_ip")
        .when(blocked, "blocked_host").when(any_of([F.contains(path, F.lit(p)) for p in BLOCKED_PATHS]), "blocked_path")
        .when(static, "binary_or_static_file").otherwise("ok"))


def relevance(url: Column, anchor: Column, keywords: list[str] = (), negative: list[str] = (), required: list[str] = (), target: list[str] = (), anchors: list[str] = ()) -> Column:
    """Priority of a link, -100 to 100, from its address and text."""
    hay = F.lower(F.concat(url, F.lit(" "), F.coalesce(anchor, F.lit(""))))
    clean = lambda words: [w.strip().lower() for w in words if w.strip()]
    points = lambda words, n: sum((F.when(F.contains(hay, F.lit(w)), n).otherwise(0) for w in clean(words)), F.lit(0))
    score = points(keywords, 10) + points(negative, -20) + points(required, 15)
    split = lambda words: sorted({t for w in words for t in "".join(c if c.isalnum() else " " for c in w.casefold()).split()})
    wanted, fixed = split(target), split(anchors)
    if wanted and fixed:
        have = F.array_distinct(F.regexp_extract_all(F.coalesce(F.try_url_decode(hay), hay), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
        lits = lambda words: F.array(*[F.lit(w) for w in words])
        common = lambda words: F.size(F.array_intersect(have, lits(words)))
        score = score + 20 * common(wanted) + 20 * common(fixed) + F.when(common(wanted) == len(wanted), 20).otherwise(0)
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    has = lambda parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(path, p))
    depth = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    score = score + F.when(has(ITEM_PATHS), 35).when(has(SHOP_PATHS), 20).otherwise(0) + F.when(depth >= 2, F.least(depth * 2, F.lit(10))).otherwise(0)
    return F.greatest(F.lit(-100), F.least(score, F.lit(100)))


def links(html: Column) -> Column:
    """Targets of the anchors of a page, in order."""
    return F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*?href=["']([^"']*)["']"""), F.lit(1))
