"""Sharding by extendible hashing.

A document's hash is 60 bits of the md5 of its id; where rows of one id are over
the limit, 60 bits of the md5 of the text follow, and where copies of one text
are, 60 bits each of hashes of the row's place.  The directory is indexed by the
leading bits.  A bucket within the byte limit is a shard; only the others split
on one bit more, until none is over the limit or holds but one document, which
no split can make smaller; that holds for all bits alike, so rows of one id are
counted again at each depth.

The directory is made from a histogram by prefix, ``STEP`` bits at a time: each
round counts only documents of prefixes that are still over the limit, so no
round moves more than 2**STEP cells for each of these.

Defined results: a null or empty text has 0 bytes; a null id hashes as the
empty string; rows that share an id (copies of a row, at worst a third of the
table) are split by the bits of their texts and places; an empty table gives an
empty result; a document longer than the limit is a shard of its own at the depth
that parts it from its neighbours.  Only doc_id and text are read, further
columns pass through ``sharded`` unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import stored

#: Bytes that a shard may hold.
LIMIT = 16 << 20
STEP = 8
BITS = 60


def _bits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        _bits(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("hash"), F.col("text").alias("_text"),
    )


def _prefix(hashed: Column, depth: int) -> Column:
    return F.shiftright(hashed, BITS - depth)


def directory(rows: DataFrame, limit: int, first: int, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The directory (depth, cell, shard_depth) of all rows (hash, n_bytes), and oversized 60-bit cells.

    A row belongs to the entry whose cell equals its first ``depth`` bits.  Rows
    that differ in ``keys`` are never in one bucket; both results hold the keys.
    """
    parts, depth, floor, open_cells = [], min(first, BITS), 0, None
    while True:
        part = rows.groupBy(*keys, _prefix(F.col("hash"), depth).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
        found = stored(part, f"directory-{depth}")
        lone = (F.col("n_bytes") > limit) & (F.col("n") > 1)
        # From the root down, the first depth at which a bucket fits.
        fits = []
        for d in range(floor, depth + 1):
            at = F.shiftright("cell", depth - d)
            fits.append(found.groupBy(*keys, at.alias("bucket")).agg(F.sum("n_bytes").alias("b"), F.sum("n").alias("n"))
                        .where((F.col("b") <= limit) | (F.col("n") == 1)).select(F.lit(d).alias("d"), *keys, "bucket"))
        leaf = None
        for d, fit in zip(range(floor, depth + 1), fits):
            hit = found.select(*keys, "cell", F.shiftright("cell", depth - d).alias("bucket")).join(fit, [*keys, "bucket"]).select(*keys, "cell", "d")
            leaf = hit if leaf is None else leaf.unionByName(hit)
        leaves = leaf.groupBy(*keys, "cell").agg(F.min("d").alias("shard_depth"))
        parts.append(leaves.select(F.lit(depth).alias("depth"), *keys, "cell", "shard_depth"))
        open_cells = found.where(lone).select(*keys, "cell")
        if depth == BITS or open_cells.isEmpty():
            return reduce(DataFrame.unionByName, parts), open_cells
        rows = _within(rows, open_cells, depth, keys)
        floor, depth = depth + 1, min(depth + STEP, BITS)


def _within(rows: DataFrame, cells: DataFrame, depth: int, keys: tuple[str, ...]) -> DataFrame:
    """The rows whose first ``depth`` bits are one of the cells."""
    return rows.withColumn("_cell", _prefix(F.col("hash"), depth)).join(cells.withColumnRenamed("cell", "_cell"), [*keys, "_cell"], "left_semi").drop("_cell")


def assign(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard_depth and shard (its bits) of every document."""
    return _assigned(_keyed(documents), limit).select("doc_id", "n_bytes", "shard_depth", "shard")


def _assigned(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` without _text, with shard_depth and shard.

    Each level has 60 bits of its own: of the id, of the text, then of the place
    as often as needed.  Only rows of oversized cells go on to the next level.
    """
    bits = lambda h, d: F.expr(f"lpad(substring(lpad(conv({h}, 10, 2), {BITS}, '0'), 1, {d}), {d}, '0')")
    columns, out, level, keys = [c for c in rows.columns if c != "_text"], None, 0, ()
    rows = rows.withColumn("_group", F.lit(""))
    while True:
        counted = rows.select(*keys, "hash", "n_bytes")
        if level:
            counted = stored(counted, "same")
        total = counted.groupBy(*keys).agg(F.sum("n_bytes").alias("b")).agg(F.max("b")).first()[0] or 0
        first = max(1, (max(1, total // limit) - 1).bit_length() + 4)
        book, stuck = directory(counted, limit, first, keys)
        book = stored(book, "directory")
        depths = [r[0] for r in book.select("depth").distinct().orderBy("depth").collect()]  # at most 60 / STEP numbers
        for depth in depths:
            entry = book.where(F.col("depth") == depth).select(*keys, "cell", "shard_depth")
            hit = rows.withColumn("cell", _prefix(F.col("hash"), depth)).join(entry, [*keys, "cell"])
            hit = hit.withColumns({"shard": F.concat("_group", bits("hash", "shard_depth")), "shard_depth": F.col("shard_depth") + BITS * level}).select(*columns, "shard_depth", "shard")
            out = hit if out is None else out.unionByName(hit)
        if stuck.isEmpty():
            return rows.select(*columns, F.lit(0).alias("shard_depth"), F.lit("").alias("shard")).limit(0) if out is None else out
        rows = _within(rows, stuck, BITS, keys).withColumn("_group", F.concat("_group", bits("hash", "60")))
        level, keys = level + 1, ("_group",)
        if level == 1:
            rows = rows.withColumn("hash", _bits(F.coalesce("_text", F.lit("")))).drop("_text")
            continue
        if level == 2:  # copies of one row: their places are written, so that all later reads see the same
            rows = stored(rows.withColumn("_place", F.monotonically_increasing_id()), "copies")
        rows = rows.withColumn("hash", _bits(F.concat_ws(":", "_place", F.lit(level))))


def sharded(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Every column of ``documents`` with its shard, texts staying where they are read if the directory is small."""
    rows = documents.withColumns({"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "hash": _bits(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "_text": F.col("text")})
    return _assigned(rows, limit).select(*documents.columns, "n_bytes", "shard_depth", "shard")


def oracle(limit: int = LIMIT) -> str:
    """The same rows in SQL, for tables without repeated ids."""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents),
p AS (SELECT k, hash >> (60 - k) AS bucket FROM d, range(0, 61) AS r(k)),
x AS (SELECT k, hash >> (60 - k) AS bucket, sum(n_bytes) AS b, count(*) AS n FROM d, range(0, 61) AS r(k) GROUP BY ALL),
l AS (SELECT k, bucket FROM x WHERE b <= {limit} OR n = 1),
m AS (SELECT d.hash, min(l.k) AS shard_depth FROM (SELECT DISTINCT hash FROM d) d, l WHERE d.hash >> (60 - l.k) = l.bucket GROUP BY ALL)
SELECT doc_id, n_bytes, shard_depth::INTEGER AS shard_depth,
  substr(lpad(bin(hash), 60, '0'), 1, shard_depth::INTEGER) AS shard
FROM d JOIN m USING (hash)
"""
