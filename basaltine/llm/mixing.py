"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source has the same number f of expected copies, the
source's target over its size.  Documents are put into one fixed order within
their source, expected copies are prefix-summed along it, one offset in [0, 1)
is added, and a document is taken once for each integer boundary that its
interval crosses.  The order is by size, then by hashed id, so that every size
class is sampled evenly.  Of ``OFFSETS`` hashed offsets, evenly spaced, a source
uses the one whose words come nearest its target; that is known from the counts
by size alone.

No source is ever sorted in one task.  A row's rank is the sum of three
counts: rows of smaller sizes in its source, rows in earlier hash ranges of its
size, and its place within its own range; only the last one touches documents,
and a range holds about ``RANGE_ROWS`` rows whatever the size of the source.

Defined results: a null or empty text has size 0; a null source is a source of
its own, last in order; a source of size 0 has target 0 and is never taken; an
empty table gives an empty result; repeated rows are separate documents that
share an id, those of one size in order of their texts' md5.  Only the named
columns are read, so further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 20_000
SHARE = 1.5
CAP = 2
WEIGHTS = (5, 2, 1)
OFFSETS = 32
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _unit(text: Column) -> Column:
    """A long of 32 bits from the md5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Words to take from each source, from a table (no_source, src, source_size) of one row a source.

    Capped sources are those whose cap to weight ratio lies below the level
    that the others reach, so one pass in order of that ratio gives the same
    targets as handing the excess out again and again.
    """
    rank = Window.orderBy("no_source", "src")
    weighted = sizes.withColumn("place", F.row_number().over(rank) % len(WEIGHTS)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.when(F.col("place") == 0, len(WEIGHTS)).otherwise(F.col("place")).cast("int"))
    ).withColumn("cap", F.col("source_size") * CAP)
    # Taking a capped source out raises the level of the rest, taking another one
    # out lowers it, so the level sought is the highest of them.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (
        weighted.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(order), F.lit(0)))
        .withColumn("weights_before", F.coalesce(F.sum("weight").over(order), F.lit(0)))
        .withColumn("level", (F.col("total") * F.lit(SHARE) - F.col("caps_before")) / (F.col("weights") - F.col("weights_before")))
        .withColumn("open_level", F.max("level").over(every))
    )
    target = F.least(F.col("cap").cast("double"), F.col("open_level") * F.col("weight"))
    return level.select("no_source", "src", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def copies(documents: DataFrame, ranges: int | None = None, whole: bool = False) -> DataFrame:
    """doc_id, size, source, source_size, target and copies of every document, and with ``whole`` the row itself."""
    row = [F.struct(*documents.columns).alias("row"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie")] if whole else []
    rows = documents.select(
        *row, "doc_id", "source", words(F.col("text")).alias("size"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"),
        _unit(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("unit"),
    )
    if ranges is None:
        ranges = max(1, -(-documents.count() // RANGE_ROWS))
    rows = rows.withColumn("part", F.floor(F.col("unit") * ranges / F.lit(float(1 << 32))).cast("long"))
    group = ["no_source", "src", "size", "part"]
    counts = rows.groupBy(*group).agg(F.count("*").alias("n"))
    by_size = counts.groupBy("no_source", "src", "size").agg(F.sum("n").alias("n_size"))
    source = by_size.groupBy("no_source", "src").agg(F.sum(F.col("n_size") * F.col("size")).alias("source_size"))
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = by_size.withColumn("before_size", F.coalesce(F.sum("n_size").over(earlier(["no_source", "src"], "size")), F.lit(0)))
    parts = counts.withColumn("before_part", F.coalesce(F.sum("n").over(earlier(["no_source", "src", "size"], "part")), F.lit(0))).drop("n")
    wanted = targets(source).withColumn("f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    hashed = _unit(F.concat(F.lit("mix:"), F.col("src"))) / F.lit(float(1 << 32))
    offset = lambda j: (hashed + F.lit(j / OFFSETS)) - F.floor(hashed + F.lit(j / OFFSETS))
    crossings = lambda end, f, u: F.floor(end * f + u)
    at = sizes.join(wanted, ["no_source", "src"])
    sums = [F.sum(F.col("size") * (crossings(F.col("before_size") + F.col("n_size"), F.col("f"), offset(j)) - crossings(F.col("before_size"), F.col("f"), offset(j)))).alias(f"w{j}") for j in range(OFFSETS)]
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{j}") - F.col("target")).alias("off_by"), F.lit(j).alias("j"), offset(j).alias("offset")) for j in range(OFFSETS)]))
    chosen = at.groupBy("no_source", "src", "source_size", "target", "f").agg(*sums).select("no_source", "src", "source_size", "target", "f", nearest["offset"].alias("offset"))
    start = parts.join(sizes.drop("n_size"), ["no_source", "src", "size"]).join(chosen, ["no_source", "src"]).select(
        *group, (F.col("before_part") + F.col("before_size")).alias("before"), "source_size", "target", "f", "offset")
    place = F.row_number().over(Window.partitionBy(*group).orderBy("unit", "doc_id", *(["tie"] if whole else [])))
    rank = F.col("before") + F.col("place")
    crossed = F.floor(rank * F.col("f") + F.col("offset")) - F.floor((rank - 1) * F.col("f") + F.col("offset"))
    return rows.withColumn("place", place).join(start, group).select("doc_id", "size", "source", "source_size", "target", crossed.cast("long").alias("copies"), *(["row"] if whole else []))


def mix(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document."""
    return copies(documents).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(documents: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns unchanged.

    Rows move once, to their range, and are repeated where they are ranked.
    """
    taken = copies(documents, whole=True).where("copies > 0")
    return taken.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, source IS NULL AS no_source, coalesce(source, '') AS src,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS unit
  FROM documents),
s AS (SELECT no_source, src, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, source_size * 2 AS cap, CASE row_number() OVER (ORDER BY no_source, src) % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, no_source, src) AS k FROM w),
l AS (SELECT a.*, ((SELECT sum(source_size) FROM w) * 1.5::DOUBLE - coalesce((SELECT sum(cap) FROM o b WHERE b.k < a.k), 0))
      / ((SELECT sum(weight) FROM w) - coalesce((SELECT sum(weight) FROM o b WHERE b.k < a.k), 0))::DOUBLE AS level FROM o a),
t AS (SELECT no_source, src, source_size,
      greatest(0.0, least(cap::DOUBLE, (SELECT max(level) FROM l) * weight)) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
      CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS f,
      d.no_source, d.src, row_number() OVER (PARTITION BY d.no_source, d.src ORDER BY d.size, d.unit, d.doc_id) AS i
    FROM d JOIN t USING (no_source, src)),
h AS (SELECT no_source, src, target, ('0x' || substr(md5('mix:' || src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS hashed FROM t),
c AS (SELECT no_source, src, target, j, hashed + j / 32.0::DOUBLE - floor(hashed + j / 32.0::DOUBLE) AS u FROM h, range(0, 32) AS g(j)),
e AS (SELECT no_source, src, c.j, c.u, abs(sum(size * (floor(i * f + u) - floor((i - 1) * f + u))) - any_value(c.target)) AS off_by
      FROM r JOIN c USING (no_source, src) GROUP BY ALL),
b AS (SELECT no_source, src, arg_min(u, (off_by, j)) AS u FROM e GROUP BY ALL)
SELECT doc_id, size, source_size, target,
  ((floor(i * f + u) - floor((i - 1) * f + u)) * size)::BIGINT AS taken
FROM r JOIN b USING (no_source, src)
"""
