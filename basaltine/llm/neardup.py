"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct 5-word shingles (A-Z lowered,
words parted by ASCII white space; fewer words give the whole sequence as one
shingle).  Its sketch is the ``K`` smallest of them.

1. Equal sets, by a 128-bit fingerprint, become one representative.
2. Inverted lists of retained values generate overlaps.  Two sets of Jaccard
   similarity 0.75 share at least ``SHARED`` retained values (a binomial bound,
   missed with a chance under 1e-7; for sets of up to 3/4 K it is exact), so
   only the K - SHARED + 1 rarest values of a sketch need a list: values that
   are common to many documents have none.  Rarity comes from a fixed number of
   counters; any fixed order of values is right, this one keeps lists short.
3. In each list every member is compared with the list's first one; members
   that this leaves in different components are then compared with each other,
   in cells of two blocks of documents.
   A list of two has no such pair.
4. Pairs pass the union-sketch estimate, first on signatures (``SIGNED`` values
   of 32 bits each), then the exact test on full sets, 100 * intersection >=
   75 * union.  Unrelated documents share a value by chance, the more of them
   the larger the table is, so texts move only for pairs whose signatures agree.
5. Components come from alternating star contractions.

Lists are never gathered: rows sorted by (value, document) are range-dealt, so
a value held by a third of all documents spans many tasks, each keeping only
the first member it saw.  Copies never become pairs.

Defined results: a null or empty text, or one of white space, has an empty set
and is linked with nothing (component_id is its doc_id, kept is true); a row
with a null doc_id is linked with nothing, its component_id is null and it is
kept; rows that share a doc_id are one document, and a link of one of them is a
link of all; repeated rows therefore appear as often as they came, with one
component (``keep_one`` leaves one row for each different text of a kept id);
an empty table gives an empty result.  Only doc_id and text are
read; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import LOWER, discard, mix, shingle_hashes, slices, span_hashes, stored, word_bounds

SIZE = 5
PERCENT = 75
K = 128
SHARED = 64
COUNTERS = 1 << 22
BLOCK = 64
FILTER_BITS = 26
#: Two sets of Jaccard similarity 0.75 agree in fewer than AGREE of SIGNED values with a chance under 1e-9.
SIGNED = 32
AGREE = 8
#: A document with more links than HUB_ROWS and than one in HUBS of all links is a hub.
HUB_ROWS = 256
HUBS = 1000


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the action that wrote them ends.

    Else they stay until the driver happens to collect its garbage, and those
    of all steps may stand on the disks at once.  No step here runs one plan
    twice: each stores its result, and the next one reads that.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a slice."""
    low = LOWER[data]
    starts, ends, first = word_bounds(low, off)
    hashes, doc = shingle_hashes(span_hashes(low, starts, ends), first, SIZE)
    cut = np.searchsorted(doc, np.arange(len(off)))
    out = []
    for k in range(len(off) - 1):
        v = np.sort(hashes[cut[k] : cut[k + 1]])
        out.append(v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v)
    return out


_SALT = np.uint64(0x9FB21C651E98DF25)


def _fingerprint(v: np.ndarray) -> tuple[int, int]:
    if not len(v):
        return 0, 0
    return int(np.add.reduce(mix(v + _SALT)).astype(np.int64)), int(np.bitwise_xor.reduce(mix(v ^ _SALT)).astype(np.int64))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "fa", "fb", "sketch"]
    for batch in batches:
        for lo, hi, data, off in slices(batch.column("text")):
            every = sets(data, off)
            prints = [_fingerprint(v) for v in every]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array([len(v) for v in every], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                 pa.array([v[:K].tobytes() for v in every], pa.binary())], names)


def sketched(documents: DataFrame) -> DataFrame:
    """doc_id, set size n, fingerprint (fa, fb) and sketch of every document."""
    return documents.select("doc_id", "text").mapInArrow(_sketches, f"doc_id {dict(documents.dtypes)['doc_id']}, n long, fa long, fb long, sketch binary")


def _counter(v: np.ndarray) -> np.ndarray:
    return (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 22)


_PARTS = 64


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for blob in batch.column("sketch").to_pylist():
            np.add.at(total, _counter(np.frombuffer(blob, np.uint64)), 1)
    step = COUNTERS // _PARTS
    for p in range(_PARTS):
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([total[p * step : (p + 1) * step].tobytes()], pa.binary())], ["part", "counts"])


def _add_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist())
    return pa.table({"part": [key[0].as_py()], "counts": [np.minimum(np.frexp(total.astype(float))[1], 100).astype(np.uint8).tobytes()]}, schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))


def rarity(reps: DataFrame) -> np.ndarray:
    """For each counter, the bit length of how often values that fall on it are retained: 4 MB."""
    tasks = max(1, min(64, reps.rdd.getNumPartitions()))
    rows = reps.select("sketch").coalesce(tasks).mapInArrow(_count, "part int, counts binary").groupBy("part").applyInArrow(_add_up, "part int, counts binary").collect()
    return np.concatenate([np.frombuffer(bytes(r["counts"]), np.uint8) for r in sorted(rows, key=lambda r: r["part"])]) if rows else np.zeros(COUNTERS, np.uint8)


def listed(reps: DataFrame, classes: np.ndarray) -> DataFrame:
    """(value, doc): the values of each sketch that have a list."""
    shared = reps.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            values, docs, sizes = [], [], []
            for doc, n, blob in zip(batch.column("doc").to_pylist(), batch.column("n").to_pylist(), batch.column("sketch").to_pylist()):
                v = np.frombuffer(blob, np.uint64)
                shared_least = -(-PERCENT * n // 100) if 100 * n <= PERCENT * K else SHARED
                take = len(v) - shared_least + 1
                if take < len(v):
                    v = v[np.lexsort((v, rank[_counter(v)]))[:take]]
                values.append(v.view(np.int64))
                docs.append(np.full(len(v), doc, np.int64))
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), pa.array(np.concatenate(docs))], ["value", "doc"])

    return reps.select("doc", "n", "sketch").mapInArrow(run, "value long, doc long")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, head, doc) for sorted rows: each later member of a list with the first one of its task.

    ``doc`` is null for the first and the last list of the task, whose rest may lie in other tasks.
    """
    names = ["value", "head", "doc"]
    make = lambda v, h, d: pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(h, pa.int64()), pa.array(d, pa.int64())], names)
    value = head = None
    for batch in batches:
        if not batch.num_rows:
            continue
        v, d = batch.column("value").to_numpy(), batch.column("doc").to_numpy()
        if value is None:
            value, head = int(v[0]), int(d[0])
            yield make([value], [head], [None])
        fresh = np.ones(len(v), bool)
        fresh[1:] = v[1:] != v[:-1]
        fresh[0] = int(v[0]) != value
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(v)), -1))
        heads = np.where(at < 0, head, d[np.maximum(at, 0)])
        value, head = int(v[-1]), int(heads[-1])
        pair = heads != d
        if pair.any():
            yield make(v[pair], heads[pair], d[pair])
    if value is not None:
        yield make([value], [head], [None])


def star_pairs(lists: DataFrame) -> DataFrame:
    """(value, head, doc) such that each list of two or more is connected."""
    dealt = lists.repartitionByRange("value", "doc").sortWithinPartitions("value", "doc")
    rows = stored(dealt.mapInArrow(_stars, "value long, head long, doc long"), "stars")
    ends = rows.where("doc IS NULL").select("value", "head").distinct()  # two rows a task at most
    firsts = ends.groupBy("value").agg(F.min("head").alias("first"))
    stitched = ends.join(firsts, "value").where("head <> first").select("value", F.col("first").alias("head"), F.col("head").alias("doc"))
    return rows.where("doc IS NOT NULL").unionByName(stitched)


def bit_filter(ids: DataFrame) -> np.ndarray:
    """Bits of hashed ids, 2**FILTER_BITS of them whatever the number of ids."""
    at = F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS))
    words = ids.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(doc), {1 << FILTER_BITS}), 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out


def packed_texts(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, text) of the documents among ``ids``, compressed; a few others may come along.

    A fixed-size bit filter keeps most other documents out of the shuffle; the
    joins that follow look up ids, so those that it lets through do no harm.
    """
    shared = documents.sparkSession.sparkContext.broadcast(bit_filter(ids).view(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            blobs = [pa.compress(t.as_buffer() or b"", codec="zstd", asbytes=True) for t in batch.column("text").fill_null("")]
            sizes = pa.array([t.as_buffer().size for t in batch.column("text").fill_null("")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), sizes, pa.array(blobs, pa.binary())], ["doc", "size", "text"])

    rows = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), "text")
    rows = rows.withColumn("at", F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS)))
    return rows.mapInArrow(run, "doc long, size long, text binary").distinct()


def signed(reps: DataFrame) -> DataFrame:
    """(doc, n, sig): the high halves of the SIGNED smallest hashes of each set, sorted and distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [np.unique((np.frombuffer(b, np.uint64)[:SIGNED] >> np.uint64(32)).astype(np.uint32)).tobytes() for b in batch.column("sketch").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("n"), pa.array(sigs, pa.binary())], ["doc", "n", "sig"])

    return reps.select("doc", "n", "sketch").mapInArrow(run, "doc long, n long, sig binary")


def akin(na: int, a: bytes, nb: int, b: bytes) -> bool:
    """Whether set sizes and signatures leave it open that two sets are similar."""
    if 100 * min(na, nb) < PERCENT * max(na, nb):
        return False
    both = np.sort(np.concatenate([np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)]))
    twice = np.concatenate([[False], both[1:] == both[:-1]])
    ends = np.flatnonzero(~twice)[:SIGNED]
    return SIGNED * int((twice & (both <= both[ends[-1]])).sum()) >= AGREE * len(ends)


def _akin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [akin(*row) for row in zip(*[batch.column(c).to_pylist() for c in ("na", "sa", "nb", "sb")])]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def akin_pairs(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose signatures agree."""
    side = lambda x: signatures.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "na", "sa", "b", "nb", "sb").mapInArrow(_akin, "a long, b long").distinct()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test, after the sizes and the union-sketch estimate allow it."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    if len(a) > K and len(b) > K:
        both = np.sort(np.concatenate([a[:K], b[:K]]))
        twice = both[1:] == both[:-1]
        union_end = np.flatnonzero(np.concatenate([[True], ~twice]))
        last = both[union_end[K - 1]]
        estimate = int((twice & (both[1:] <= last)).sum()) / K
        if estimate < PERCENT / 100 - 0.25:
            return False
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: dict[str, tuple[int, bytes, np.ndarray]] = {}

    def unpacked(side: str, doc: int, size: int, blob: bytes) -> np.ndarray:
        seen = last.get(side)
        if seen is None or seen[0] != doc or seen[1] != blob:
            data = np.frombuffer(pa.decompress(blob, size, codec="zstd", asbytes=True), np.uint8)
            last[side] = doc, blob, sets(data, np.array([0, size]))[0]
        return last[side][2]

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("a", "sa", "ta", "b", "sb", "tb")]
        keep = [similar(unpacked("a", a, sa, ta), unpacked("b", b, sb, tb)) for a, sa, ta, b, sb, tb in zip(*cols)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    side = lambda x: texts.select(F.col("doc").alias(x), F.col("size").alias(f"s{x}"), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "sa", "ta", "b", "sb", "tb").mapInArrow(_verify, "a long, b long")


def _beside(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """(u, v, m): the rows (u, v) with the m of their u in ``least`` (u, m, n), n being u's number of rows.

    Hubs, the u of more than a ``1 / HUBS`` part of all edges, do not meet in
    one task: there are at most 2 * HUBS of them, so they are broadcast, and
    their rows stay where they are.
    """
    limit = F.lit(max(HUB_ROWS, edges // HUBS))
    hubs = F.broadcast(least.where(F.col("n") > limit).select("u", F.col("m").alias("hub")))
    marked = rows.join(hubs, "u", "left")
    others = marked.where("hub IS NULL").select("u", "v").join(least.where(F.col("n") <= limit).select("u", "m"), "u")
    return others.unionByName(marked.where("hub IS NOT NULL").select("u", "v", F.col("hub").alias("m")))


def components(links: DataFrame) -> DataFrame:
    """(doc, component): the smallest document that each linked one reaches."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    many, before = edges.count(), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = stored(_beside(both, least, many).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _beside(large, least, many).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = stored(small.distinct(), "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(large, edges)
        edges, many = after, now[0]
        if before == now:
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("component"))
        before = now


def groups(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``documents``."""
    with released(documents.sparkSession):
        every = sketched(documents)
        # Sketches are made again for the representatives rather than kept for all.
        rows = stored(every.drop("sketch"), "fingerprints")
        one = every.where("n > 0 AND doc_id IS NOT NULL").groupBy("fa", "fb", "n").agg(F.min(F.struct(F.col("doc_id").cast("long").alias("doc"), "sketch")).alias("r"))
        sketches = stored(one.select("fa", "fb", "n", "r.doc", "r.sketch"), "representatives")
        reps = stored(sketches.drop("sketch"), "representatives")
        links = similar_pairs(documents, sketches)
        # Rows of one id are one document: their representatives are linked.
        ids = rows.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "fa", "fb", "n").join(reps.select("fa", "fb", "n", "doc"), ["fa", "fb", "n"])
        same = ids.where("doc_id <> doc").select(F.col("doc_id").cast("long").alias("a"), F.col("doc").alias("b"))
        found = components(links.unionByName(same))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(found, F.col("doc_id").cast("long") == F.col("doc"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", F.col("doc_id").cast("long"))).otherwise(F.col("doc_id").cast("long"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that lead their group, columns unchanged.

    The ids to drop are the smaller side, and their rows go where they are: a
    filter of fixed size finds them, and a second one those that the first lets
    through by chance, so only rows of these few and of repeated ids move.  Of
    the rows of a kept id one stays for each different text: rows of one id
    that differ in further columns only are repeats, of which the first in
    order of these columns stays.
    """
    with released(documents.sparkSession):
        found = stored(groups(documents), "groups")
        gone = found.where(~F.col("kept")).select(F.col("doc_id").cast("long").alias("doc")).distinct()
        again = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").cast("long").alias("doc"))
        ids = stored(gone.withColumn("keep", F.lit(False)).unionByName(again.withColumn("keep", F.lit(True))), "decided")
        decided = bit_filter(ids.select("doc"))
        chance = _split(found.select("doc_id"), decided)[0].select(F.col("doc_id").cast("long").alias("doc")).distinct().join(ids, "doc", "left_anti")
        unsettled = bit_filter(stored(chance.unionByName(ids.where("keep").select("doc")), "unsettled"))
        none_again = ids.where("keep").isEmpty()
    maybe, others = _split(documents, decided, unsettled)
    judged = maybe.join(ids.select(F.col("doc").alias("__doc"), F.col("keep").alias("__keep")), F.col("doc_id") == F.col("__doc"), "left")
    single = judged.where("__keep IS NULL").select(*documents.columns)
    out = others.unionByName(single)
    if none_again:
        return out
    rows = judged.where("__keep").select("doc_id", "text", F.struct(*documents.columns).alias("row"))
    once = rows.groupBy("doc_id", "text").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return out.unionByName(once)


def _split(documents: DataFrame, *filters: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Rows whose ids all ``filters`` let through, and those that the first one stops; only the former need a join."""
    shared = documents.sparkSession.sparkContext.broadcast([f.view(np.uint8) for f in filters])
    rows = documents.withColumn("__at", F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << FILTER_BITS))))

    def side(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column("__at").fill_null(0).to_numpy()
                none = batch.column("__at").is_null().to_numpy(zero_copy_only=False)
                hits = [((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1) & ~none for bits in shared.value]
                kept = batch.drop_columns(["__at"]).filter(pa.array(np.logical_and.reduce(hits) if wanted else ~hits[0]))
                if kept.num_rows:
                    yield kept

        return run

    return tuple(rows.mapInArrow(side(w), documents.schema) for w in (True, False))


def similar_pairs(documents: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between representatives that give the components of all links.

    ``reps`` (stored, with sketches) is deleted once its lists are made.
    """
    stars = star_pairs(listed(reps, rarity(reps)))
    signatures = stored(signed(reps), "signatures")
    discard(reps)
    pairs = stored(akin_pairs(stars.select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct(), signatures), "pairs")
    ids = stored(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "ids")
    texts = stored(packed_texts(documents, ids), "texts")
    first = stored(verified(pairs, texts), "links")
    discard(texts)
    near = stored(candidates_apart(stars, first, signatures), "candidates")
    discard(stars, signatures)
    texts = stored(packed_texts(documents, near.select("doc").distinct()), "texts")
    second = stored(links_apart(near, texts), "links")
    discard(texts, near)
    return first.unionByName(second)


def candidates_apart(stars: DataFrame, links: DataFrame, signatures: DataFrame) -> DataFrame:
    """(b1, b2, doc, component, others): members of one list that the links so far leave in different components.

    Members are put into blocks of about ``BLOCK`` by the list head that they
    share most often.  A cell is two blocks that meet in some list; it brings
    their signatures together once, and compares the members of common lists
    there.  ``others`` are the documents of the cell that agree with ``doc``
    (each two are named once).  A list of two is left out: its members, one of
    them the head, have been compared.
    """
    part = components(links)
    three = stars.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    stars = stars.join(three, "value")
    heads = stars.unionByName(stars.select("value", "head", F.col("head").alias("doc"))).distinct()
    named = heads.join(part, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    apart = named.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value")
    left = stored(named.join(apart, "value"), "apart")
    home = left.groupBy("doc", "component", "head").agg(F.count("*").alias("n")).groupBy("doc", "component").agg(F.max_by("head", F.struct("n", -F.col("head"))).alias("head"))
    blocks = home.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = stored(home.join(blocks, "head").select("doc", "component", F.xxhash64("head", F.pmod(F.xxhash64("doc"), F.col("blocks"))).alias("block")), "blocks")
    met = left.select("value", "doc").distinct().join(placed.select("doc", "block"), "doc").select("value", "block").distinct()
    x, y = met.withColumnRenamed("block", "b1"), met.withColumnRenamed("block", "b2")
    cells = x.join(y, "value").where("b1 <= b2").select("b1", "b2").distinct()
    sides = cells.select("b1", "b2", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("block"))
    values = left.groupBy("doc").agg(F.collect_set("value").alias("values"))  # at most K
    rows = placed.join(values, "doc").join(signatures, "doc")
    dealt = sides.join(rows, "block").repartition("b1", "b2").sortWithinPartitions("b1", "b2")
    return dealt.select("b1", "b2", "block", "doc", "component", "values", "n", "sig").mapInArrow(_near_cells, "b1 long, b2 long, doc long, component long, others array<long>")


def links_apart(near: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among the candidates of each cell; texts of a cell come together once, so pairs are never rows."""
    dealt = near.join(texts, "doc").repartition("b1", "b2").sortWithinPartitions("b1", "b2")
    return dealt.select("b1", "b2", "doc", "component", "others", "size", "text").mapInArrow(_cells, "a long, b long")


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[list]]]:
    """Each cell (b1, b2) of sorted rows with the further columns of its rows."""
    key, rows = None, []
    for batch in batches:
        for b1, b2, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if (b1, b2) != key:
                if rows:
                    yield key, rows
                key, rows = (b1, b2), []
            rows.append(row)
    if rows:
        yield key, rows


def _near_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["b1", "b2", "doc", "component", "others"]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    make = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    out: list[tuple] = []
    for key, rows in _by_cell(batches):
        index: dict[int, list[int]] = {}
        found: dict[int, tuple[int, set[int]]] = {}
        for k, (block, doc, component, values, n, sig) in enumerate(rows):
            met = {o for v in values for o in index.get(v, ())}
            for v in values:
                index.setdefault(v, []).append(k)
            for o in met:
                if key[0] != key[1] and rows[o][0] == block:
                    continue  # their own cell compares them
                if rows[o][2] != component and akin(rows[o][4], rows[o][5], n, sig):
                    found.setdefault(rows[o][1], (rows[o][2], set()))
                    found.setdefault(doc, (component, set()))[1].add(rows[o][1])
        out += [(*key, doc, component, sorted(others)) for doc, (component, others) in found.items()]
        if len(out) >= 1 << 12:
            yield make(out)
            out = []
    if out:
        yield make(out)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _by_cell(batches):
        full: dict[int, np.ndarray] = {}
        root: dict[int, int] = {}

        def of(k: int) -> np.ndarray:
            if k not in full:
                size, blob = rows[k][3:]
                full[k] = sets(np.frombuffer(pa.decompress(blob, size, codec="zstd", asbytes=True), np.uint8), np.array([0, size]))[0]
            return full[k]

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        at: dict[int, list[int]] = {}
        for k, row in enumerate(rows):
            at.setdefault(row[0], []).append(k)
        out = []
        for k, (doc, component, others, _, _) in enumerate(rows):
            for o in (o for d in others for o in at[d]):
                x, y = find(rows[o][1]), find(component)
                if x != y and similar(of(o), of(k)):
                    root[max(x, y)] = min(x, y)
                    out.append((rows[o][0], doc))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
