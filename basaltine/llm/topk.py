"""Exact top-k inner products by MaxScore, merged over shards.

A vector's components become terms: term d has the posting (row, value) for
each row whose component d is not 0.  For a query, a shard's smallest and
largest values of a term bound what the term can add.  With t the k-th best
score so far, the terms of the smallest bounds whose bounds add up to less than
t are non-essential: a row in no essential posting cannot compete.  Rows of
essential postings are scored on these, then the other terms are probed, the
largest bounds first, only for rows whose score can still reach t.  Shards give
k rows a query, and the best k of all are kept.

Queries and rows are dealt into packs by hash; a task holds one shard and the
query packs stream past it, so memory is bounded by the pack sizes.

Defined results: rows whose vector is null, or has null or non-finite
components, or whose id is null, take no part; vectors of different lengths are
compared as if padded by zeros; rows that share an id are candidates each, and
of each other too; query rows that share id and vector are one query, others
have a list each; equal scores go to the smaller id; fewer rows than k give all of them;
an empty table gives an empty result.  Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 16_384
QUERY_ROWS = 1_024
_BLOCK = 2_048
_PROBE = 8


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and integer components v of every row that takes part."""
    x = F.col("embedding")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def _matrix(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and one row of components each, of a list of (id, vector) pairs."""
    pairs = packed.flatten()
    ids = pairs.field("vec_id").to_numpy(zero_copy_only=False)
    lists = pairs.field("v")
    length = np.diff(lists.offsets.to_numpy())
    rows = np.zeros((len(ids), max([0, *length.tolist()])), np.int64)
    rows[np.repeat(np.arange(len(ids)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = lists.flatten().to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], rows[order]


class Shard:
    """Rows of one shard, with the bounds of each term."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.low = rows.min(axis=0, initial=0)
        self.high = rows.max(axis=0, initial=0)

    def top(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, the query's own among them if it is here."""
        width = min(len(query), self.rows.shape[1])
        query, rows = query[:width], self.rows[:, :width]
        size = float(np.abs(query).astype(float) @ np.maximum(np.abs(self.low[:width]), np.abs(self.high[:width])).astype(float))
        kind = np.float64 if size < 2**52 else object
        query, data = query.astype(kind), rows.astype(kind) if kind is object else self._floats()[:, :width]
        low, high = self.low[:width].astype(kind), self.high[:width].astype(kind)
        bound = np.maximum(query * low, query * high)
        order = np.argsort(bound.astype(float), kind="stable")
        below = np.cumsum(bound[order]) if width else bound
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, kind)
        for lo in range(0, len(self.ids), _BLOCK):
            ids, part = self.ids[lo : lo + _BLOCK], data[lo : lo + _BLOCK]
            at = np.arange(len(ids))
            if len(best) < k:
                score = part[at] @ query
            else:
                t = best[-1]
                loose = np.flatnonzero(below < t)
                cut = int(loose[-1]) + 1 if len(loose) else 0
                spare, essential = order[:cut], order[cut:]
                if len(essential) < width:
                    at = at[(part[at][:, essential] != 0).any(axis=1)]
                score = part[at][:, essential] @ query[essential]
                while cut > 0:
                    alive = score + below[cut - 1] >= t
                    at, score = at[alive], score[alive]
                    if not len(at):
                        break
                    probe = spare[max(0, cut - _PROBE) : cut]
                    score = score + part[at][:, probe] @ query[probe]
                    cut -= len(probe)
            best_ids, best = np.concatenate([best_ids, ids[at]]), np.concatenate([best, score])
            keep = np.lexsort((best_ids, -best.astype(float) if kind is not object else np.array([-x for x in best], object)))[:k] if kind is not object else np.array(sorted(range(len(best)), key=lambda i: (-best[i], best_ids[i]))[:k], int)
            best_ids, best = best_ids[keep], best[keep]
        return best_ids, best

    def _floats(self) -> np.ndarray:
        if not hasattr(self, "_as_float"):
            self._as_float = self.rows.astype(np.float64)
        return self._as_float


_FOUND = ["query_id", "query_key", "own", "vec_id", "score"]


def _limited(x: int) -> int:
    return max(-(2**63), min(2**63 - 1, int(x)))


def _score(k: int):
    """Rows (shard, rows, queries), each shard's own row before its query packs, to the shard's k best for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                if one.column("rows").null_count == 0:
                    shard = Shard(*_matrix(one.column("rows")))
                    continue
                packed = one.column("queries")
                keys = dict(zip(packed.flatten().field("query_key").to_pylist(), range(len(packed.flatten()))))
                ids, vectors = packed.flatten().field("vec_id").to_pylist(), packed.flatten().field("v").to_pylist()
                out: list[list] = [[] for _ in _FOUND]
                for key, at in keys.items():
                    query = np.array(vectors[at], np.int64)
                    found, scores = shard.top(query, k)
                    own = _limited(sum(x * x for x in vectors[at]))
                    for column, values in zip(out, ([ids[at]] * len(found), [key] * len(found), [own] * len(found), found.tolist(), [_limited(x) for x in scores])):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], _FOUND)

    return run


def search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k best rows for each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score."""
    # Copies of a row lie in many partitions, so the partition's number deals them over the packs.
    rows = quantised(vectors).withColumn("dealt", F.xxhash64("vec_id", "v", F.spark_partition_id()))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("query_key", F.xxhash64("vec_id", "v")).select("vec_id", "v", "query_key").dropDuplicates(["query_key"])
    n, m = rows.select(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    shards, packs = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // QUERY_ROWS))
    held = rows.groupBy(F.pmod("dealt", F.lit(shards)).cast("int").alias("shard")).agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    spread = (
        asked.groupBy(F.pmod("query_key", F.lit(packs)).cast("int").alias("pack")).agg(F.collect_list(F.struct("vec_id", "v", "query_key")).alias("queries"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", F.lit(None).cast(held.schema["rows"].dataType).alias("rows"), "queries"))
    # A shard crosses to Python once; the query packs stream past it.
    both = spread.unionByName(held.withColumn("queries", F.lit(None).cast(spread.schema["queries"].dataType)))
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", F.col("rows").isNull())
    found = dealt.select("rows", "queries").mapInArrow(_score(k + 1), "query_id long, query_key long, own long, vec_id long, score long")
    # k + 1 with the query's own row, which then goes: one of the rows that equal it in id and score.
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    itself = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("place"))).over(Window.partitionBy("query_id", "query_key"))
    others = best.withColumn("itself", itself).where("itself IS NULL OR place <> itself")
    rank = F.when(F.col("place") > F.col("itself"), F.col("place") - 1).otherwise(F.col("place")).cast("int")
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT *, row_number() OVER (PARTITION BY vec_id, v) AS copy FROM v),
s AS (SELECT q.vec_id AS query_id, q.v AS query, d.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score
  FROM c q JOIN c d ON q.vec_id <> d.vec_id OR q.v <> d.v OR d.copy > 1 WHERE q.vec_id % 100 = 0 AND q.copy = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
