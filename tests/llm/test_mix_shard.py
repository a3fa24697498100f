"""Mixing and sharding against plain Python, and on odd tables."""

import hashlib
import re
from collections import defaultdict

from basaltine.llm import mixing, sharding


def _targets(sizes):
    """Shares handed out again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets_and_taken(odd, none):
    rows = odd.collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    want = _targets(sizes)
    got = mixing.copies(odd, ranges=5).collect()
    assert len(got) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    again = mixing.copies(odd.repartition(7), ranges=3).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert mixing.mix(none).collect() == []


def test_mixed_rows(odd, none):
    counts = sum(r.copies for r in mixing.copies(odd).collect())
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.count() == counts
    assert mixing.mixed(none).collect() == []


def _shards(rows, limit):
    def bits(i):
        h = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
        return f"{h:060b}"

    rows = [(i, len((t or "").encode()), bits(i)) for i, t in rows]

    def split(part, depth):
        if sum(n for _, n, _ in part) <= limit or len(part) == 1 or depth == 60:
            return [(i, n, depth, b[:depth]) for i, n, b in part]
        return [x for bit in "01" if (half := [r for r in part if r[2][depth] == bit]) for x in split(half, depth + 1)]

    return split(rows, 0)


def test_shards(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 3]
    for limit in (1 << 20, 5000, 700):
        got = sharding.assign(odd.where("doc_id IS NULL OR doc_id <> 3"), limit).collect()
        assert sorted(map(tuple, got), key=str) == sorted(_shards(rows, limit), key=str)
    assert sharding.assign(none, 10).collect() == []
    assert sharding.sharded(odd, 5000).columns == [*odd.columns, "n_bytes", "shard_depth", "shard"] and sharding.sharded(odd, 5000).count() == odd.count()


def test_rows_of_one_id_split(spark):
    rows = [(1, "x" * 100)] * 40 + [(2, "y" * 100)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 1000).collect()
    per = defaultdict(int)
    for r in got:
        per[r.shard] += r.n_bytes
    assert len(got) == 41 and max(per.values()) <= 1000


def _deep_shards(rows, limit):
    """Bits of the id, then of the text; None where copies of one row are over the limit."""
    word = lambda s: f"{int(hashlib.md5(s.encode()).hexdigest()[:15], 16):060b}"
    rows = [(i, t, word(str(i)) + word(t)) for i, t in rows]

    def split(part, depth):
        if sum(len(t) for _, t, _ in part) <= limit or len(part) == 1:
            return [(i, len(t), depth, b[:depth]) for i, t, b in part]
        if depth == 120:
            return [(i, len(t), None, b) for i, t, b in part]
        return [x for bit in "01" if (half := [r for r in part if r[2][depth] == bit]) for x in split(half, depth + 1)]

    return split(rows, 0)


def _over(got, limit):
    """Bytes of the shards of several rows that are over the limit."""
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.n_bytes)
    return [sum(p) for p in per.values() if sum(p) > limit and len(p) > 1]


def test_shards_of_one_id_keep_the_limit(spark):
    sizes = [300, 1, 300, 1, 300, 1, 300, 1, 1, 1, 1, 1]
    rows = [(1, chr(97 + k) * n) for k, n in enumerate(sizes)]  # no other id in the table
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sharding.assign(docs, 1000).collect()
    assert not _over(got, 1000)
    assert sorted(map(tuple, got)) == sorted(_deep_shards(rows, 1000))


def test_shards_of_heavy_ids_keep_the_limit(spark):
    rows = [(1, f"{k} " + "x" * (k * k * 37 % 900)) for k in range(60)] + [(2, f"{k}" * 50) for k in range(40)] + [(k, "y" * 90) for k in range(3, 30)] + [(4, "z" * 5000)]
    rows += [(1, "same" * 60)] * 25  # 240 bytes each, 6000 in all
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.assign(docs, 1000).collect()
    want = _deep_shards(rows, 1000)
    assert len(got) == len(rows) and not _over(got, 1000)
    assert sorted(tuple(r) for r in got if r.shard_depth <= 120) == sorted(w for w in want if w[2] is not None)
    copies = {w[3] for w in want if w[2] is None}
    assert len(copies) == 1 and all(r.shard[:120] in copies and r.shard_depth == len(r.shard) for r in got if r.shard_depth > 120)
    whole = sharding.sharded(docs.withColumn("n", docs.doc_id), 1000)
    assert whole.columns == ["doc_id", "text", "n", "n_bytes", "shard_depth", "shard"] and not _over(whole.collect(), 1000)
    assert sorted((r.doc_id, r.text) for r in whole.collect()) == sorted(rows)
