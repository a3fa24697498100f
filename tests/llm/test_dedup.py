"""Substring removal and near-duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from basaltine.llm import neardup, substrings


def _removed(rows):
    """Expected (n_bytes, n_removed, n_spans, sha256) of each row, by direct comparison of all strings."""
    first = {}
    key = lambda i: float("inf") if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_removed_strings(odd, none):
    got = substrings.repeated_spans(odd).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == _removed(rows)
    assert any(r.n_removed for r in got)
    assert all(r.n_removed == sum(b - a for a, b in r.spans) for r in got)
    assert substrings.repeated_spans(none).collect() == []


def test_many_buckets(odd, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET", 2000)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = substrings.repeated_spans(odd).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == _removed(rows)


def _shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _components(rows):
    sets = [(i, _shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_components(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = _components(rows)
    expected = sorted(((i, len(_shingles(t)), want.get(i), i is None or want[i] == i) for i, t in rows), key=str)
    got = neardup.groups(odd).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == expected
    assert sum(not r.kept for r in got) >= 5
    assert neardup.groups(none).collect() == []


def test_chain_of_copies(spark):
    """Each document is close to the next one only; all are one component."""
    words = [f"t{k}" for k in range(400)]
    rows = [(100 - k, " ".join(words[k * 5 : k * 5 + 120])) for k in range(12)]
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {89}


def test_keep_one(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = _components(rows)
    got = neardup.keep_one(odd)
    assert got.columns == odd.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted({i for i, c in want.items() if i == c})


@pytest.mark.parametrize("hub_rows", [2, 256])
def test_components_of_hubs(spark, monkeypatch, hub_rows):
    """Stars of every kind of centre, chains and random links, with and without hubs."""
    monkeypatch.setattr(neardup, "HUB_ROWS", hub_rows)
    rnd = random.Random(8)
    links = [(0, k) for k in range(1, 60)] + [(199, k) for k in range(100, 190)] + [(k, k + 1) for k in range(300, 312)]
    links += [(rnd.randrange(400, 480), rnd.randrange(400, 480)) for _ in range(60)] + [(5, 5), (1, 0), (59, 300)]
    root = {i: i for pair in links for i in pair}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.doc: r.component for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {i: got.get(i, i) for i in root} == {i: find(i) for i in root}


def test_keep_one_of_shared_ids(spark):
    """Different texts of one id all stay, one row each; a fixed one of rows that differ elsewhere."""
    words = [" ".join(f"{x}{k}" for k in range(30)) for x in "abc"]
    rows = [(1, words[0], "x"), (1, words[0], "b"), (1, words[1], "x"), (2, words[0], "x"), (3, words[2], "z"), (4, "", "x"), (4, "", "x"), (4, None, "x"), (None, words[0], "n")]
    for parts in (1, 4):
        got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)).collect()
        assert sorted(map(tuple, got), key=str) == sorted([(1, words[0], "b"), (1, words[1], "x"), (3, words[2], "z"), (4, "", "x"), (4, None, "x"), (None, words[0], "n")], key=str)


def test_texts_of_alike_documents_only(spark, monkeypatch):
    """Documents that share lists by chance are told apart by signatures; texts move for the others alone.

    With one rarity for all values, as in tables so large that their counters
    are full, every document here shares lists with every other one.
    """
    rnd = random.Random(5)
    prose = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    phrase = prose(24)
    texts = [prose(90) + phrase + prose(90) for _ in range(30)]
    half = prose(150)  # both copies are in the lists that a longer document leads, which is like neither
    texts = [half + prose(150), *texts, texts[4][:20] + ["changed"] + texts[4][21:], half[:70] + ["changed"] + half[71:], half]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    gathered, packed = set(), neardup.packed_texts

    def noted(documents, ids):
        gathered.update(r.doc for r in ids.select("doc").collect())
        return packed(documents, ids)

    monkeypatch.setattr(neardup, "rarity", lambda reps: np.zeros(neardup.COUNTERS, np.uint8))
    monkeypatch.setattr(neardup, "packed_texts", noted)
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == _components(rows)
    assert {r.doc_id for r in got if not r.kept} == {31, 33}
    assert {5, 31, 32, 33} <= gathered <= {0, 5, 31, 32, 33}


def test_signatures_keep_similar_pairs():
    """No pair of similarity 0.75 is lost, sets of a few shingles included; unrelated large sets part."""
    rnd = np.random.default_rng(3)
    sig = lambda v: np.unique((np.sort(v)[: neardup.SIGNED] >> np.uint64(32)).astype(np.uint32)).tobytes()
    for common in [3, 6, 9, 12, 24, 30, 33, 60, 96, 150, 600, 3000] * 30:
        v = rnd.integers(0, 1 << 64, common + common // 3, np.uint64)
        one = rnd.integers(0, common // 3 + 1)
        a, b = np.concatenate([v[:common], v[common : common + one]]), np.concatenate([v[:common], v[common + one :]])
        assert neardup.akin(len(a), sig(a), len(b), sig(b)) and neardup.akin(len(b), sig(b), len(a), sig(a))
        c = rnd.integers(0, 1 << 64, common, np.uint64)
        assert not neardup.akin(len(a), sig(a), len(c), sig(c))
