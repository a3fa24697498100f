"""Decontamination, licenses, token counts, top-k and toxicity."""

import random
import re

import numpy as np
import pytest

from basaltine.llm import decontaminate, licenses, tokencount, topk, toxicity


def test_contaminated(spark, odd, none):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rnd.randint(14, 40)))) for k in range(20)] + [(50, None), (51, ""), (52, "two words"), (53, "six words are a short item"), (0, None)]
    prose = lambda n: " ".join(word() for _ in range(n))
    docs, want = [], set()
    for k, (item, text) in enumerate(items[:20]):
        w = text.split(" ")
        for p in range(3, len(w), 6):  # one token in six replaced
            w[p] = "other"
        docs += [(10 * k, f"{prose(30)} {text.upper()}. {prose(10)}"), (10 * k + 1, f"{prose(9)} {' '.join(w)} {prose(9)}"), (10 * k + 2, prose(60)), (10 * k + 3, " ".join(text.split(" ")[:6]))]
        want |= {(10 * k, item), (10 * k + 1, item)}
    docs += [(900, "here six words are a short item too"), (901, None), (902, ""), (903, "x " * 20000)]
    want.add((900, 53))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 300):
        got = decontaminate.contaminated(d, b, block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    clean = decontaminate.keep_clean(d, b, 300)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontaminate.contaminated(none, b).collect() == [] and decontaminate.contaminated(d, b.limit(0)).collect() == []
    assert decontaminate.keep_clean(odd, b).columns == odd.columns


def _most(same):
    """Most agreeing places of any segment where at least three of four agree."""
    n = len(same)
    return max((sum(same[a:b]) for a in range(n) for b in range(a + 1, n + 1) if 4 * sum(same[a:b]) >= 3 * (b - a)), default=0)


def test_segment_against_brute_force():
    rnd = random.Random(6)
    replaced = [(15, {11}), (18, {2, 14}), (20, {4, 8, 12, 16})] + [(n, {p}) for n in range(10, 21) for p in range(n)]
    replaced += [(n, set(range(first, n, 4))) for n in range(10, 41) for first in range(4)]
    replaced += [(n, set(rnd.sample(range(n), k))) for n in range(10, 41) for k in range(1, n // 2) for _ in range(4)]
    for n, places in replaced:
        item = np.arange(1, n + 1).astype(np.uint64)
        text = np.array([0] * 5 + [0 if p in places else p + 1 for p in range(n)] + [0] * 5, np.uint64)
        most, need = _most([p not in places for p in range(n)]), min(12, -(-3 * n // 4))
        got = decontaminate.Block._segment(text, item, 5)
        assert (got is not None) == (most >= need), (n, places)
        if got:
            agree, length, start = got
            inside = [p not in places for p in range(start - 5, start - 5 + length)]
            assert agree == most == sum(inside) and 4 * agree >= 3 * length and inside[0] and inside[-1]


def test_spread_substitutions_are_found():
    word = lambda k: f"word{k}"
    for n, places in ((15, {11}), (18, {2, 14}), (20, {4, 8, 12, 16})):
        block = decontaminate.Block([1], [" ".join(map(word, range(n)))])
        text = "some prose " + " ".join("other" if p in places else word(p) for p in range(n)) + " and more of it"
        data = np.frombuffer(text.encode(), np.uint8)
        found = block.hits(*decontaminate.tokens(data, np.array([0, len(data)])))
        assert [(doc, item, agree) for doc, item, agree, _, _ in found] == [(0, 0, n - len(places))]


def test_short_items():
    """Items of 1 to 9 tokens with every choice of replaced tokens, inside a text and at its ends."""
    word = lambda k: f"word{k}"
    for n in range(1, 10):
        block = decontaminate.Block([1, 2, 3], [" ".join(map(word, range(n))), "", "..."])
        for bits in range(1 << n):
            same = [not bits >> k & 1 for k in range(n)]
            text = " ".join(word(k) if s else "other" for k, s in enumerate(same))
            first, last = (same.index(True), n - same[::-1].index(True)) if any(same) else (0, n)
            cut = " ".join(text.split(" ")[first:last])
            most = _most(same)
            want = most >= (n if n < 5 else -(-3 * n // 4))
            data = np.frombuffer("".join(parts := [f"some prose {text} and more {text} x", cut, "some prose"]).encode(), np.uint8)
            off = np.cumsum([0, *map(len, parts)])
            found = block.hits(*decontaminate.tokens(data, off))
            assert sorted((doc, item, agree) for doc, item, agree, _, _ in found) == ([(0, 0, most), (1, 0, most)] if want else []), (n, same)


def test_licenses(spark, odd, none):
    rows, want = [(1, None), (2, "")], set()
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        words = text.split(" ")
        if len(words) > 30:
            words[10] = "altered"
        rows += [(10 + k, f"Some words before.\n{' '.join(words)} and after it"), (100 + k, text.lower()), (200 + k, " ".join(words[: len(words) // 3]))]
        want |= {(10 + k, name), (100 + k, name)}
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got
    assert not {x for x in got if x[0] >= 200 and x[1] == list(licenses.TEMPLATES)[x[0] - 200]}
    assert licenses.scan(odd).collect() == [] and licenses.scan(none).collect() == []


def _fewest_tokens(word, score):
    """Tokens of the split of highest total, by trying every piece at every place."""
    best = [(0.0, 0)] + [None] * len(word)
    for start in range(len(word)):
        for end in range(start + 1, min(len(word), start + 200) + 1):
            s = score.get(word[start:end])
            if s is not None:
                one = (best[start][0] + s, best[start][1] - 1)
                best[end] = one if best[end] is None or one > best[end] else best[end]
    return -best[-1][1]


def test_long_pretokens(spark):
    """A text without white space, and the automaton's counts against every split."""
    with open(tokencount.VOCABULARY, "rb") as file:
        model = tokencount.vocabulary(file.read())
    rnd = np.random.default_rng(2)
    words = [b"", b"x", b"thequickbrownfox" * 40, "日本語の長い文".encode() * 60, bytes(rnd.integers(0, 256, 1500, dtype=np.uint8)), b"=" * 700]
    assert [model.count(w) for w in words] == [_fewest_tokens(w, model.score) for w in words]
    text = "日本語の長い文" * 50_000
    (row,) = tokencount.count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_pretokens, row.n_tokens) == (1, model.count(text.encode()))


def test_token_counts(odd, none):
    with open(tokencount.VOCABULARY, "rb") as file:
        model = tokencount.vocabulary(file.read())
    rows = odd.collect()
    expected = []
    for r in rows:
        words = re.findall(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", (r.text or "").encode())
        expected.append((r.doc_id, len(words), sum(_fewest_tokens(w, model.score) for w in words)))
    assert sorted(map(tuple, tokencount.count_tokens(odd).collect()), key=str) == sorted(expected, key=str)
    assert tokencount.count_tokens(none).collect() == []


def _best(vectors, every, k):
    valid = []
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            valid.append((i, tuple(int(np.floor(1024 * np.float64(np.float32(x)))) for x in v)))
    out = []
    for q, a in set(valid):
        if q % every == 0:
            others = list(valid)
            others.remove((q, a))
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in others)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard", [16384, 40])
def test_topk(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "_BLOCK", 32)
    rnd = np.random.default_rng(4)
    vectors = [(i, rnd.normal(size=12).astype(float).tolist()) for i in range(300)]
    vectors += [(1000 + i, [0.0] * 11 + [float(i % 3)]) for i in range(50)] + [(2000 + i, vectors[5][1]) for i in range(30)]
    vectors += [(3000, None), (3001, [None] + [1.0] * 11), (3002, [float("nan")] * 12), (3003, [float("inf")] * 12), (None, [1.0] * 12), (7, vectors[9][1]), (100, vectors[9][1]), (3100, []), (3200, [1.0, 2.0]), (3300, [1e12] * 12)]
    vectors += [(200, vectors[200][1])] * 15  # copies of one query row
    frame = spark.createDataFrame([(*x, -1, -2) for x in vectors], "vec_id long, embedding array<float>, score long, rows long").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(frame).collect())
    limit = 2**63 - 1
    assert got == [(q, r, v, max(-limit - 1, min(limit, s))) for q, r, v, s in _best(vectors, 100, 10)]
    assert topk.search(frame.limit(0)).collect() == []


def test_topk_oracle_of_shared_ids(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rnd = np.random.default_rng(9)
    vectors = [(int(i), rnd.integers(-3, 4, 4).astype(float).tolist()) for i in rnd.integers(0, 5, 60) * 50]
    frame = spark.createDataFrame(vectors + vectors[:20], "vec_id long, embedding array<float>").repartition(3)
    frame.write.parquet(str(tmp_path / "embeddings"))
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings/*.parquet'")
        want = base.execute(topk.ORACLE).fetchall()
    assert sorted(map(tuple, topk.search(frame).collect())) == sorted(want)


def test_toxicity(spark, none):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("aeioustrnl") for _ in range(rnd.randint(3, 8)))
    rows, labels = [], []
    for i in range(900):
        w, bad = [word() for _ in range(40)], i % 4 == 0
        if bad:
            w[rnd.randrange(40)] = w[rnd.randrange(40)] = "gruzzle"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(10_000, None), (10_001, ""), (None, "text"), rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.classify(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(r.predicted, r.doc_id % 4 == 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 100 and sum(p == t for p, t in held) / len(held) > 0.97
    clean = toxicity.keep_clean(docs, marks)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)
    assert toxicity.classify(none, marks).collect() == []
    assert {r.score for r in toxicity.classify(docs, marks.limit(0)).collect()} == {0.0}
