"""Personal data: base spans and the whole bootstrap against brute force in Python, and planted identifiers."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import regex

from basaltine.llm import pii

RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SHAPE = "doc_id long, text string"


def _passes(kind, word):
    digits = [int(c) for c in word if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in word.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def _base(text):
    return sorted((m.start(), i, m.end()) for i, (k, rx) in enumerate(RX.items()) for m in re.finditer(rx, text or "") if _passes(k, m.group()))


def _names(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _brute(rows):
    """Spans of every row, with contexts as tuples of tokens and scores as plain sums."""
    slots, places, support, seeded = [], Counter(), defaultdict(set), Counter()
    for text in (t or "" for _, t in rows):
        found, tokens, at = [], [], 0
        for m in [*regex.finditer(pii.SLOT, text), None]:
            tokens += regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+", text[at : m.start() if m else None].lower())
            if m:
                found.append((len(tokens), m.start(), m.end(), m.group()))
                tokens.append("\x01")
                at = m.end()
        token = lambda i: tokens[i] if 0 <= i < len(tokens) else ""  # noqa: B023, E731
        around = lambda i: [("l", token(i - 1)), ("ll", token(i - 2), token(i - 1)), ("r", token(i + 1)), ("rr", token(i + 1), token(i + 2)), ("lr", token(i - 1), token(i + 1))]  # noqa: B023, E731
        for i in range(len(tokens)):
            places.update(around(i))
        base = _base(text)
        own = []
        for i, start, end, word in found:
            seeds = [j for j, k in enumerate(pii.KINDS) if any(_passes(k, m.group()) for m in re.finditer(RX[k], word))]
            for c in around(i):
                for j in seeds:
                    support[c, j].add(word.lower())
                    seeded[c, j] += 1
            may = [j for j, k in enumerate(pii.KINDS) if regex.search(pii.SKELETONS[k], word.lower())]
            if not seeds and may and not any(a < end and start < b for a, _, b in base):
                own.append((start, end, word.lower(), may, around(i)))
        slots.append((base, own))
    score = {p: seeded[p] / places[p[0]] for p, words in support.items() if len(words) >= pii.SUPPORT}
    known = set(score)
    for _ in range(pii.ROUNDS - 1):
        weight, added = defaultdict(float), Counter()
        edges = [((c, j), (word, j)) for _, own in slots for _, _, word, may, around in own for c in around for j in may if (c, j) in known]
        for p, w in edges:
            if score[p] >= pii.CONFIDENCE:
                weight[w] = max(weight[w], score[p])
        for p, w in edges:
            added[p] += weight[w]
        score = {p: (seeded[p] + added[p]) / places[p[0]] for p in known}
    out = []
    for base, own in slots:
        new = []
        for start, end, _, may, around in own:
            best = max(((score[c, j], -j) for c in around for j in may if score.get((c, j), 0) >= pii.CONFIDENCE), default=None)
            if best:
                new.append((start, -best[1], end))
        out.append(_names(sorted(base + new)))
    return out, score


def test_base_spans(spark, odd, none):
    rnd = random.Random(2)
    bits = ["a", "@", ".", "1", "24", "-", " ", "+", "(", ")", "b@c.d", "😀", "é", "%", "_", "10.2.3.4", "4111111111111111", "0", "255", "+1 (555) 010-9999"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 50)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "1 " * 20000), (1003, "9" * 20000), (1004, "a." * 20000 + "@x"), (1005, "a@" + "b." * 20000 + "c"), (1006, "001.02.255.0256"), (7, rows[7][1]), (None, "x 1.2.3.4")]
    got = pii.digest(spark.createDataFrame(rows, SHAPE)).collect()
    expected = sorted((i or -1, *[sum(s[1] == j for s in _base(t)) for j in range(4)], hashlib.sha256(_names(_base(t)).encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id or -1, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == expected
    every = {i: t for i, t in rows}
    for r in got:
        assert set(_names(_base(every[r.doc_id])).split(",")) <= set(r.spans.split(",")) | {""}
    assert pii.digest(odd).count() == odd.count()
    assert pii.digest(none).collect() == []


def test_whole_bootstrap(spark):
    """Spans and scores equal a plain computation over token tuples."""
    rnd = random.Random(4)
    words = ["mail", "phone", "at", "the", "box", ":", "(", "is", "host", "desk", "v", "-", ",", "Straße", "日本", "note"]
    email = lambda: f"{rnd.choice('abc')}{rnd.randint(1, 60)}@{rnd.choice('xy')}.org"
    odd_one = lambda: rnd.choice(["j%d [at] corp [dot] com", "555-12%d-4567", "10.0.%d", "k%d@host", "4111 1111 1111 11%02d", "v9.%d-beta1", "300.1.1.%d"]) % rnd.randint(1, 30)
    seed = lambda: rnd.choice([email, email, lambda: f"10.0.0.{rnd.randint(1, 99)}", lambda: f"+1 (555) 010-{rnd.randint(1000, 9999)}", lambda: "4111 1111 1111 1111"])()
    frames = [("mail box: ", email), ("<", email), ("phone: ", seed), ("host ", lambda: f"10.1.0.{rnd.randint(1, 99)}")]

    def one():
        parts = []
        for _ in range(rnd.randint(3, 14)):
            cue, fill = rnd.choice(frames)
            parts.append(rnd.choice([rnd.choice(words), rnd.choice(words), cue + fill(), cue + odd_one(), seed(), odd_one()]))
        return rnd.choice([" ", "  ", "\n"]).join(parts)

    rows = [(i, one()) for i in range(150)] + [(150, None), (151, "\x01 mail box: x@y.org \x01"), (3, "mail box: again@x.org")]
    expected, score = _brute(rows)
    docs = spark.createDataFrame(rows, SHAPE)
    got = pii.spans(docs).select("doc_id", pii._joined(pii.F.col("spans"))).collect()
    assert sorted((r[0], r[1]) for r in got) == sorted((i, e) for (i, _), e in zip(rows, expected))
    assert sum(e.count(":") for e in expected) > sum(_names(_base(t)).count(":") for _, t in rows)
    trusted = pii.patterns(docs, pii.stored(pii._found(docs), "found")).collect()
    assert sorted(round(r.score, 9) for r in trusted) == sorted(round(v, 9) for v in score.values() if v >= pii.CONFIDENCE)
    assert all(0 <= r.score <= 1 for r in trusted)


def test_planted_identifiers(spark):
    """Unseen forms in five kinds of context are found; the same forms elsewhere, and other kinds, are not."""
    forms = ["jane{} [at] corp [dot] com", "joe{}(at)corp.org", "ann{}@intranet"]
    frames = ["write to secure mailbox: {} today", "please contact email:{} soon", "reach the desk <{}> again", "so {} is my address", "from {} sent it"]
    rows = [(1000 * f + i, frame.format(f"user{i}@site{i}.org")) for f, frame in enumerate(frames) for i in range(12)]
    unseen = [(100_000 + 100 * f + k, frame.format(form.format(f))) for f, frame in enumerate(frames) for k, form in enumerate(forms)]
    clean = [(200_000 + k, f"the {form.format(k)} stands alone here") for k, form in enumerate(forms)] + [(200_100, "secure mailbox: 555-123-4567 now"), (200_101, "please contact email: nobody")]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows + unseen + clean, SHAPE)).collect()}
    hits = [i for i, t in unseen if got[i].spans.startswith("email:") and got[i].n_email == 0]
    assert len(hits) >= 0.9 * len(unseen)
    assert all(got[i].spans == "" for i, _ in clean)
    assert all(got[i].n_email == 1 and got[i].n_discovered == 0 for i, _ in rows)


def test_any_length(spark):
    """No cap on the length of a cue word, an identifier, or the number of matches of a text."""
    cue, name = "c" * 300, "n" * 700
    rows = [(i, f"{cue} {cue}x user{i}@site{i}.org end") for i in range(8)] + [(50, f"{cue} {cue}x {name} [at] corp [dot] com end")]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got[50].spans == f"email:603:{603 + 700 + 20}"
    start = time.monotonic()
    many = pii.digest(spark.createDataFrame([(1, "12," * 340_000), (2, "1.2.3.4 " * 130_000)], SHAPE)).collect()
    assert sorted(r.n_ip for r in many) == [0, 130_000] and time.monotonic() - start < 60


def test_running(spark):
    rnd = random.Random(1)
    for n in (0, 1, 128, 129, 20_000):
        values = [rnd.randint(-9, 9) for _ in range(n)]
        frame = spark.createDataFrame([(values,)], "x array<int>")
        got = frame.select(pii.running(pii.F.col("x"), 0, lambda a, b: a + b), pii.running(pii.F.col("x"), -100, lambda a, b: pii.F.greatest(a, b))).first()
        assert len(got[0]) == n and [got[0][i] for i in range(0, n, 97)] == [sum(values[:i]) for i in range(0, n, 97)]
        assert [got[1][i] for i in range(0, n, 97)] == [max(values[:i], default=-100) for i in range(0, n, 97)]
