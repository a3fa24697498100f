"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

*Base spans* are the checked matches of four patterns (email, ip, card, phone).

*Slots* are all identifier-shaped strings of a text, those of the base patterns
among them.  Around slots a text is a sequence of tokens (runs of letters and
digits, runs of other signs); a slot is one token.  Its contexts are one and two
tokens to the left, one and two to the right, and one on each side, so what is
glued to an identifier (``email:x``, ``<x``) is context like any other.

*Seeds* are slots that hold a checked match; they induce patterns: a pattern is a
context with at least ``SUPPORT`` distinct seeds of one kind.  Patterns and slots
form a bipartite graph that is scored in rounds:

* a pattern's confidence for a kind is the weight of the slots of that kind in
  it, over all places of the corpus where the context stands, whatever fills
  them; both sides are counted on the same tokens, so it lies in 0..1;
* a slot weighs 1 if it is a seed, else as the best pattern it stands in (0 in
  the first round), and only for kinds whose skeleton it has: a phone number is
  never an email, whatever its context.

Unseen slots in a pattern of confidence ``CONFIDENCE`` become spans of its kind.

How a text is read is linear in its length: positions and overlaps come from
running sums and maxima over blocks of blocks, whatever the number of matches.
Totals are counted by hash before they meet the patterns, and only places whose
hash is in a bit set of fixed size are counted, so no join has a row for each
occurrence.

Defined results: a null or empty text has no spans; positions are code points,
end exclusive; rows that share an id are judged each on their own text; repeated
rows get the same spans; a null id is kept; an empty table gives an empty
result; where several patterns discover one slot, the most confident gives the
kind, the first listed among equals.  Only doc_id and text are read; further
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import discard, stored

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 5
CONFIDENCE = 0.5
ROUNDS = 3
#: Bits of the set of context hashes, whatever the number of patterns.
SET_BITS = 18
BLOCK = 128

# Possessive forms of the four contract patterns: same leftmost matches, no
# backtracking, no restart inside a run that has already failed.  Cards and
# phones ask for their least number of digits or signs at once: a run that is
# too short would be dropped anyway, and holds no other match.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]{8,}[0-9]",
}
#: What may be an identifier: matches of the patterns, and other strings of such shapes.
SLOT = (
    rf"(?<!{_LOCAL}){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
    r"|(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
    r"|[0-9](?:[\x20-]?+[0-9]){13,}+"
    r"|\+[0-9][\x20().0-9-]{8,}[0-9]"
    rf"|(?<!{_LOCAL}){_LOCAL}++\x20?+(?:\(at\)|\[at\]|@)\x20?+[A-Za-z0-9-]++(?:\x20?+(?:\(dot\)|\[dot\]|\.)\x20?+[A-Za-z0-9-]++)*+"
    r"|(?<![A-Za-z0-9])(?:\+?+[0-9(][0-9().:/-]{4,}+(?:\x20[0-9().:/-]++)*+|[A-Za-z0-9]++[.:/_-][0-9][A-Za-z0-9.:/_-]{3,}+)"
)
#: What an unseen slot needs to compete for a kind.
SKELETONS = {
    "email": r"@|\(at\)|\[at\]",
    "ip": r"[0-9]++[.:][0-9A-Fa-f]++[.:][0-9A-Fa-f]",
    "card": r"(?:[0-9][^0-9A-Za-z]*+){12}",
    "phone": r"(?:[0-9][^0-9A-Za-z]*+){7}",
}
_MARK = "\x01"
_TOKEN = r"\x01|[\p{L}\p{N}]++|[^\p{L}\p{N}\x01\x20\x09-\x0D]++"
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_SLOTS = "array<struct<start:int,end:int,seed:array<int>,may:array<int>,word:bigint,contexts:array<bigint>>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: int, op: Callable[[Column, Column], Column], depth: int = 2) -> Column:
    """For each of some ints, ``op`` over all before it.

    Arrays only grow by copying, so they grow within blocks; the blocks' totals
    are treated alike, one level up.
    """
    start = F.lit(zero)

    def plain(x: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, empty, lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def level(x: Column, left: int) -> Column:
        if not left:
            return plain(x)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, lambda b: let(level_of_totals(b, left), lambda begins: F.flatten(F.zip_with(b, begins, lambda one, begin: F.transform(plain(one), lambda v: op(begin, v))))))

    def level_of_totals(b: Column, left: int) -> Column:
        return let(F.transform(b, lambda one: F.aggregate(one, start, op)), lambda totals: level(totals, left - 1))

    return let(values, lambda x: F.when(F.size(x) > 0, level(x, depth)).otherwise(F.array().cast("array<int>")))


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def _luhn(word: Column) -> Column:
    doubled = F.array(*[F.lit(n) for n in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])

    def passes(turned: Column) -> Column:
        digit = lambda i: F.substring(turned, i, F.lit(1)).cast("int")
        total = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, F.element_at(doubled, digit(i) + 1)).otherwise(digit(i)))
        return F.when(F.length(turned).between(14, 19), total % 10 == 0).otherwise(False)

    return let(F.reverse(_digits(word)), passes)


def _octets(word: Column) -> Column:
    bare = F.transform(F.split(word, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(bare, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))


_CHECKS = {
    "email": lambda w: F.lit(True),
    "ip": _octets,
    "card": _luhn,
    "phone": lambda w: F.length(_digits(w)).between(10, 15),
}


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _places(text: Column, words: Column, pattern: str) -> Column:
    """(start, end, word) of each of the matches ``words`` of a pattern in a text."""

    def of(m: Column, p: Column) -> Column:
        steps = F.zip_with(p, m, lambda piece, word: F.length(piece) + F.length(word))
        starts = F.zip_with(running(steps, 0, lambda a, b: a + b), p, lambda at, piece: at + F.length(piece))
        return F.zip_with(starts, m, lambda at, word: F.struct(at.alias("start"), (at + F.length(word)).alias("end"), word.alias("word")))

    none = F.array().cast("array<struct<start:int,end:int,word:string>>")
    return let(words, lambda m: F.when(F.size(m) > 0, let(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda p: of(m, p))).otherwise(none))


def _base(text: Column) -> Column:
    """Checked matches of all kinds (start, kind, end), in order."""
    may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    parts = []
    for i, kind in enumerate(KINDS):
        found = _places(text, _matches(text, PATTERNS[kind]), PATTERNS[kind])
        good = F.transform(F.filter(found, lambda s: _CHECKS[kind](s["word"])), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))
        parts.append(F.when(may[kind], good).otherwise(F.array().cast(_SPAN)) if kind in may else good)
    return F.array_sort(F.concat(*parts)).cast(_SPAN)


def contexts(tokens: Column, i: Column) -> Column:
    """Hashes of the five contexts of place ``i`` (from 0) among tokens; beyond the ends of a text stands the empty string."""
    at = lambda d: F.coalesce(F.get(tokens, i + d), F.lit(""))
    shapes = ((-1,), (-2, -1), (1,), (1, 2), (-1, 1))
    return F.array(*[F.xxhash64(F.lit(k), *[at(d) for d in shape]) for k, shape in enumerate(shapes)])


def _tokens(text: Column, pieces: Column) -> Column:
    """Tokens of a text whose slots are single tokens; ``pieces`` are what lies between them."""
    return _matches(F.lower(F.array_join(F.transform(pieces, lambda p: F.translate(p, _MARK, " ")), f" {_MARK} ")), _TOKEN)


def _kinds(word: Column, tests: list[Column]) -> Column:
    return F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]))


def _slots(text: Column) -> Column:
    """All slots of a text: place, kinds that it is a seed of, kinds that it may be, hash of the word, contexts."""
    seed = lambda w: _kinds(w, [F.exists(_matches(w, PATTERNS[k]), _CHECKS[k]) for k in KINDS])
    may = lambda w: _kinds(w, [w.rlike(SKELETONS[k]) for k in KINDS])

    def of(m: Column) -> Column:
        around = let(_tokens(text, F.split(text, SLOT, -1)), lambda t: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.get(t, i) == _MARK), lambda i: contexts(t, i)))
        return F.zip_with(_places(text, m, SLOT), around, lambda s, c: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), seed(s["word"]).alias("seed"), may(F.lower(s["word"])).alias("may"), F.xxhash64(F.lower(s["word"])).alias("word"), c.alias("contexts")))

    return let(_matches(text, SLOT), lambda m: F.when(F.size(m) > 0, of(m).cast(_SLOTS)).otherwise(F.array().cast(_SLOTS)))


def _apart(slots: Column, base: Column) -> Column:
    """The slots that overlap no base span."""
    far = (1 << 31) - 1

    def of(order: Column) -> Column:
        is_base = lambda e: e["slot"] < 0
        ends = running(F.transform(order, lambda e: F.when(is_base(e), e["end"]).otherwise(-1)), -1, lambda a, b: F.greatest(a, b))
        begins = F.reverse(running(F.transform(F.reverse(order), lambda e: F.when(is_base(e), e["start"]).otherwise(far)), far, lambda a, b: F.least(a, b)))
        free = F.zip_with(F.zip_with(ends, begins, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), order, lambda x, e: F.when(~is_base(e) & (x["a"] <= e["start"]) & (x["b"] >= e["end"]), e["slot"]))
        return F.transform(F.array_compact(free), lambda k: F.get(slots, k))

    order = F.array_sort(F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(-1).alias("slot"), b["end"].alias("end"))),
        F.transform(slots, lambda s, k: F.struct(s["start"].alias("start"), k.alias("slot"), s["end"].alias("end")))))
    return F.when((F.size(slots) > 0) & (F.size(base) > 0), let(order, of)).otherwise(slots)


def _found(documents: DataFrame) -> DataFrame:
    """doc_id, key of the text, base spans, seeds, and unseen slots."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.struct(F.length(text).alias("n"), F.xxhash64(text).alias("h")).alias("key"), let(text, _base).alias("base"), let(text, _slots).alias("slots"))
    seeds = F.transform(F.filter("slots", lambda s: F.size(s["seed"]) > 0), lambda s: F.struct(s["seed"].alias("kinds"), s["word"].alias("word"), s["contexts"].alias("contexts")))
    unseen = F.filter("slots", lambda s: (F.size(s["seed"]) == 0) & (F.size(s["may"]) > 0))
    rows = rows.withColumns({"seeds": seeds, "others": unseen})
    return rows.select("doc_id", "key", "base", "seeds", let(F.col("others"), lambda s: _apart(s, F.col("base"))).alias("unseen"))


def _in_set(hashes: DataFrame) -> Callable[[Column], Column]:
    """Test for a set of context hashes by ``2**SET_BITS`` bits; it lets through some others."""
    at = F.shiftrightunsigned("h", 64 - SET_BITS)
    words = hashes.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - SET_BITS}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    bits = np.zeros(1 << (SET_BITS - 6), np.int64)
    for r in words.collect():  # at most 2**(SET_BITS - 6) rows
        bits[r.w] = r.b
    table = F.lit(bits)

    def test(h: Column) -> Column:
        place = F.shiftrightunsigned(h, 64 - SET_BITS)
        return F.getbit(F.get(table, F.shiftright(place, 6).cast("int")), place.bitwiseAND(63).cast("int")) == 1

    return test


def totals(documents: DataFrame, hashes: DataFrame) -> DataFrame:
    """(h, total): at how many places of the corpus each of some contexts stands, whatever fills it."""
    known = _in_set(hashes)
    text = F.coalesce("text", F.lit(""))
    of = lambda t: F.filter(F.flatten(F.transform(t, lambda _, i: contexts(t, i))), known)
    places = documents.select(F.explode(let(_tokens(text, F.split(text, SLOT, -1)), of)).alias("h"))
    return places.groupBy("h").agg(F.count("*").alias("total")).join(hashes, "h", "left_semi")


def patterns(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(h, kind, score) of the patterns that count after all rounds, stored."""
    seeds = found.select(F.explode("seeds").alias("s")).select(F.explode("s.kinds").alias("kind"), "s.word", "s.contexts").select("kind", "word", F.explode("contexts").alias("h"))
    support = stored(seeds.groupBy("h", "kind", "word").agg(F.count("*").alias("n")).groupBy("h", "kind").agg(F.count("*").alias("support"), F.sum("n").alias("seeded")).where(F.col("support") >= SUPPORT), "support")
    if support.isEmpty():
        return support.select("h", "kind", F.lit(0.0).alias("score"))
    known = stored(support.join(totals(documents, support.select("h").distinct()), "h").select("h", "kind", "seeded", "total"), "patterns")
    edges = stored(_edges(found, known.select("h").distinct()).groupBy("h", "kind", "word").agg(F.count("*").alias("n")), "edges")
    score = known.select("h", "kind", (F.col("seeded") / F.col("total")).alias("score"))
    for _ in range(ROUNDS - 1):
        weight = edges.join(score.where(F.col("score") >= CONFIDENCE), ["h", "kind"]).groupBy("word", "kind").agg(F.max("score").alias("weight"))
        added = edges.join(weight, ["word", "kind"]).groupBy("h", "kind").agg(F.sum(F.col("n") * F.col("weight")).alias("added"))
        score = stored(known.join(added, ["h", "kind"], "left").select("h", "kind", ((F.col("seeded") + F.coalesce("added", F.lit(0.0))) / F.col("total")).alias("score")), "scores")
    trusted = stored(score.where(F.col("score") >= CONFIDENCE), "trusted")
    discard(support, known, edges)
    return trusted


def _edges(found: DataFrame, hashes: DataFrame, *keep: str) -> DataFrame:
    """Unseen slots with each of their contexts among ``hashes`` and each kind that they may be."""
    slots = found.select(*keep, F.explode("unseen").alias("s")).select(*keep, "s.start", "s.end", "s.word", "s.may", F.explode(F.filter("s.contexts", _in_set(hashes))).alias("h"))
    return slots.join(hashes, "h", "left_semi").withColumn("kind", F.explode("may")).drop("may")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans(documents: DataFrame) -> DataFrame:
    """doc_id, base spans and all spans (start, kind, end) of every document."""
    found = stored(_found(documents), "found")
    trusted = patterns(documents, found)
    if trusted.isEmpty():
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    hits = _edges(found, trusted.select("h").distinct(), "doc_id", "key").join(trusted, ["h", "kind"])
    best = hits.groupBy("doc_id", "key", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    lists = best.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("new"))
    joined = found.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("new", F.array().cast(_SPAN)))).alias("spans"))


def digest(documents: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text."""
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return spans(documents).select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_discovered"))


def _of_kind(i: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == i
