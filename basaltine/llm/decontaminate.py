"""Benchmark decontamination by spaced-seed hashing.

Texts become tokens: runs of letters, digits and non-ASCII bytes, A-Z lowered.
Each mask of ``MASKS`` looks at some positions of a token window and ignores
the others, so a substituted token hides from the masks that skip it.  Hashes
of test windows are looked up for every training window; each hit fixes an
alignment of item and document, along which that segment is found that agrees in
most tokens among those where at least three of four agree.  A document is
contaminated by an item if that segment agrees in min(12, three quarters of the
item) tokens.

The test side is broadcast in blocks: one block holds about ``BLOCK_BYTES`` of
item text, and a larger benchmark takes several passes over the documents.

Items shorter than the masks have masks of their own length, which leave out
every choice of a quarter of the places; the same rule holds for them.

Defined results: null or empty texts match nothing, on either side, nor do items
without a token; items of fewer than ``SHORTEST`` tokens are looked up whole and
must agree in every token, so that none is found by its commoner part; repeated
rows on either side are judged each on their own, an item id that is repeated
with one text gives one row; a null id stays null; empty tables give an empty
result.  Only the named columns are read, so further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER, mix, slices, span_hashes, word_bounds

MASKS = ("11011011", "1110010111", "1010110101", "1101100011")
SHORTEST = 5
NEED = 12
BLOCK_BYTES = 8 << 20
_BITS = 20

_TOKEN = LOWER.copy()
_TOKEN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
_PLACE = [np.uint64(pow(0xA0761D6478BD642F, 2 * k + 1, 1 << 64)) for k in range(32)]


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, and per document the index of its first token."""
    clean = _TOKEN[data]
    starts, ends, first = word_bounds(clean, off)
    return span_hashes(clean, starts, ends), first


def _seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(int("1" + mask, 2)))
    for k, bit in enumerate(mask):
        if bit == "1":
            out += hashes[k : k + n] * _PLACE[k]
    return mix(out)


def _masks(n: int) -> list[str]:
    """Masks for items of n tokens: below the length of ``MASKS`` they hit wherever three quarters agree.

    Every choice of places that may differ is among the places that some mask
    skips.  Skipped places at the ends are cut off, as the text may end there.
    """
    if n >= max(map(len, MASKS)):
        return list(MASKS)
    wrong = n // 4 if n >= SHORTEST else 0
    left = set(combinations(range(n), wrong))
    skips = list(combinations(range(n), wrong + (wrong > 1)))
    found = []
    while left:
        skip = max(skips, key=lambda s: sum(c in left for c in combinations(s, wrong)))
        left -= set(combinations(skip, wrong))
        found.append("".join("01"[k not in skip] for k in range(n)).strip("0"))
    return sorted(set(found))


class Block:
    """Seeds of some benchmark items, ready for lookup."""

    def __init__(self, ids: list, texts: list[str]):
        column = pa.array(texts, pa.large_string())
        self.ids, self.items = ids, []
        for _, _, data, off in slices(column):
            hashes, first = tokens(data, off)
            self.items += [hashes[first[k] : first[k + 1]].copy() for k in range(len(off) - 1)]
        found: dict[str, tuple[list, list, list]] = {}
        masks = {n: _masks(n) for n in {len(x) for x in self.items if len(x)}}
        for k, item in enumerate(self.items):
            for mask in masks.get(len(item), ()):
                h = _seeds(item, mask)
                for part, values in zip(found.setdefault(mask, ([], [], [])), (h, np.full(len(h), k), np.arange(len(h)))):
                    part.append(values)
        self.tables = {}
        for mask, (h, item, at) in found.items():
            h, item, at = map(np.concatenate, (h, item, at))
            order = np.argsort(h, kind="stable")
            there = np.zeros(1 << _BITS, bool)
            there[h >> np.uint64(64 - _BITS)] = True
            self.tables[mask] = h[order], item[order], at[order], there
        self.tiny = np.array([len(x) < SHORTEST for x in self.items], bool)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, tokens agreeing, segment length, segment start) of each contaminated pair."""
        lines = []
        for mask, (seed, item, at, there) in self.tables.items():
            h = _seeds(hashes, mask)
            maybe = np.flatnonzero(there[h >> np.uint64(64 - _BITS)])
            lo = np.searchsorted(seed, h[maybe], "left")
            n = np.searchsorted(seed, h[maybe], "right") - lo
            maybe, lo, n = maybe[n > 0], lo[n > 0], n[n > 0]
            pick = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            pos = np.repeat(maybe, n)
            doc = np.searchsorted(first, pos, "right") - 1
            inside = pos + len(mask) <= first[doc + 1]
            line = np.stack([doc, item[pick], pos - at[pick]])[:, inside]
            tiny = self.tiny[line[1]]
            if tiny.any():  # whole matches are all alike: the last of each document will do
                whole = line[:, tiny]
                whole = whole[:, np.lexsort(whole[::-1])]
                last = np.ones(whole.shape[1], bool)
                last[:-1] = (whole[:2, 1:] != whole[:2, :-1]).any(axis=0)
                line = np.concatenate([line[:, ~tiny], whole[:, last]], axis=1)
            lines.append(line)
        if not lines:
            return []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, k, shift in np.unique(np.concatenate(lines, axis=1), axis=1).T.tolist():
            seen = self._segment(hashes[first[doc] : first[doc + 1]], self.items[k], shift - int(first[doc]))
            if seen and seen > best.get((doc, k), (0, 0, 0)):
                best[doc, k] = seen
        return [(doc, k, *seen) for (doc, k), seen in best.items()]

    @staticmethod
    def _segment(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
        lo, hi = max(0, -shift), min(len(item), len(text) - shift)
        same = text[lo + shift : hi + shift] == item[lo:hi]
        # Most agreeing tokens over all segments whose sum of +1 and -3 is not negative:
        # for each end, the first begin whose prefix is no higher.
        run = np.concatenate([[0], np.cumsum(np.where(same, 1, -3))])
        total = np.concatenate([[0], np.cumsum(same)])
        begins = np.searchsorted(-np.minimum.accumulate(run), -run)
        end = int(np.argmax(total - total[begins]))
        begin = int(begins[end])
        agree = int(total[end] - total[begin])
        if agree:
            begin += int(np.argmax(same[begin:end]))  # the end agrees, being the first of its total
        need = len(item) if len(item) < SHORTEST else min(NEED, -(-3 * len(item) // 4))
        return (agree, end - begin, lo + shift + begin) if agree >= need else None


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_bytes`` of text."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").collect()
        yield Block([r[0] for r in rows], [r[1] for r in rows])


def contaminated(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item that it contains: the best agreeing segment."""
    doc, item = dict(documents.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {doc}, item_id {item}, n_agree long, n_tokens long, start long"
    item_type = pa.int64() if item in ("bigint", "long") else None

    def one(block: Block) -> DataFrame:
        shared = documents.sparkSession.sparkContext.broadcast(block)  # bounded by block_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = shared.value
            for batch in batches:
                for lo, hi, data, off in slices(batch.column("text")):
                    found = test.hits(*tokens(data, off))
                    if found:
                        rows = list(zip(*found))
                        ids = batch.column("doc_id").slice(lo, hi - lo).take(pa.array(rows[0]))
                        yield pa.RecordBatch.from_arrays(
                            [ids, pa.array([test.ids[k] for k in rows[1]], item_type), *[pa.array(r, pa.int64()) for r in rows[2:]]],
                            ["doc_id", "item_id", "n_agree", "n_tokens", "start"])

        return documents.select("doc_id", "text").mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [one(b) for b in blocks(benchmark, block_bytes)])


def keep_clean(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents`` that contain no benchmark item; rows never move."""
    for block in blocks(benchmark, block_bytes):
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, data, off in slices(batch.column("text")):
                    keep = np.ones(hi - lo, bool)
                    keep[[hit[0] for hit in shared.value.hits(*tokens(data, off))]] = False
                    yield batch.slice(lo, hi - lo).filter(pa.array(keep))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
