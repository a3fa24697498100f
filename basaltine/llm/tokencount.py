"""Token counts under a unigram model, by dynamic programming over a trie.

A pre-token is a word with the white space before it (white space at the end of
a text is one of its own); tokens never cross pre-tokens.  The tokens of a
pre-token are the split of highest total log probability, of fewest tokens
among equals.  The forward score of a place depends on nothing but the bytes
before it, so pre-tokens that share a prefix share its scores: the distinct
pre-tokens of a batch are put into a trie, scores are computed once per node,
level by level, and each pre-token's count is stored at its terminal node.

The vocabulary is a public byte-level rank file (path as a parameter).  Such a
file has merge ranks and no probabilities, so by rule the piece of rank r has
probability proportional to 1 / (r + 1), the Zipf law for ranks.  Its 256
single bytes make every text splittable.

Every task makes its own tries, one for each slice of text: no shuffle, and
memory bounded by the slice.  Pre-tokens longer than ``TRIE`` bytes are scored
on their own by the same recurrence, over the pieces that an automaton finds in
one pass: time linear in the length, memory bounded by the longest piece.

Defined results: a null or empty text has 0 tokens; rows are counted one by
one, whatever their ids; an empty table gives an empty result.  Only doc_id and
text are read; further columns do not matter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import slices, span_hashes, word_bounds

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TRIE = 48
_BITS = 20
_M = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.float64(-1e18)


class Unigram:
    """Pieces and their log probabilities, ready for lookup by bytes and by hash."""

    def __init__(self, pieces: list[bytes]):
        weight = np.log(np.sum(1.0 / np.arange(1, len(pieces) + 1)))
        score = -np.log(np.arange(1, len(pieces) + 1)) - weight
        self.score = {p: float(s) for p, s in zip(pieces, score)}
        self.longest = max(map(len, pieces))
        self._automaton: ahocorasick.Automaton | None = None
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({len(p) for p in pieces}):
            of = [k for k, p in enumerate(pieces) if len(p) == n]
            raw = np.frombuffer(b"".join(pieces[k] for k in of), np.uint8).reshape(len(of), n)
            h = _row_hashes(raw)
            order = np.argsort(h)
            there = np.zeros(1 << _BITS, bool)
            there[h >> np.uint64(64 - _BITS)] = True
            self.by_length[n] = h[order], score[of][order], there

    def find(self, rows: np.ndarray) -> np.ndarray:
        """Score of each row of bytes, _NONE where it is no piece."""
        out = np.full(len(rows), _NONE)
        if rows.shape[1] in self.by_length:
            known, score, there = self.by_length[rows.shape[1]]
            h = _row_hashes(rows)
            maybe = np.flatnonzero(there[h >> np.uint64(64 - _BITS)])
            at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
            hit = known[at] == h[maybe]
            out[maybe[hit]] = score[at[hit]]
        return out

    def automaton(self) -> ahocorasick.Automaton:
        """Finds all pieces of a text in one pass; made when the first long pre-token comes up."""
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for piece, score in self.score.items():
                made.add_word(piece.decode("latin-1"), (len(piece), score))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token, by the recurrence over the pieces found in it.

        Every byte is a piece, so every place has a score; only the last
        ``longest`` places are kept.
        """
        ring = self.longest + 1
        totals, tokens = [0.0] * ring, [0] * ring
        at, best, fewest = 0, 0.0, 0
        for end, (size, score) in self.automaton().iter(word.decode("latin-1")):
            if end + 1 != at:
                totals[at % ring], tokens[at % ring] = best, fewest
                at, best, fewest = end + 1, _NONE, 0
            start = (at - size) % ring
            total, many = totals[start] + score, tokens[start] + 1
            if total > best or (total == best and many < fewest):
                best, fewest = total, many
        return fewest


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    h = np.full(len(rows), np.uint64(rows.shape[1]))
    for k in range(rows.shape[1]):
        h = (h ^ rows[:, k].astype(np.uint64)) * _M
        h ^= h >> np.uint64(32)
    return h


@lru_cache(maxsize=2)
def vocabulary(lines: bytes) -> Unigram:
    pairs = [line.split() for line in lines.splitlines() if line]
    return Unigram([base64.b64decode(p) for p, _ in sorted(pairs, key=lambda x: int(x[1]))])


def trie_counts(words: np.ndarray, length: np.ndarray, model: Unigram) -> np.ndarray:
    """Tokens of each distinct pre-token, given as rows of a zero-padded byte matrix."""
    n = len(words)
    counts = np.zeros(n, np.int64)
    node = np.zeros((n, int(length.max(initial=0)) + 1), np.int32)
    scores, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]
    prefix = np.zeros(n, np.uint64)
    for depth in range(1, node.shape[1]):
        alive = np.flatnonzero(length >= depth)
        prefix[alive] = (prefix[alive] ^ (words[alive, depth - 1].astype(np.uint64) + np.uint64(1))) * _M
        prefix[alive] ^= prefix[alive] >> np.uint64(31)
        _, first, mine = np.unique(prefix[alive], return_index=True, return_inverse=True)
        node[alive, depth] = mine
        made = alive[first]  # one pre-token for each new node
        best, fewest = np.full(len(made), _NONE), np.zeros(len(made), np.int64)
        for size in model.by_length:
            if size > depth:
                break
            score = model.find(words[made, depth - size : depth])
            hit = np.flatnonzero(score > _NONE)
            parent = node[made[hit], depth - size]
            total, many = scores[depth - size][parent] + score[hit], tokens[depth - size][parent] + 1
            better = (total > best[hit]) | ((total == best[hit]) & (many < fewest[hit]))
            best[hit[better]], fewest[hit[better]] = total[better], many[better]
        scores.append(best)
        tokens.append(fewest)
        done = alive[length[alive] == depth]
        counts[done] = fewest[node[done, depth]]
    return counts


def slice_counts(data: np.ndarray, off: np.ndarray, model: Unigram) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens and tokens of each document of a slice."""
    starts, ends, first = word_bounds(data, off)
    docs = len(off) - 1
    # A pre-token begins where the one before it ends, or with its document.
    begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    head = first[:-1][np.diff(first) > 0]
    begin[head] = off[:-1][np.diff(first) > 0]
    last_end = np.where(np.diff(first) > 0, ends[np.maximum(first[1:] - 1, 0)] if len(ends) else 0, off[:-1])
    tail = np.flatnonzero(last_end < off[1:])
    begin, end = np.concatenate([begin, last_end[tail]]), np.concatenate([ends, off[1:][tail]])
    owner = np.concatenate([np.repeat(np.arange(docs), np.diff(first)), tail])
    _, at, inverse = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
    lo, size = begin[at], end[at] - begin[at]
    counts = np.zeros(len(at), np.int64)
    short = np.flatnonzero(size <= TRIE)
    padded = np.concatenate([data, np.zeros(TRIE, np.uint8)])
    if len(short):
        rows = padded[lo[short][:, None] + np.arange(int(size[short].max()))]
        counts[short] = trie_counts(rows, size[short], model)
    for k in np.flatnonzero(size > TRIE):
        counts[k] = model.count(data[lo[k] : lo[k] + size[k]].tobytes())
    return np.bincount(owner, minlength=docs), np.bincount(owner, weights=counts[inverse], minlength=docs).astype(np.int64)


def count_tokens(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every document."""
    with open(path, "rb") as file:  # on the driver; a vocabulary is under 2 MB
        shared = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(shared.value)
        for batch in batches:
            for lo, hi, data, off in slices(batch.column("text")):
                pieces, tokens = slice_counts(data, off, model)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(pieces.astype(np.int64)), pa.array(tokens)], ["doc_id", "n_pretokens", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, n_pretokens long, n_tokens long")
