"""Removal of byte strings that an earlier document holds, by prefix-free parsing.

A byte of a document goes if it lies in a ``LENGTH``-byte string that also
starts in a document of smaller doc_id.  Strings are judged on the input.

Triggers are the local minima of a rolling hash of ``GRAM`` bytes: each string
of LENGTH bytes holds one that depends on that string alone.  The strings that
share a trigger occurrence follow each other; they and their bytes are a
phrase, and every string lies in exactly one phrase.  The parse is a document's
sequence of phrases; the dictionary holds the distinct ones.

1. Parse.  Trigger and phrase fingerprints are dealt out by trigger.  A phrase
   that an earlier document holds settles all its strings; a trigger seen in
   one kind of phrase only, or in one document, settles them too.
2. Dictionary.  For triggers in several phrases, one copy of each distinct
   phrase is fetched, from the first document that has it (the parse says
   which).  A suffix array over all suffixes of these, by prefix doubling up to
   LENGTH bytes, gives corpus order; runs of equal LENGTH-byte prefixes are the
   repeated strings, and the smallest document of a run is their first.
3. The answers, one bit a phrase and one bit a string of a fetched phrase, go
   back to the documents.

Texts travel as compressed chunks of about ``CHUNK`` bytes, dealt by chunk, so
no task depends on how many copies a document has.  A trigger's occurrences
meet in one task, at 12 bytes each, with buckets sized for ``BUCKET`` bytes of
text.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing;
a null doc_id counts as greater than any other; rows that share a doc_id do not
see each other, whatever their texts; an empty table gives an empty result.
Only doc_id and text are read; further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import mix, slices, span_hashes, stored

LENGTH = 50
GRAM = 24
CHUNK = 1 << 20
BUCKET = 4 << 20
_LAST = np.iinfo(np.int64).max
_CODEC = "zstd"
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _words(padded: np.ndarray, at: int, n: int) -> np.ndarray:
    """The 8 bytes from each position on, as one number each."""
    return np.ndarray((n,), "<u8", padded, at, (1,))


def phrases(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First string start, number of string starts and trigger hash of each phrase of a chunk, in order."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(LENGTH, np.uint8)])
    h = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        h ^= _words(padded, k, n)
        h *= _MULT[k // 8]
        h ^= h >> np.uint64(29)
    h = mix(h)
    # Leftmost minimum of the grams inside each string, position in the low bits.
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    reach, span = LENGTH - GRAM + 1, 1
    while span < reach:
        step = min(span, reach - span)
        np.minimum(low[: n - step], low[step:], out=low[: n - step]) if step < n else None
        span += step
    fits = np.ones(n + 1, np.int8)
    ends = off[1:]
    fits[n] = 0
    for back in range(1, LENGTH):
        at = ends - back
        fits[at[at >= off[:-1]]] = 0
    starts = np.flatnonzero(fits[:n])
    trigger = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    # Minima are small; mixed again they spread over all buckets.
    return starts[first], np.diff(np.append(first, len(starts))), mix(h[trigger[first]] + _MULT[0])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    serial = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        for lo, hi, data, off in slices(batch.column("text"), CHUNK, 1 << 20):
            part = ids.slice(lo, hi - lo)
            blob = pa.compress(data.tobytes(), codec=_CODEC, asbytes=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([serial]), pa.array([len(data)], pa.int64()), pa.array([np.asarray(part.fill_null(_LAST)).tobytes()], pa.binary()),
                 pa.array([np.asarray(part.is_null().cast(pa.uint8())).tobytes()], pa.binary()), pa.array([np.diff(off).tobytes()], pa.binary()), pa.array([blob], pa.binary())],
                ["chunk", "n_bytes", "ids", "no_id", "lengths", "text"])
            serial += 1


_CHUNKS = "chunk long, n_bytes long, ids binary, no_id binary, lengths binary, text binary"


def _open(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and ids of a chunk."""
    size = batch.column("n_bytes")[row].as_py()
    data = np.frombuffer(pa.decompress(batch.column("text")[row].as_buffer(), size, codec=_CODEC, asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    lengths = np.frombuffer(batch.column("lengths")[row].as_py(), np.int64)
    return data, np.concatenate([[0], np.cumsum(lengths)]), np.frombuffer(batch.column("ids")[row].as_py(), np.int64)


def _by_bucket(trigger: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of phrases by bucket (then place), and where each bucket begins."""
    bucket = (trigger >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(trigger), np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange((1 << bits) + 1))


def _parse(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data, off, ids = _open(batch, row)
                start, count, trigger = phrases(data, off)
                if not len(start):
                    continue
                print_ = span_hashes(data, start, start + count + LENGTH - 1)
                doc = np.searchsorted(off, start, "right") - 1
                order, cut = _by_bucket(trigger, bits)
                rest = ((trigger[order] >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                print_, doc = print_[order], doc[order]
                out: list[tuple] = []
                for b in np.flatnonzero(np.diff(cut)):
                    piece = slice(cut[b], cut[b + 1])
                    d = doc[piece]
                    head = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                    runs = np.diff(np.append(head, len(d)))
                    f = print_[piece]
                    out.append((int(b), rest[piece].tobytes(), f.astype(np.uint32).tobytes(), (f >> np.uint64(48)).astype(np.uint16).tobytes(), ids[d[head]].tobytes(), runs.astype(np.uint8 if runs.max() < 256 else np.uint32).tobytes()))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array([batch.column("chunk")[row].as_py()] * len(out), pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                    ["bucket", "chunk", "g", "f_low", "f_high", "docs", "runs"])

    return run


_PARSE = "bucket int, chunk long, g binary, f_low binary, f_high binary, docs binary, runs binary"


def _join(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])


def _settle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each phrase of a bucket: does an earlier document hold it, and are its bytes wanted."""
    g = _join(table, "g", np.uint32)
    f = _join(table, "f_low", np.uint32).astype(np.uint64) | (_join(table, "f_high", np.uint16).astype(np.uint64) << np.uint64(32))
    docs = []
    for blob, runs in zip(table.column("docs").to_pylist(), table.column("runs").to_pylist()):
        ids = np.frombuffer(blob, np.int64)
        docs.append(np.repeat(ids, np.frombuffer(runs, np.uint8 if len(runs) == len(ids) else np.uint32)))
    doc = np.concatenate(docs)
    order = np.lexsort((doc, f, g))
    g, f, doc = g[order], f[order], doc[order]
    new_g = np.concatenate([[True], g[1:] != g[:-1]])
    new_f = new_g | np.concatenate([[True], f[1:] != f[:-1]])
    first = doc[np.flatnonzero(new_f)][np.cumsum(new_f) - 1]
    at_g, of_g = np.flatnonzero(new_g), np.cumsum(new_g) - 1
    several = (np.add.reduceat(new_f.astype(np.int64), at_g) > 1) & (np.minimum.reduceat(doc, at_g) < np.maximum.reduceat(doc, at_g))
    known, wanted = np.zeros(len(g), bool), np.zeros(len(g), bool)
    known[order] = doc > first
    wanted[order] = several[of_g] & (doc == first)
    cut = np.cumsum([0] + [len(x) // 4 for x in table.column("g").to_pylist()])
    pieces = lambda bits: [np.packbits(bits[lo:hi]).tobytes() for lo, hi in zip(cut[:-1], cut[1:])]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "known": pa.array(pieces(known), pa.binary()), "wanted": pa.array(pieces(wanted), pa.binary())})


def _bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _answers(batch: pa.RecordBatch, row: int, name: str, cut: np.ndarray) -> np.ndarray:
    out = np.zeros(int(cut[-1]), bool)
    for one in batch.column("answers")[row].as_py() or []:
        lo, hi = cut[one["bucket"]], cut[one["bucket"] + 1]
        out[lo:hi] = _bits(one[name], hi - lo)
    return out


def _fetch(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data, off, ids = _open(batch, row)
                start, count, trigger = phrases(data, off)
                order, cut = _by_bucket(trigger, bits)
                wanted = _answers(batch, row, "wanted", cut)
                bucket = np.repeat(np.arange(len(cut) - 1), np.diff(cut))[wanted]
                pick = order[wanted]
                if not len(pick):
                    continue
                size = count[pick] + LENGTH - 1
                doc = ids[np.searchsorted(off, start[pick], "right") - 1]
                where = np.repeat(start[pick] - np.cumsum(size) + size, size) + np.arange(size.sum())
                bytes_, edge = data[where], np.concatenate([[0], np.cumsum(size)])
                part = np.searchsorted(bucket, np.arange(len(cut)))
                out = [(int(b), bytes_[edge[part[b]] : edge[part[b + 1]]].tobytes(), size[part[b] : part[b + 1]].astype(np.uint8).tobytes(), doc[part[b] : part[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(part))]
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([batch.column("chunk")[row].as_py()] * len(out), pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["bucket", "chunk", "bytes", "sizes", "docs"])

    return run


def suffix_ranks(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array order and rank, by the first LENGTH bytes, of every suffix of the phrases that is as long.

    Ranks double their depth: 8 bytes come from the text, 16, 32 and 48 from
    pairs of ranks, and the last round overlaps to end at LENGTH.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(LENGTH, np.uint8)])
    key = np.ndarray((n,), ">u8", padded, 0, (1,)).astype(np.uint64)
    rank, depth = _rank(key), 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        ahead = np.zeros(n, np.uint64)
        ahead[: n - step] = rank[step:]
        rank = _rank((rank << np.uint64(32)) | ahead)
        depth += step
    end = np.cumsum(size)
    count = size - LENGTH + 1
    at = np.repeat(end - size - np.cumsum(count) + count, count) + np.arange(count.sum())
    return at, rank[at]


def _rank(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    ordered = key[order]
    step = np.ones(len(key), np.uint64)
    step[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(step)
    return rank


def _sorted_runs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each string of each fetched phrase: does a smaller document hold it."""
    size = _join(table, "sizes", np.uint8).astype(np.int64)
    doc = _join(table, "docs", np.int64)
    _, rank = suffix_ranks(_join(table, "bytes", np.uint8), size)
    count = size - LENGTH + 1
    owner = np.repeat(doc, count)
    order = np.argsort(rank, kind="stable")
    ordered = rank[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    least = np.minimum.reduceat(owner[order], np.flatnonzero(head))[np.cumsum(head) - 1]
    repeated = np.zeros(len(rank), bool)
    repeated[order] = owner[order] > least
    cut = np.concatenate([[0], np.cumsum(count)])[np.cumsum([0] + [len(x) for x in table.column("sizes").to_pylist()])]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "repeated": pa.array([np.packbits(repeated[lo:hi]).tobytes() for lo, hi in zip(cut[:-1], cut[1:])], pa.binary())})


def _remove(bits: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data, off, ids = _open(batch, row)
                start, count, trigger = phrases(data, off)
                order, cut = _by_bucket(trigger, bits)
                known, wanted = _answers(batch, row, "known", cut), _answers(batch, row, "wanted", cut)
                hit = np.zeros(len(data) + 1, bool)
                for at, many in ((start[order][known], count[order][known]),):
                    hit[np.repeat(at - np.cumsum(many) + many, many) + np.arange(many.sum())] = True
                bucket = np.repeat(np.arange(len(cut) - 1), np.diff(cut))[wanted]
                at, many = start[order][wanted], count[order][wanted]
                edge = np.concatenate([[0], np.cumsum(many)])
                every = np.repeat(at - edge[:-1], many) + np.arange(edge[-1])
                for one in batch.column("runs")[row].as_py() or []:
                    lo, hi = edge[np.searchsorted(bucket, [one["bucket"], one["bucket"] + 1])]
                    hit[every[lo:hi][_bits(one["repeated"], hi - lo)]] = True
                begins = np.cumsum(np.concatenate([[0], hit[:-1]]))
                reach = np.arange(len(data))
                covered = begins[reach + 1] - begins[np.maximum(reach - LENGTH + 1, 0)] > 0
                none = np.frombuffer(batch.column("no_id")[row].as_py(), bool)
                out = []
                for k in range(len(ids)):
                    lo, hi = off[k], off[k + 1]
                    gone = covered[lo:hi]
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    kept = data[lo:hi] if not len(turn) else data[lo:hi][~gone]
                    out.append((None if none[k] else int(ids[k]), hi - lo, int(gone.sum()), len(turn) // 2, hashlib.sha256(kept.tobytes()).hexdigest(), turn.reshape(-1, 2).tolist()))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.int64()) for c in cols[1:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.list_(pa.list_(pa.int64())))], names)

    return run


def repeated_spans(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans [start, end) of every document."""
    chunks = stored(documents.select("doc_id", "text").mapInArrow(_pack, _CHUNKS), "chunks")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(0, (max(1, -(-total // BUCKET)) - 1).bit_length())
    parse = chunks.mapInArrow(_parse(bits), _PARSE)
    settled = stored(parse.groupBy("bucket").applyInArrow(_settle, "chunk long, bucket int, known binary, wanted binary"), "settled")
    answers = settled.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "known", "wanted")).alias("answers"))
    asked = chunks.join(answers, "chunk", "left")
    fetched = asked.mapInArrow(_fetch(bits), "bucket int, chunk long, bytes binary, sizes binary, docs binary")
    runs = fetched.groupBy("bucket").applyInArrow(_sorted_runs, "chunk long, bucket int, repeated binary").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "repeated")).alias("runs"))
    return asked.join(runs, "chunk", "left").mapInArrow(_remove(bits), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
