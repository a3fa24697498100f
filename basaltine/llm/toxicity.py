"""Toxicity scores: character n-grams, naive-Bayes scaled logistic regression.

Features are the distinct character 3-, 4- and 5-grams of a text (case folded
per code point, padded by one space at both ends), hashed to 2**18 cells.  Each
feature is scaled by its naive-Bayes log-count ratio over the labelled rows; a
logistic regression on the scaled features gives the weights.

Defined results: a null or empty text is scored as the text of no words (its
score comes from the intercept and the padding); a null doc_id hashes as no
held-out row; repeated rows are scored alike; with no labelled row at all every
score is 0.0; rows whose label is null are not learnt from; labels that
disagree about one doc_id count as toxic; of texts that share a labelled doc_id
the first in order is learnt from.  Only the named columns are read, so
further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import slices

BITS = 18
GRAMS = (3, 4, 5)
#: Largest number of labelled rows that the model is fitted on.
FIT_ROWS = 6000
ITERATIONS = 50
FIT_BLOCK = 200
#: Text scored at a time; its n-grams take about 80 times as much.
SCORE_BYTES = 1 << 18
_DOCS = 1 << (32 - BITS)
_FOLD = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0xD800)] + list(range(0xD800, 0x10000)), np.uint32)


def gram_cells(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document << BITS | cell) keys of a slice, sorted, and nothing else."""
    head = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(head)])[off]
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    n = len(off) - 1
    low = codes < 0x10000
    codes = np.where(low, _FOLD[np.where(low, codes, 0)], codes)
    per_doc = np.diff(chars)
    doc = np.repeat(np.arange(n, dtype=np.uint32), per_doc)
    line = np.full(len(codes) + n + 1, 32, np.uint64)
    line[np.arange(len(codes)) + doc + 1] = codes
    stop = chars[1:] + np.arange(1, n + 1)
    owner = np.repeat(np.arange(n, dtype=np.uint32), per_doc + 1)
    keys, value = [], np.zeros(len(line), np.uint64)
    for k in range(1, max(GRAMS) + 1):
        value = value[: len(line) - k + 1] * np.uint64(0x100000001B3) + line[k - 1 :] if k > 1 else line.copy()
        if k not in GRAMS:
            continue
        m = min(len(value), len(owner))
        own = owner[:m]
        inside = np.arange(k - 1, m + k - 1) <= stop[own]
        cell = ((value[:m] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        keys.append(((own << np.uint32(BITS)) | cell.astype(np.uint32))[inside])
    every = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint32)
    fresh = np.ones(len(every), bool)
    fresh[1:] = every[1:] != every[:-1]
    return every[fresh], per_doc


def fit(blocks: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, rounds: int = ITERATIONS) -> np.ndarray:
    """Weights of all cells (already scaled by the log-count ratios), then the intercept.

    A block has the cells of up to ``FIT_BLOCK`` documents in a row and their
    numbers, so one block's values are in memory besides the cells.
    """
    size = 1 << BITS
    ones, zeros = float(toxic.sum()), float(len(toxic) - toxic.sum())
    if ones == 0 or zeros == 0:
        bias = np.log((ones + 0.5) / (zeros + 0.5)) if len(toxic) else -np.inf
        return np.concatenate([np.zeros(size), [bias]]).astype(np.float32)
    first = np.cumsum([0, *(len(length) for _, length in blocks)])

    def spread(by_doc: np.ndarray) -> np.ndarray:
        """Sum over each cell of a value of the documents that have it."""
        total = np.zeros(size)
        for lo, (flat, length) in zip(first, blocks):
            total += np.bincount(flat, weights=np.repeat(by_doc[lo : lo + len(length)], length), minlength=size)
        return total

    def sums(weights: np.ndarray) -> np.ndarray:
        """Sum over each document's cells of their weights."""
        out = []
        for flat, length in blocks:
            run = np.concatenate([[0.0], np.cumsum(weights[flat])])
            end = np.cumsum(length)
            out.append(run[end] - run[end - length])
        return np.concatenate(out)

    p, q = spread(toxic) + 1, spread(1 - toxic) + 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    w, bias = np.zeros(size), np.log(ones / zeros)
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = sums(w * ratio) + bias
        g = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - toxic
        gw = (spread(g) * ratio + w) / len(toxic)
        gb = g.mean()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.02 * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= 0.02 * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return np.concatenate([w * ratio, [bias]]).astype(np.float32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in slices(batch.column("text"), SCORE_BYTES, _DOCS):
            keys, _ = gram_cells(data, off)
            own = keys >> np.uint32(BITS)
            cut = np.searchsorted(own, np.arange(hi - lo + 1))
            cell = keys & np.uint32((1 << BITS) - 1)
            blobs = [cell[cut[k] : cut[k + 1]].tobytes() for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(lo, hi - lo), pa.array(blobs, pa.binary())], ["toxic", "cells"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks, toxic = [], []
    for batch in batches:
        toxic += batch.column("toxic").to_pylist()
        for lo in range(0, batch.num_rows, FIT_BLOCK):
            cells = [np.frombuffer(b.as_buffer(), np.int32) for b in batch.column("cells").slice(lo, FIT_BLOCK)]
            blocks.append((np.concatenate(cells), np.array([len(c) for c in cells])))
    yield pa.RecordBatch.from_arrays([pa.array([fit(blocks, np.array(toxic, float)).tobytes()], pa.binary())], ["model"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Fit on at most ``fit_rows`` labelled rows outside the held-out fifth.

    The rows are those of the smallest hashed ids, so the choice is the same
    on every run.  The fit is one task over at most ``fit_rows`` feature sets.
    """
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    # At most fit_rows rows of two numbers: a proven bound for the broadcast.
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    model = (
        texts.mapInArrow(_features, "toxic double, cells binary")
        .repartition(1).mapInArrow(_train, "model binary").first()
    )
    return np.frombuffer(bytes(model["model"]), np.float32)


def score(documents: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id and score of every row of ``documents``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**18 + 1 floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value[:-1].astype(np.float64)
        bias = float(shared.value[-1])
        for batch in batches:
            for lo, hi, data, off in slices(batch.column("text"), SCORE_BYTES, _DOCS):
                keys, _ = gram_cells(data, off)
                own = (keys >> np.uint32(BITS)).astype(np.int64)
                z = np.bincount(own, weights=weights[keys & np.uint32((1 << BITS) - 1)], minlength=hi - lo) + bias
                value = 1 / (1 + np.exp(-np.clip(z, -60, 60))) if np.isfinite(bias) else np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(value)], ["doc_id", "score"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def classify(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``documents``."""
    scored = score(documents, train(documents, labels, fit_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``documents`` that the classifier does not reject, columns unchanged.

    Scoring runs beside the scan and rows never move: no shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value[:-1].astype(np.float64)
        bias = float(shared.value[-1])
        for batch in batches:
            for lo, hi, data, off in slices(batch.column("text"), SCORE_BYTES, _DOCS):
                keys, _ = gram_cells(data, off)
                z = np.bincount((keys >> np.uint32(BITS)).astype(np.int64), weights=weights[keys & np.uint32((1 << BITS) - 1)], minlength=hi - lo) + bias
                yield batch.slice(lo, hi - lo).filter(pa.array(z < 0))

    return documents.mapInArrow(run, documents.schema)
