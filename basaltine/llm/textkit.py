"""Vectorised text primitives shared by the Arrow-based operators.

Everything works on the raw buffers of an Arrow string column: one uint8 array
of UTF-8 bytes and one offsets array.  A slice holds at most ``SLICE_BYTES`` of
text unless a single document is longer, so working memory is bounded by the
longest document, never by the partition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20
ARROW_BYTES = 8 << 20

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_C1 = np.uint64(0xFF51AFD7ED558CCD)
_C2 = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> _S)
    x *= _C1
    x ^= x >> _S
    x *= _C2
    x ^= x >> _S
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(1 << 16, n if n <= SLICE_BYTES + 1 else 1 << (n - 1).bit_length())
        for k, base in enumerate((_R, _R_INV)):
            steps = np.full(size, base & (2**64 - 1), np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (rebased to 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) pieces of a string column."""
    data, off = string_buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n, lo + rows)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of non-space bytes, never across documents.

    The third array gives, per document, the index of its first word (length n+1).
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal spans hash equally in every slice."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    value = (total[ends] - total[starts]) * inverse[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(_R_INV))


_SHINGLE = [np.uint64(pow(0xD6E8FEB86659FD93, 2 * k + 1, 1 << 64)) for k in range(64)]


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words and the document each belongs to.

    A document with 1 to size-1 words has one shingle, its whole sequence.
    """
    count = np.diff(first)
    per_doc = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), per_doc)
    if len(doc) == 0:
        return np.zeros(0, np.uint64), doc
    at = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + first[:-1][doc]
    length = np.minimum(count, size)[doc]
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    out = np.zeros(len(doc), np.uint64)
    short = bool((length < size).any())
    for k in range(size):
        term = padded[at + k] * _SHINGLE[k]
        out += np.where(length > k, term, np.uint64(0)) if short else term
    return mix(out + length.astype(np.uint64)), doc


def unique_per_doc(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, sorted by (document, value)."""
    if len(values) == 0:
        return values, doc
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[keep], doc[keep]


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is absent and all executors are threads of this machine
    (tests), a folder of this machine is set; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        jvm_dir = context._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="basaltine-")
        context.setCheckpointDir(folder)
    return folder


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ARROW_BYTES.

    Several of them stand in memory at once on both sides of a Python worker,
    and their buffers stay with the executor afterwards.
    """
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > ARROW_BYTES:
        spark.conf.set(_BATCH, ARROW_BYTES)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    This cuts lineage durably: the files outlive any executor, and go with the
    driver at the latest.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of stored frames that nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
