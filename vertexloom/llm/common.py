"""Shared pieces of the text operators: stage tables and numpy kernels over Arrow text.

The kernels work on the UTF-8 bytes of a slice of an Arrow string column, so a
batch of documents is tokenised and hashed by a few vector operations and no
Python loop runs over words. White space is ``[\\x20\\x09-\\x0D]``, which is
ASCII, so bytes and characters agree on word boundaries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import shared_dir

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


# -- stage tables ------------------------------------------------------------


class Stage:
    """Tables written to the shared folder by one run of an operator.

    A written table cuts the lineage, survives lost executors and lets the
    shuffle files behind it go; `drop` removes tables no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/vertexloom-{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.root}/{table}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")  # the table replaces the shuffle files behind it
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_fold(column: str) -> F.Column:
    """crc32 of the id as text, modulo 5; 0 is the held-out fold."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


# -- Arrow slices ------------------------------------------------------------


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about `limit` bytes of text: (slice, bytes, row offsets).

    A single row above the limit makes a slice of its own. Nulls have no bytes.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield batch.slice(lo, hi - lo), whole[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def ids_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)


# -- hashing -----------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        held = np.full(size, base, dtype=np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if size <= 1 << 23:
            _POWERS[base] = held
    return held[:n]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of symbol * base**i; differences give the hash of any span."""
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols.astype(np.uint64) * _powers(_BASE, len(symbols)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the symbols in [start, end); equal spans have equal hashes wherever they stand."""
    raw = (prefix[end] - prefix[start]) * _powers(_INVERSE, len(prefix))[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` symbols, by start."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = (prefix[width:] - prefix[:n]) * _powers(_INVERSE, n)
    return mix(raw + np.uint64(width * 0xD6E8FEB86659FD93 & _MASK))


# -- words -------------------------------------------------------------------


def words(buf: np.ndarray, off: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (one more at the end).

    solid: which bytes belong to words, where that is not all but white space.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~_SPACE[buf] if solid is None else solid
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(buf.astype(np.uint64) + np.uint64(1)), starts, ends)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes unchanged."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def row_of(first: np.ndarray) -> np.ndarray:
    """For each item the row it belongs to, from the rows' first items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value of each window of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, span = values, 1
    while span * 2 <= width:
        least = np.minimum(least[span:], least[: len(least) - span])
        span *= 2
    if span < width:
        least = np.minimum(least[width - span :], least[: len(least) - (width - span)])
    # the index moves on where a smaller value enters or the smallest one leaves
    where = np.zeros(n, np.int64)
    enters = np.flatnonzero(least[1:] < least[:-1]) + 1
    where[enters] = enters + width - 1
    leaves = np.append(0, np.flatnonzero(values[: n - 1] == least[:-1]) + 1)
    view = np.lib.stride_tricks.sliding_window_view(values, width)
    for lo in range(0, len(leaves), 1 << 14):
        at = leaves[lo : lo + (1 << 14)]
        where[at] = at + view[at].argmin(axis=1)
    return np.maximum.accumulate(where)


def list_array(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def binary_array(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column over one flat byte buffer; `first` has the byte offset of each row and the end."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
