"""Dense text features and a linear model fitted by averaged local descent over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, ids_of, list_array, pieces, word_hashes, words

# The byte classes whose shares are features.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", "|", "#", "$", "%", "&", "*", "-_=~", "'\"`", "()[]{}<>", "/\\:", "@", "+^;"]
_OF_BYTE = np.full(256, len(_CLASSES), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _OF_BYTE[[ord(x) for x in _c]] = _i
N_CLASS = len(_CLASSES) + 1
N_DENSE = N_CLASS + 12


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def dense_features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of shape features for each text; an empty text has zeros."""
    n = len(off) - 1
    out = np.zeros((n, N_DENSE), np.float32)
    length = np.diff(off).astype(np.float64)
    safe = np.maximum(length, 1)
    rows = np.repeat(np.arange(n), np.diff(off))
    counts = np.bincount(rows * N_CLASS + _OF_BYTE[buf], minlength=n * N_CLASS).reshape(n, N_CLASS)
    out[:, :N_CLASS] = np.log1p(200 * counts / safe[:, None])
    starts, ends, first = words(buf, off)
    n_words = np.diff(first).astype(np.float64)
    some = np.maximum(n_words, 1)
    size = (ends - starts).astype(np.float64)
    hashes = word_hashes(buf, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=n)
    runs = np.diff(np.flatnonzero(np.append(new, True)))
    top = np.zeros(n)
    np.maximum.at(top, owner[order][new], runs)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    lone = (size == 1).astype(np.float64)
    last = buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    marked = (~((_OF_BYTE[last] <= 2) | (last >= 128) | (last == 46) | (last == 44))).astype(np.float64)
    upper = (_OF_BYTE[buf[starts]] == 1) if len(starts) else np.zeros(0, bool)
    caps = (upper & (_OF_BYTE[buf[np.maximum(starts, ends - 2)]] == 1) & (size > 1)).astype(np.float64) if len(starts) else np.zeros(0)
    mean = _per_row(size, first) / some
    lines = counts[:, 4] + 1
    extra = [np.log1p(length), np.log1p(n_words), mean / 10, np.sqrt(np.maximum(0, _per_row(size * size, first) / some - mean**2)) / 10, distinct / some, top / some, _per_row(again, first) / some, _per_row(lone, first) / some, _per_row(marked, first) / some, _per_row(caps, first) / some, np.log1p(n_words / lines), (length == 0).astype(np.float64)]
    out[:, N_CLASS:] = np.stack(extra, 1)
    return out


def feature_table(docs: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """doc_id, fold, x (array of floats) for every row; kernel maps (bytes, offsets) to a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in pieces(batch, "text"):
                x = kernel(buf, off)
                first = np.arange(len(x) + 1) * x.shape[1]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), list_array(x.ravel(), first, pa.float32())], names=["doc_id", "fold", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), crc_fold("doc_id").cast("int").alias("fold"), "text").mapInArrow(run, "doc_id long, fold int, x array<float>")


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(column))
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


CHUNK = 4096
#: Partitions whose vectors one task of the first round adds.
FAN_IN = 256


def summed(table: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], width: int) -> np.ndarray:
    """The sum over all partitions of a vector that the kernel makes of each.

    A wide vector is sent in packed chunks, which are added in two rounds; a narrow
    one as rows. Only `width` sums come to the driver.
    """
    out = np.zeros(width)
    if width <= CHUNK:

        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = kernel(batches)
            if v is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(v, pa.float64())], names=["i", "v"])

        for r in table.mapInArrow(rows_of, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r.i] = r.v
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, part = kernel(batches), TaskContext.get().partitionId()
        if v is not None:
            chunks = [np.ascontiguousarray(v[lo : lo + CHUNK], np.float64).tobytes() for lo in range(0, width, CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([part] * len(chunks), pa.int32()), pa.array(chunks, pa.binary())], names=["chunk", "part", "v"])

    def add(rows: pa.Table) -> pa.Table:
        parts = rows.column("part").to_pylist()
        held = dict(zip(parts, rows.column("v"), strict=True))
        total = sum(np.frombuffer(held[p].as_buffer(), np.float64) for p in sorted(held))
        return pa.table({"chunk": rows.column("chunk")[:1], "part": pa.array([min(parts) // FAN_IN], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    kind = "chunk int, part int, v binary"
    sums = table.mapInArrow(run, kind).groupBy("chunk", F.expr(f"part div {FAN_IN}")).applyInArrow(add, kind).groupBy("chunk").applyInArrow(add, kind)
    for r in sums.collect():
        v = np.frombuffer(r.v, np.float64)
        out[r.chunk * CHUNK : r.chunk * CHUNK + len(v)] = v
    return out


def moments(table: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and standard deviation of every feature over all rows, and their number."""

    def kernel(batches):
        acc = np.zeros(2 * d + 1)
        for b in batches:
            x = matrix(b).astype(np.float64)
            if len(x):
                acc += np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])
        return acc if acc[-1] else None

    s = summed(table, kernel, 2 * d + 1)
    n = max(1.0, s[-1])
    mean = s[:d] / n
    return mean, np.sqrt(np.maximum(s[d : 2 * d] / n - mean**2, 1e-6)), int(s[-1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def averaged_descent(table: DataFrame, w: np.ndarray, gradient: Callable[[np.ndarray, np.ndarray, np.ndarray | None, np.random.Generator], np.ndarray], rounds: int, rate: float, mean: np.ndarray, dev: np.ndarray, target: str | None = None, batch_rows: int = 128) -> np.ndarray:
    """Each round, every partition descends from the common weights over its own rows; the weights are averaged by rows.

    gradient(w, x, y, rng) is the gradient of the mean loss of a minibatch; x has
    a last column of ones, rng is seeded by round and partition and goes on from
    step to step. All rows take part in every round.
    """
    d = len(w)
    for turn in range(rounds):
        step, at = rate / (1 + turn), w

        def kernel(batches, at=at, step=step, turn=turn):
            v, n, g2 = at.copy(), 0, np.full(d, 1e-4)
            rng = np.random.default_rng([turn, TaskContext.get().partitionId()])
            for b in batches:
                x = np.hstack([(matrix(b) - mean) / dev, np.ones((b.num_rows, 1))]).clip(-8, 8)
                y = ids_of(b, target).astype(np.float64) if target else None
                for lo in range(0, len(x), batch_rows):
                    g = gradient(v, x[lo : lo + batch_rows], None if y is None else y[lo : lo + batch_rows], rng)
                    g2 = 0.95 * g2 + 0.05 * g * g
                    v = v - step * g / (np.sqrt(g2) + 1e-3)
                n += len(x)
            return np.append(v * n, n) if n else None

        s = summed(table, kernel, d + 1)
        if s[-1]:
            w = s[:-1] / s[-1]
    return w


def linear_scores(x: np.ndarray, w: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> np.ndarray:
    return sigmoid(np.hstack([(x - mean) / dev, np.ones((len(x), 1))]).clip(-8, 8) @ w)


def scored(table: DataFrame, w: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> DataFrame:
    """doc_id, held_out, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids_of(b, "fold") == 0), pa.array(linear_scores(matrix(b), w, mean, dev))], names=["doc_id", "held_out", "score"])

    return table.mapInArrow(run, "doc_id long, held_out boolean, score double")


def labelled(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """doc_id and the label of at most `bound` training rows, the first by a hash of the id.

    Ids in the held-out fold never take part. An id with conflicting or null labels has none.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (crc_fold("doc_id") != 0))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(column).cast("int").alias("y"), F.max(column).cast("int").alias("_most")).where("y = _most")
    return rows.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
