"""Exact top-k inner products through a pivot-distance index.

The index is never shuffled again once written: a bounded block of queries goes to
every task, which runs over its annuli. A first pass gives each query the annuli of
its nearest pivot, and so a k-th best score; the second gives it only those annuli
of other pivots whose bound, by the triangle inequality, reaches that score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, ids_of

#: Vectors read to choose pivots, rows of an annulus, annuli of a partition of the index.
PIVOTS = 64
ANNULUS = 1024
SHARD = 48
#: Bytes of queries to a block; every block takes two passes over the index.
QUERY_BYTES = 16 << 20
#: Candidates held by a task before they are cut down to the k best of each query.
HELD = 1 << 21


def _ints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors as packed 64-bit integers: floor(64 * x)."""
    for batch in batches:
        ids, out = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or v is None or any(x is None for x in v):
                continue
            x = np.array(v, np.float64)
            if np.isfinite(x).all():
                ids.append(i)
                out.append(np.floor(64.0 * x).astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])


def _rows(column: pa.Array, d: int) -> np.ndarray:
    """Packed vectors as a matrix of d columns; shorter ones end in zeros."""
    raw = [np.frombuffer(x.as_buffer(), np.int64) for x in column]
    if all(len(x) == d for x in raw):
        return np.concatenate(raw).reshape(len(raw), d) if raw else np.zeros((0, d), np.int64)
    out = np.zeros((len(raw), d), np.int64)
    for i, x in enumerate(raw):
        out[i, : len(x)] = x
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; by floats where these are exact."""
    d = a.shape[1]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, d)
    if most < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Geometry:
    """Inner products as distances: every vector gets one more component so that all have norm `top`; a query's is 0."""

    def __init__(self, pivots: np.ndarray, top2: float):
        self.pivots, self.top2 = pivots.astype(np.float64), top2
        self.lift = np.sqrt(np.maximum(top2 - (self.pivots**2).sum(1), 0))

    def of_vectors(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        lift = np.sqrt(np.maximum(self.top2 - (v**2).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.top2 - 2 * (v @ self.pivots.T + lift[:, None] * self.lift[None]), 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(np.float64)
        return np.sqrt(np.maximum((q**2).sum(1)[:, None] + self.top2 - 2 * (q @ self.pivots.T), 0))


def build_index(vectors: DataFrame, stage: Stage, d: int, geometry: Geometry, rows: int) -> DataFrame:
    """Annuli: pivot, low, high (distances to it), ids, rows, vecs. Every vector is in exactly one.

    Rows are dealt by ranges of (pivot, distance, id), so a pivot that most vectors
    are nearest to, or a vector that repeats, spans as many annuli as it needs, and
    a pivot's annuli stand together in order.
    """

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dist = geometry.of_vectors(_rows(batch.column(2), d))
                k = dist.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k.astype(np.int32)), pa.array(dist[np.arange(len(k)), k])], names=["_row", "vec_id", "v", "pivot", "dist"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, dist, v = ids_of(batch, "pivot"), ids_of(batch, "dist"), _rows(batch.column(2), d)
            row, vec = ids_of(batch, "_row"), ids_of(batch, "vec_id")
            cut = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1])) if len(pivot) else []
            for a, b in zip(cut, [*cut[1:], len(pivot)], strict=True):
                for lo in range(a, b, ANNULUS):
                    hi = min(b, lo + ANNULUS)
                    yield pa.RecordBatch.from_arrays([pa.array([pivot[lo]]), pa.array([dist[lo:hi].min()]), pa.array([dist[lo:hi].max()]), *(pa.array([x[lo:hi].tobytes()]) for x in (vec, row, v))], names=["pivot", "low", "high", "ids", "rows", "vecs"])

    keyed = vectors.select("_row", "vec_id", "v").mapInArrow(nearest, "_row long, vec_id long, v binary, pivot int, dist double")
    parts = max(8, rows // (ANNULUS * SHARD))
    ranged = keyed.repartitionByRange(parts, "pivot", "dist", "vec_id", "_row").sortWithinPartitions("pivot", "dist", "vec_id", "_row")
    return stage.write(ranged.mapInArrow(pack, "pivot int, low double, high double, ids binary, rows binary, vecs binary"), "index")


class Annulus(NamedTuple):
    pivot: int
    low: float
    high: float
    ids: np.ndarray
    rows: np.ndarray
    vecs: np.ndarray


class Asked:
    """A block of queries: their ids, rows and vectors, and the scores below which a candidate is out."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vecs: np.ndarray, geometry: Geometry, floor: np.ndarray | None = None):
        self.ids, self.rows, self.vecs = ids, rows, vecs
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.to_pivot = geometry.of_queries(vecs)
        self.nearest = self.to_pivot.argmin(1) if len(ids) else np.zeros(0, np.int64)
        self.norm = (vecs.astype(np.float64) ** 2).sum(1) + geometry.top2

    def bound(self, a: Annulus) -> np.ndarray:
        """What no vector of the annulus can score above, for every query."""
        to = self.to_pivot[:, a.pivot]
        gap = np.maximum(0, np.maximum(to - a.high, a.low - to))
        return (self.norm - gap**2) / 2 + 1e-9 * np.maximum(self.norm, 1) + 1e-3


class Best:
    """The k best (query, id, score) so far, ties to the smaller id, and each query's k-th best score."""

    def __init__(self, asked: Asked, k: int):
        self.k, self.worst, self.held = k, asked.floor.copy(), []
        self.size = self.skipped = self.met = 0

    def add(self, asked: Asked, a: Annulus, want: np.ndarray) -> None:
        self.met += len(want)
        for lo in range(0, len(want), 4096):
            part = want[lo : lo + 4096]
            s = products(asked.vecs[part], a.vecs)
            least = self.worst[part]
            if s.shape[1] > self.k:
                least = np.maximum(least, np.partition(s, -self.k - 1, axis=1)[:, -self.k - 1])  # one more, for the query's own row
            r, c = np.nonzero(s >= least[:, None])
            other = a.rows[c] != asked.rows[part[r]]
            r, c = r[other], c[other]
            self.held.append((part[r], a.ids[c], s[r, c]))
            self.size += len(r)
            if self.size > HELD:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        row, vid, score = (np.concatenate([none, *x]) for x in zip(*self.held, strict=True)) if self.held else (none, none, none)
        order = np.lexsort((vid, -score, row))
        row, vid, score = row[order], vid[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        full = place == self.k - 1
        self.worst[row[full]] = np.maximum(self.worst[row[full]], score[full])
        keep = place < self.k
        self.held, self.size = [(row[keep], vid[keep], score[keep])], int(keep.sum())
        return self.held[0]


def search(annuli: Iterator[Annulus], asked: Asked, k: int, near: bool) -> Best:
    """near: the annuli of each query's nearest pivot. Otherwise those of other pivots whose bound reaches the query's k-th best score."""
    best = Best(asked, k)
    for a in annuli:
        mine = asked.nearest == a.pivot
        want = np.flatnonzero(mine if near else ~mine & (asked.bound(a) >= best.worst))
        best.skipped += 0 if near else int((~mine).sum()) - len(want)
        if len(want):
            best.add(asked, a, want)
    return best


def top_products(table: DataFrame, k: int = 20, every: int = 20, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products, ties to the smaller id.

    Components become floor(64 * x). Queries are the rows whose vec_id is divisible
    by `every`; candidates are all rows but the query's own, so rows that repeat an
    id are queries and candidates each. Vectors that are null or hold nulls or
    non-finite numbers, and null ids, take no part; a shorter vector counts as
    ending in zeros. `pivots` vectors, first by a hash of the id, are read to shape
    the index; every vector is indexed. Other columns are ignored; an empty table
    gives no rows.
    """
    spark = table.sparkSession
    stage = Stage(spark, "topk")
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")).mapInArrow(_ints, "vec_id long, v binary")
    vectors = stage.write(vectors.withColumn("_row", F.monotonically_increasing_id()), "vectors")  # a row's number is fixed where it is written
    rows, d = vectors.agg(F.count("*"), F.max(F.length("v"))).first()
    d = (d or 0) // 8

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float((_rows(batch.column(0), d).astype(np.float64) ** 2).sum(1).max())])], names=["n"])

    top2 = vectors.select("v").mapInArrow(norms, "n double").agg(F.max("n")).first()[0] or 0.0
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "_row").limit(pivots).collect()
    held = np.zeros((max(1, len(chosen)), d), np.int64)
    for i, r in enumerate(chosen):
        x = np.frombuffer(r.v, np.int64)
        held[i, : len(x)] = x
    geometry = Geometry(held, top2)
    index = build_index(vectors, stage, d, geometry, rows)
    queries = vectors.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() * max(1, 8 * d) // QUERY_BYTES))
    kind = "query int, vec_id long, score long"
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")

    def scan(asked: Asked, near: bool) -> DataFrame:
        """The k best that each task finds."""
        sent = spark.sparkContext.broadcast((asked.ids, asked.rows, asked.vecs, asked.floor))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def annuli() -> Iterator[Annulus]:
                for batch in batches:
                    for p, low, high, *raw in zip(*(batch.column(i) for i in range(6)), strict=True):
                        ids, row, v = (np.frombuffer(x.as_buffer(), np.int64) for x in raw)
                        yield Annulus(p.as_py(), low.as_py(), high.as_py(), ids, row, v.reshape(len(ids), d))

            ids, rows, vecs, floor = sent.value
            row, vid, score = search(annuli(), Asked(ids, rows, vecs, geometry, floor), k, near).cut()
            yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(vid), pa.array(score)], names=["query", "vec_id", "score"])

        return index.mapInArrow(run, kind).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == block).orderBy("vec_id", "_row").collect()
        q = np.zeros((len(mine), d), np.int64)
        for i, r in enumerate(mine):
            x = np.frombuffer(r.v, np.int64)
            q[i, : len(x)] = x
        asked = Asked(np.array([r.vec_id for r in mine], np.int64), np.array([r._row for r in mine], np.int64), q, geometry)
        near = stage.write(scan(asked, True), f"near/block={block}")
        for r in near.where(F.col("rank") == k).select("query", "score").collect():
            asked.floor[r.query] = r.score
        far = scan(asked, False).unionByName(near).drop("rank").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, int(r.vec_id)) for i, r in enumerate(mine)], "query int, query_id long")
        stage.write(far.join(F.broadcast(names), "query").select("query_id", "rank", "vec_id", "score"), f"found/block={block}")
    stage.drop("vectors", "index", "near")
    return spark.read.schema("query_id long, rank int, vec_id long, score long, block int").parquet(f"{stage.root}/found").drop("block")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Brute force over all pairs; `floor` of doubles and integer sums agree with the index exactly.
OP8_SQL = """
with v as (
  select row_number() over () as id, vec_id, [floor(64 * x::double)::bigint for x in embedding] as e from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.id, q.vec_id as query_id, c.vec_id, list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)])::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.id <> c.id),
r as (select query_id, row_number() over (partition by id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

__all__ = ["OP8_SQL", "Annulus", "Asked", "Geometry", "build_index", "op8_topk", "products", "search", "top_products"]
