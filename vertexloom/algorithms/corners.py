"""Triangles, counted with numpy in parts of a graph that are dealt out by ranges of ids."""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Edges that one task holds, ranges at first, edges buffered before they are dealt out, and wedges tested at a time.
HELD = 3 << 20
RANGES = 256
DEALT = 1 << 20
STEP = 1 << 21


def closed(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each triangle of the simple edges once, as corners in arrays of bounded length.

    Edges point from the lower (degree, id) to the higher, so no vertex starts more
    than sqrt(2 * edges) of them and a hub makes few wedges. A wedge u, v, w is kept
    where u, w is an edge: a hash table sorts most out, a search proves the rest.
    """
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(ids)
    rank = np.empty(n, np.int64)
    order = np.argsort(np.bincount(ends, minlength=n), kind="stable")
    rank[order] = np.arange(n)
    ids, x, y = ids[order], rank[ends[: len(a)]], rank[ends[len(a) :]]
    keys = np.sort(np.minimum(x, y) * n + np.maximum(x, y))
    src, dst = np.divmod(keys, n)
    start = np.searchsorted(src, np.arange(n + 1))
    wedges = np.concatenate([[0], np.cumsum(start[dst + 1] - start[dst])])
    mask = (1 << max(10, min(22, 5 + int(len(keys)).bit_length()))) - 1
    table = np.zeros(mask + 1, bool)
    slot = lambda k: ((k * np.int64(0x9E3779B97F4A7C1)) >> 20) & mask
    lo = 0
    while lo < len(keys):
        hi = max(start[src[lo] + 1], start[src[min(lo + (mask >> 6) + 1, len(keys) - 1)]])  # whole lists of some sources
        own = keys[lo:hi]
        slots = slot(own)
        table[slots] = True
        at = lo
        while at < hi:
            to = min(hi, max(at + 1, int(np.searchsorted(wedges, wedges[at] + STEP, "right")) - 1))
            count = start[dst[at:to] + 1] - start[dst[at:to]]
            edge = np.repeat(np.arange(at, to), count)
            w = dst[np.arange(len(edge)) + np.repeat(start[dst[at:to]] - (wedges[at:to] - wedges[at]), count)]
            seek = src[edge] * n + w
            some = np.flatnonzero(table[slot(seek)])
            found = np.searchsorted(own, seek[some])
            some = some[own[np.minimum(found, len(own) - 1)] == seek[some]]
            yield ids[src[edge[some]]], ids[dst[edge[some]]], ids[w[some]]
            at = to
        table[slots] = False
        lo = hi


def _parts(cells: dict[tuple[int, int], int], p: int) -> list[tuple[tuple[int, int, int], int]]:
    """((i, j, k), edges) of the triples of ranges, i <= j <= k, that a triangle can have its corners in."""
    near = defaultdict(set)
    for i, j in cells:
        near[i].add(j)
    out = []
    for i in range(p):
        after = sorted(near[i])
        for j, k in [*combinations(after, 2), *((j, j) for j in after)]:
            if k in near[j]:
                out.append(((i, j, k), sum(cells[c] for c in {(i, j), (j, k), (i, k)})))
    return out


def _dealt(simple: DataFrame) -> tuple[np.ndarray, dict[tuple[int, int], list[int]], list[tuple[int, int, int]]]:
    """Bounds of the ranges, the parts that each cell of edges goes to, and the parts.

    The fewest ranges of even weight for which no part has more than HELD edges. With
    ranges that are tied to all others an edge goes to about as many parts as there are
    ranges; where ids that are near are tied, to three or so.
    """
    low, high = simple.approxQuantile(["a", "b"], [i / RANGES for i in range(1, RANGES)], 0.001) or [[], []]
    fine = np.unique(np.sort(np.array([*low, *high]))[::2].astype(np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fine) + 1) ** 2, np.int64)
        for batch in batches:
            a, b = (np.searchsorted(fine, batch.column(c).to_numpy(), "right") for c in (0, 1))
            total += np.bincount(a * (len(fine) + 1) + b, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    total = np.zeros((len(fine) + 1) ** 2, np.int64)
    for r in simple.select("a", "b").mapInArrow(count, "cell long, n long").groupBy("cell").sum("n").collect():
        total[r[0]] = r[1]
    total = total.reshape(len(fine) + 1, -1)
    p = 1
    while True:
        first = np.unique(np.arange(p) * len(total) // p)
        merged = np.add.reduceat(np.add.reduceat(total, first, 0), first, 1)
        cells = {(int(i), int(j)): int(merged[i, j]) for i, j in np.argwhere(merged)}
        parts = _parts(cells, len(first))
        if len(first) == len(total) or max((n for _, n in parts), default=0) <= HELD:
            break
        p = p + max(1, p // 4)
    to = defaultdict(list)
    for t, ((i, j, k), _) in enumerate(parts):
        for c in {(i, j), (j, k), (i, k)}:
            to[c].append(t)
    return fine[first[1:] - 1], to, [x for x, _ in parts]


def corner_counts(simple: DataFrame) -> DataFrame:
    """id, triangles of every vertex that has any, of simple edges (a < b) that are read more than once."""
    bounds, to, parts = _dealt(simple)
    cells = len(bounds) + 1
    begin, goes = np.zeros(cells * cells + 1, np.int64), []
    for c in range(cells * cells):
        goes += to.get(divmod(c, cells), [])
        begin[c + 1] = len(goes)
    sent = simple.sparkSession.sparkContext.broadcast((bounds, begin, np.array(goes, np.int64), np.array(parts, np.int64).reshape(-1, 3)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, begin, goes, _ = sent.value

        def flush(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            cell = np.searchsorted(bounds, a, "right") * (len(bounds) + 1) + np.searchsorted(bounds, b, "right")
            order = np.argsort(cell, kind="stable")
            cell, a, b = cell[order], a[order], b[order]
            here, first = np.unique(cell, return_index=True)
            rows = [(t, a[lo:hi].tobytes(), b[lo:hi].tobytes()) for c, lo, hi in zip(here, first, [*first[1:], len(cell)], strict=True) for t in goes[begin[c] : begin[c + 1]]]
            part, x, y = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["part", "x", "y"])

        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= DEALT:
                yield flush(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield flush(*(np.concatenate(c) for c in zip(*held, strict=True)))

    def count(table: pa.Table) -> pa.Table:
        bounds, _, _, parts = sent.value
        a, b = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column(c)]) for c in ("x", "y"))
        want = parts[table.column("part")[0].as_py()]
        ids, counts = np.unique(np.concatenate([a, b])), None
        counts = np.zeros(len(ids), np.int64)
        mixed = len(set(want.tolist())) == 2  # then the part has triangles inside one range too, which are another part's
        for x, y, z in closed(a, b):
            if mixed:
                at = np.sort(np.searchsorted(bounds, np.stack([x, y, z]), "right"), axis=0)
                keep = (at == want[:, None]).all(0)
                x, y, z = x[keep], y[keep], z[keep]
            counts += np.bincount(np.searchsorted(ids, np.concatenate([x, y, z])), minlength=len(ids))
        some = np.flatnonzero(counts)
        return pa.table({"id": ids[some], "triangles": counts[some]})

    packed = simple.select("a", "b").mapInArrow(deal, "part long, x binary, y binary")
    found = packed.groupBy("part").applyInArrow(count, "id long, triangles long")
    return found.groupBy("id").agg({"triangles": "sum"}).withColumnRenamed("sum(triangles)", "triangles")


__all__ = ["closed", "corner_counts"]
