"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, mix, pieces, prefix_hash, span_hash, word_hashes, words

#: Word edits allowed, as a share of an item's words; words of an item below which only exact copies count.
EDITS = 0.2
LEAST_WORDS = 8
RECALL = 0.95
SAMPLES = 3
#: Bytes of items to a block; each block of items takes one pass over the documents.
BLOCK_BYTES = 16 << 20
_TIE = np.uint64(0x9E3779B97F4A7C15)


def allowed(n: int) -> int:
    return int(EDITS * n) if n >= LEAST_WORDS else 0


def walk(tokens: np.ndarray, length: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """The CGK embedding of each row of tokens: copies of tokens at a walker that moves on by a random bit.

    The bit depends on the step and the token alone, so two walkers on similar
    texts fall into step again after an edit. Past its length a row gives 0.
    """
    m = len(tokens)
    out = np.zeros((m, steps), np.uint64)
    at, rows = np.zeros(m, np.int64), np.arange(m)
    for j in range(steps):
        live = at < length
        token = np.where(live, tokens[rows, np.minimum(at, tokens.shape[1] - 1)], np.uint64(0))
        out[:, j] = token
        salt = np.uint64((seed * 4099 + j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        at += (mix(token ^ salt) & np.uint64(1)).astype(np.int64) * live
    return out


def sample_keys(tokens: np.ndarray, length: np.ndarray, size: np.ndarray, seed: int, samples: int = SAMPLES) -> np.ndarray:
    """One hash of `samples` coordinates of each row's embedding, sampled in proportion to its item's size."""
    walked = walk(tokens, length, 3 * int(size.max()), seed)
    rows, key = np.arange(len(tokens)), mix(size.astype(np.uint64) + np.uint64(seed << 20))
    for u in np.random.default_rng(seed + 7919).random(samples):
        key = mix(key * _TIE + walked[rows, (u * 3 * size).astype(np.int64)])
    return key


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), max(1, size.max(initial=0))), np.uint64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, size


class Items(NamedTuple):
    """A block of benchmark items and their hash tables."""

    ids: np.ndarray
    tokens: list[np.ndarray]
    size: np.ndarray
    #: gram width -> sorted hashes of the items' pieces, their items, their places
    parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: for each repetition the items' sorted keys, and the items in that order
    tables: list[tuple[np.ndarray, np.ndarray]]


def repetitions(tokens: list[np.ndarray], recall: float) -> int:
    """Repetitions that reach the recall: items are edited as much as allowed, and their collisions counted.

    The rate of a single repetition counts as 0.01 at least, so a few hundred reach any usual recall.
    """
    if not 0 <= recall < 1:
        raise ValueError("recall must be below 1")
    rng = np.random.default_rng(11)
    pick = [tokens[i] for i in rng.integers(0, len(tokens), 400)]
    other = []
    for y in pick:
        for _ in range(allowed(len(y))):
            kind, at = int(rng.integers(3)), int(rng.integers(len(y)))
            new = rng.integers(1 << 62, size=1).astype(np.uint64)
            y = np.concatenate([y[:at], new, y[at + (kind == 0) :]]) if kind < 2 else np.delete(y, at)
        other.append(y)
    a, size = padded(pick)
    b, _ = padded([y[: len(x)] for x, y in zip(pick, other, strict=True)])
    length = np.array([min(len(x), len(y)) for x, y in zip(pick, other, strict=True)])
    rate = np.clip(np.mean([sample_keys(a, size, size, r) == sample_keys(b, length, size, r) for r in range(24)], axis=0), 0.01, 0.999)
    return next(r for r in itertools.count(1) if (1 - (1 - rate) ** r).mean() >= recall)


def prepare(rows: list[tuple[int, str]], recall: float) -> Items:
    ids, tokens = [], []
    for i, text in rows:
        raw = lower_ascii(np.frombuffer((text or "").encode(), np.uint8))
        starts, ends, _ = words(raw, np.array([0, len(raw)]))
        if len(starts):
            ids.append(i)
            tokens.append(word_hashes(raw, starts, ends))
    parts: dict[int, list] = {}
    for k, t in enumerate(tokens):
        share = len(t) // (allowed(len(t)) + 1)
        width, prefix = min(share, 8), prefix_hash(t)
        for at in range(0, share * (allowed(len(t)) + 1), share):
            parts.setdefault(width, []).append((span_hash(prefix, np.array([at]), np.array([at + width]))[0], k, at))
    done = {}
    for width, found in parts.items():
        h = np.array([x[0] for x in found], np.uint64)
        order = np.argsort(h, kind="stable")
        done[width] = (h[order], np.array([x[1] for x in found])[order], np.array([x[2] for x in found])[order])
    grid, size = padded(tokens)
    tables = []
    for r in range(repetitions(tokens, recall) if tokens else 0):
        key = sample_keys(grid, size, size, r)
        order = np.argsort(key, kind="stable")
        tables.append((key[order], order))
    return Items(np.array(ids, np.int64), tokens, size, done, tables)


def edit_match(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """The stretch of text nearest to the item in word edits: (edits, start, end), first on ties; None above `most`.

    One vector step for each word of the text; costs carry the start of their stretch.
    """
    n, step = len(item), len(text) + 1
    ramp = np.arange(n + 1) * step
    state, best = ramp.copy(), (n + 1, 0, 0)
    for j in range(len(text)):
        now = np.empty_like(state)
        now[0] = j + 1
        np.minimum(state[:-1] + (item != text[j]) * step, state[1:] + step, out=now[1:])
        state = np.minimum.accumulate(now - ramp) + ramp
        cost = int(state[n])
        if cost // step < best[0]:
            best = (cost // step, cost % step, j + 1)
    return best if best[0] <= most else None


def likely_windows(tokens: np.ndarray, first: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(first word, item size) of the windows around stretches that share a piece with an item of that size."""
    prefix = prefix_hash(tokens)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for width, (h, item, place) in items.parts.items():
        if len(tokens) < width:
            continue
        at = np.arange(len(tokens) - width + 1)
        grams = span_hash(prefix, at, at + width)
        maybe = np.zeros(1 << 16, bool)
        maybe[(h & np.uint64(0xFFFF)).astype(np.int64)] = True
        near = np.flatnonzero(maybe[(grams & np.uint64(0xFFFF)).astype(np.int64)])
        near = near[row[near] == row[near + width - 1]]
        lo, hi = np.searchsorted(h, grams[near], "left"), np.searchsorted(h, grams[near], "right")
        count = hi - lo
        at = np.repeat(near, count)
        which = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        n, base = items.size[item[which]], at - place[which]
        for k in np.unique([allowed(int(x)) for x in np.unique(n)]).tolist() if len(n) else []:
            mine = np.array([allowed(int(x)) for x in n]) == k
            shift = np.arange(-k, k + 1)
            s, m, r = (base[mine][:, None] + shift).ravel(), np.repeat(n[mine], len(shift)), np.repeat(row[at[mine]], len(shift))
            starts.append(np.clip(s, first[r], np.maximum(first[r], first[r + 1] - m)))
            sizes.append(m)
    s, n = np.concatenate(starts), np.concatenate(sizes)
    wide = int(items.size.max(initial=0)) + 1
    both = np.unique(s * wide + n) if len(s) else s
    return both // wide, both % wide


def find_in(slices: list[tuple[np.ndarray, np.ndarray]], items: Items) -> list[list[tuple[int, int, int, int, int]]]:
    """For each slice of documents (row, item, first word, end word, edits) of the items found."""
    held = []
    for buf, off in slices:
        low = lower_ascii(buf)
        starts, ends, first = words(low, off)
        tokens = word_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        held.append((tokens, first, *likely_windows(tokens, first, items)))
    out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in held]
    size = np.concatenate([h[3] for h in held])
    if not len(size):
        return out
    piece = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
    start = np.concatenate([h[2] for h in held])
    row = np.concatenate([np.searchsorted(h[1], h[2], side="right") - 1 for h in held])
    wide = int(size.max())
    grid, length = np.zeros((len(size), wide), np.uint64), np.zeros(len(size), np.int64)
    for k, (tokens, first, s, n) in enumerate(held):
        if len(s):
            mine = piece == k
            length[mine] = np.minimum(n, first[row[mine] + 1] - s)
            at = s[:, None] + np.arange(wide)
            grid[mine] = np.where(np.arange(wide) < length[mine][:, None], tokens[np.minimum(at, len(tokens) - 1)], np.uint64(0))
    met: set[tuple[int, int]] = set()
    for rep, (keys, order) in enumerate(items.tables):
        key = sample_keys(grid, length, size, rep)
        lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        for w in np.flatnonzero(hi > lo).tolist():
            met.update((w, int(order[i])) for i in range(lo[w], hi[w]))
    near: dict[tuple[int, int, int], list[int]] = {}
    for w, item in sorted(met):
        near.setdefault((int(piece[w]), int(row[w]), item), []).append(int(start[w]))
    for (k, r, item), places in near.items():
        tokens, first = held[k][:2]
        n, most = len(items.tokens[item]), allowed(len(items.tokens[item]))
        begin, end, best = int(first[r]), int(first[r + 1]), None
        exact = next((s for s in sorted(places) if s + n <= end and (tokens[s : s + n] == items.tokens[item]).all()), None)
        if exact is not None:
            out[k].append((r, item, exact - begin, exact - begin + n, 0))
            continue
        places = sorted(places)
        runs = [[places[0], places[0]]]
        for s in places[1:]:
            if s <= runs[-1][1] + n:
                runs[-1][1] = s
            else:
                runs.append([s, s])
        for a, b in runs:
            lo, hi = max(begin, a - most), min(end, b + n + most)
            got = edit_match(items.tokens[item], tokens[lo:hi], most)
            if got:
                best = min(best or (most + 1, 0, 0), (got[0], lo + got[1] - begin, lo + got[2] - begin))
        if best:
            out[k].append((r, item, best[1], best[2], best[0]))
    return out


def found_in(batch: pa.RecordBatch, items: Items) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int, int, int]]]]:
    """Slices of a batch with what they hold; some slices at a time share the walks."""
    for group in itertools.batched(pieces(batch, "text"), 8):
        yield from zip((part for part, _, _ in group), find_in([x[1:] for x in group], items), strict=True)


def blocks_of_items(benchmark: DataFrame, recall: float) -> Iterator[Items]:
    """The items in blocks of bounded size, at least one; null ids take no part."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    for k in range(blocks):
        mine = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).select(F.col("item_id").cast("long").alias("item_id"), "text")
        yield prepare([(r.item_id, r.text) for r in mine.orderBy("item_id", "text").collect() if r.item_id is not None], recall)


def leaks(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, start_word, end_word, edits: benchmark items found in documents, the nearest place of each.

    A document holds an item of n words if a stretch of its words is within
    ``EDITS * n`` word edits of it (in lower case; exact below LEAST_WORDS words).
    Stretches that share one of the pieces the edits cannot all touch give
    windows of the item's size. A window and an item meet where a repetition of
    the CGK walk agrees on sampled coordinates; repetitions are added until items
    edited as much as allowed are found at the rate `recall`. Every meeting is
    verified by exact edit distance.

    Items are taken in blocks of bounded size, one pass over the documents each.
    Null and empty items match nothing; null and empty texts hold nothing. Repeated
    rows of documents give their leaks each, repeated items too. Other columns are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, item_id long, start_word long, end_word long, edits long"
    out = None
    for items in blocks_of_items(benchmark, recall):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, got in found_in(batch, items):
                    row = np.array([g[0] for g in got], np.int64)
                    cols = [part.column(0).take(pa.array(row)), pa.array(items.ids[[g[1] for g in got]] if got else [], pa.int64()), *(pa.array([g[i] for g in got], pa.int64()) for i in (2, 3, 4))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "start_word", "end_word", "edits"])

        got = rows.mapInArrow(run, kind)
        out = got if out is None else out.unionByName(got)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL) -> DataFrame:
    """The documents that hold no benchmark item; all columns stay.

    Every row is judged by its own text as it passes, so rows with null or repeated
    ids are kept or dropped by themselves, and no document is shuffled. Null and
    empty texts stay; so does everything where the benchmark is empty.
    """
    for items in blocks_of_items(benchmark, recall):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, got in found_in(batch, items):
                    keep = np.ones(part.num_rows, bool)
                    keep[[g[0] for g in got]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


__all__ = ["leaks", "op3_decontamination", "without_leaks"]
