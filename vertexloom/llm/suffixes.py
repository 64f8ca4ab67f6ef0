"""Suffix-array deduplication of byte strings: induced sorting and permuted common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import covered, identified, named, repeated_windows
from .common import Stage, pieces, prefix_hash, span_hash

WINDOW = 100
GRAM = 32
#: Common prefixes are measured at least this often, so lengths up to the window and so much more are enough.
STRIDE = 128
#: A reduced string with more names than this is ranked by doubling instead of recursion (see `suffix_array`).
RECURSE = 1024


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next (S); the last is S."""
    n = len(t)
    differs = np.append(t[:-1] != t[1:], True)
    at = np.where(differs, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    after = np.minimum(nearest + 1, n - 1)
    out = t[nearest] < t[after]
    out[nearest == n - 1] = True
    return out


def _induce(t: np.ndarray, k: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Sorts all suffixes from an order of the leftmost-S ones: L from the left, then S from the right.

    A bucket's suffixes are induced together; a run of equal symbols feeds its own
    bucket until nothing new comes.
    """
    n = len(t)
    size = np.bincount(t, minlength=k)
    ends = np.cumsum(size)
    begins = ends - size
    order = np.argsort(t[lms], kind="stable")
    seeds = lms[order]
    seed_end = np.cumsum(np.bincount(t[lms], minlength=k))
    sa = np.full(n, -1, np.int64)
    heads = begins.copy()

    def grouped(j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        c = t[j]
        o = np.argsort(c, kind="stable")
        j, c = j[o], c[o]
        new = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        count = np.diff(np.append(new, len(c)))
        return j, c[new], count, np.arange(len(c)) - np.repeat(new, count)

    def push_l(block: np.ndarray) -> None:
        j = block - 1
        j = j[j >= 0]
        j = j[~small[j]]
        if len(j):
            j, c, count, rank = grouped(j)
            sa[np.repeat(heads[c], count) + rank] = j
            heads[c] += count

    for c in np.flatnonzero(size):
        at = begins[c]
        while at < heads[c]:
            block = sa[at : heads[c]]
            at = heads[c]
            push_l(block)
        lo = seed_end[c - 1] if c else 0
        if seed_end[c] > lo:
            push_l(seeds[lo : seed_end[c]])
    tails = ends.copy()

    def push_s(block: np.ndarray) -> None:
        j = block - 1
        j = j[j >= 0]
        j = j[small[j]]
        if len(j):
            j, c, count, rank = grouped(j)
            sa[np.repeat(tails[c], count) - 1 - rank] = j
            tails[c] -= count

    sa[0] = n - 1  # the sentinel
    for c in np.flatnonzero(size)[::-1]:
        at = ends[c]
        if c == t[n - 1]:
            push_s(np.array([n - 1]))
            continue
        while at > tails[c]:
            block = sa[tails[c] : at][::-1]
            at = tails[c]
            push_s(block)
        if heads[c] > begins[c]:
            push_s(sa[begins[c] : heads[c]][::-1])
    return sa


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of ranks, by doubling."""
    n, rank, step = len(names), names.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key)  # equal keys get one rank, in any order
        key = key[order]
        new = np.append(0, np.cumsum(key[1:] != key[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of symbols below k; the last symbol is the smallest and occurs once.

    Suffixes are classified, the leftmost-S substrings sorted by induction and
    named, the string of names is sorted recursively and its order induces the
    whole array. The induction works a bucket at a time, which pays for small
    alphabets; a string of more than RECURSE names is ranked by doubling.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) <= 1:
        return _induce(t, k, small, lms)
    rough = _induce(t, k, small, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = rough[is_lms[rough]]
    place = np.zeros(n, np.int64)
    place[lms] = np.append(lms[1:], n - 1)
    prefix = prefix_hash(t.astype(np.uint64) + np.uint64(1))
    end = np.minimum(place[ranked] + 1, n)
    h, size = span_hash(prefix, ranked, end), end - ranked
    name = np.append(0, np.cumsum((h[1:] != h[:-1]) | (size[1:] != size[:-1])))
    if name[-1] == len(lms) - 1:
        return _induce(t, k, small, ranked)
    names = np.zeros(n, np.int64)
    names[ranked] = name
    reduced = names[lms]
    order = suffix_array(reduced, int(name[-1]) + 1) if name[-1] < RECURSE else _doubled(reduced)
    return _induce(t, k, small, lms[order])


def common_prefixes(t: np.ndarray, sa: np.ndarray, forced: np.ndarray, most: int, least: int = 0) -> np.ndarray:
    """Permuted: by position, the common prefix with the preceding suffix in the array, up to `most`.

    Only irreducible values, and those at `forced` positions, are measured; each
    following position has one less than the one before it. Values below `least`
    may come out smaller than they are.
    """
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    measured = np.ones(n, bool)
    i = np.arange(1, n)
    ok = (before[1:] > 0) & (before[:-1] >= 0)
    i, prior = i[ok[: n - 1]], before[1:][ok[: n - 1]]
    measured[i] = t[i - 1] != t[prior - 1]
    measured[forced] = True
    prefix = prefix_hash(t.astype(np.uint64) + np.uint64(1))
    all_at = np.flatnonzero(measured)
    near = all_at[(before[all_at] >= 0) & (np.maximum(all_at, before[all_at]) + least <= n)]
    at = near[span_hash(prefix, near, near + least) == span_hash(prefix, before[near], before[near] + least)] if least else near
    other = before[at]
    length = np.full(len(at), least, np.int64)
    step = 1 << (max(1, most - least).bit_length() - 1)
    while step:
        end = np.maximum(at, other) + length + step
        can = np.flatnonzero((other >= 0) & (end <= n))
        a, b, l = at[can], other[can], length[can]
        same = span_hash(prefix, a + l, a + l + step) == span_hash(prefix, b + l, b + l + step)
        length[can[same]] += step
        step >>= 1
    source = np.maximum.accumulate(np.where(measured, np.arange(n), 0))
    back = np.zeros(n, np.int64)
    back[at] = length
    return np.maximum(back[source] - (np.arange(n) - source), 0)


def array_matches(payloads: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each byte sequence that occur in an earlier one, as runs (sequence, first window, last window)."""
    none = np.zeros(0, np.int64)
    if not payloads:
        return none, none, none
    size = np.array([len(p) for p in payloads])
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    t = np.frombuffer(b"\x00".join(payloads) + b"\x00\x00", np.uint8).astype(np.int16) + np.int16(2)
    t[first + size] = 1  # between sequences
    t[-1] = 0
    sa = suffix_array(t, 258)
    prefix = common_prefixes(t, sa, np.union1d(first, np.arange(0, len(t), STRIDE)), window + STRIDE, window)
    owner = np.repeat(np.arange(len(size)), size + 1)
    rest = np.append((first + size)[owner] - np.arange(len(owner)), 0)
    full = rest >= window
    group = np.cumsum(prefix[sa] < window)
    at = np.flatnonzero(full[sa])
    place, group = sa[at], group[at]
    new = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else none
    least = np.minimum.reduceat(place, new) if len(new) else none
    later = np.sort(place[place != np.repeat(least, np.diff(np.append(new, len(place))))])
    if not len(later):
        return none, none, none
    cut = np.flatnonzero(np.append(True, (later[1:] != later[:-1] + 1) | (owner[later[1:]] != owner[later[:-1]])))
    begin, last = later[cut], later[np.append(cut[1:], len(later)) - 1]
    which = owner[begin]
    return which, begin - first[which], last - first[which]


def byte_symbols(buf: np.ndarray, off: np.ndarray):
    return buf.astype(np.uint64) + np.uint64(1), off, None, None


def drop_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: every document without the bytes that repeated strings cover.

    A byte of the UTF-8 text goes if a string of `window` bytes of its document
    also starts earlier: in a smaller doc_id, or earlier in the same. n_spans
    counts the maximal removed runs; kept has the other bytes (they may cut a
    character). Null and empty texts have no bytes. A null doc_id counts as the
    smallest. Rows that repeat a doc_id and text share all places, so neither is
    earlier. Other columns are ignored; an empty table gives no rows.
    """
    stage = Stage(docs.sparkSession, "suffixes")
    rows = identified(docs)
    gone = repeated_windows(rows, byte_symbols, array_matches, window, gram, stage)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in pieces(batch, "text"):
                cover = covered(part, off, window)
                total = np.concatenate([[0], np.cumsum(cover)])
                starts = cover.copy()
                starts[1:] &= ~cover[:-1]
                inner = off[1:-1][off[1:-1] < len(cover)]
                starts[inner] = cover[inner]
                runs = np.concatenate([[0], np.cumsum(starts)])
                rest, at = buf[~cover].tobytes(), off - total[off]
                kept = [rest[at[i] : at[i + 1]] for i in range(part.num_rows)]
                sha = [hashlib.sha256(x).hexdigest() for x in kept]
                cols = [part.column(0), pa.array(np.diff(off)), pa.array(np.diff(total[off])), pa.array(np.diff(runs[off])), pa.array(sha), pa.array(kept if keep_bytes else [None] * len(kept), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = rows.join(gone.hint("shuffle_hash"), "_id", "left").select("_id", "text", "spans").mapInArrow(finish, kind)
    return out.withColumn("doc_id", named("doc_id"))


def op5_suffixes(spark, sf_dir: str) -> DataFrame:
    return drop_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_bytes=False).drop("kept")


#: Every byte window, numbered within its string; texts are cut in hexadecimal.
OP5_SQL = r"""
with b as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
win as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as g from (select doc_id, h, unnest(range(0, n - 99)) as i from b)),
rep as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from win) where k > 1),
runs as (
  select doc_id, min(i) as lo, max(i) + 100 as hi
  from (select doc_id, i, sum(new) over (partition by doc_id order by i rows unbounded preceding) as run
    from (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as new from rep))
  group by doc_id, run),
gaps as (
  select doc_id, n, h, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as last
  from (select b.doc_id, n, h, lo, hi from b left join runs on b.doc_id = runs.doc_id
    union all select doc_id, n, h, n, n from b where doc_id in (select doc_id from runs))),
kept as (
  select doc_id, any_value(n) as n, sum(case when lo < hi then hi - lo else 0 end) as n_removed, count(*) filter (lo < hi) as n_spans,
    string_agg(substr(h, 2 * last + 1, 2 * (coalesce(lo, n) - last)), '' order by last) as t
  from gaps group by 1)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, n_spans, sha256(unhex(t)) as kept_sha256 from kept
"""
