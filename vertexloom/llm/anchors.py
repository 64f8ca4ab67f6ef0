"""Routing of repeated windows: finds which windows of symbols also start earlier in the corpus.

Symbols are words or bytes. A window's anchor is its smallest-hashed gram of
`gram` symbols, the leftmost on ties, so equal windows have equal anchors at
equal places. Consecutive windows with one anchor form a segment.

0. Of documents with equal texts only the first goes on: all windows of the others
   start earlier in it.
1. Every document sends its anchors' hashes to buckets; a bucket keeps those that
   occur twice. A window whose anchor occurs once is unique. Of an anchor frequent
   enough in a batch to be hot in the corpus, the batch sends one mark.
2. Documents with repeated anchors cut out the segments around them. Within a
   batch, a segment's later copies are known to repeat; only its first goes on.
3. Segments meet by anchor in shards of bounded size, where a matcher (suffix
   automaton or suffix array) finds the windows that occur earlier. An anchor
   with more than `hot` occurrences is split: its windows meet by their own
   hashes, packed and without their symbols, so a group with a third of all rows
   is spread over as many keys as it has different windows. A matcher would find
   nothing more among single windows, which are equal or share none.
4. The covered spans return to their documents.

Every stage is exact up to 64-bit hashes of grams and 128-bit hashes of segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, binary_array, gram_hash, ids_of, list_array, mix, pieces, prefix_hash, row_of, sliding_argmin, span_hash

#: The ids below NO_ID + UNNAMED stand for texts without one.
NO_ID, UNNAMED = -(1 << 63), 1 << 48
#: The end of a span that covers a whole copy.
WHOLE = 1 << 40
HOT = 8192
#: An anchor with as many occurrences in a batch, if they are also the batch's share of HOT, is hot.
OFTEN = 8
#: Places that stand for a hot anchor's mark, and for a text that knows of it; the count of a hot anchor.
MARK, KNOWN, ALWAYS = -1, -2, 1 << 30
#: Segments to a shard.
SHARD = 8000
#: Single windows held until they are packed, all of a batch or little more than so many.
SINGLES = 1 << 20

#: (bytes, row offsets) -> (symbols, first symbol of each row, byte start and byte end of each symbol or None for bytes)
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]
#: (payloads in order of their first occurrence, window) -> for each the windows that occur earlier, as (segment, first window, last window)
Matcher = Callable[[list[bytes], int], tuple[np.ndarray, np.ndarray, np.ndarray]]


class Segments(NamedTuple):
    row: np.ndarray
    begin: np.ndarray  # first window, by its first symbol
    last: np.ndarray  # last window
    anchor: np.ndarray  # hash


def segments(prefix: np.ndarray, first: np.ndarray, window: int, gram: int) -> Segments:
    """All segments of the rows' symbols, in order."""
    n = len(prefix) - 1
    none = np.zeros(0, np.int64)
    if n < window:
        return Segments(none, none, none, np.zeros(0, np.uint64))
    grams = gram_hash(prefix, gram)
    grams = np.append(grams, (mix(prefix[-1:]) if len(grams) < n - gram + 1 else np.zeros(0, np.uint64)))
    pick = sliding_argmin(grams[: n - gram + 1], window - gram + 1)
    over = np.zeros(n + 1, np.int64)
    np.add.at(over, np.maximum(first[1:] - window + 1, first[:-1]), 1)
    np.add.at(over, first[1:], -1)
    valid = np.flatnonzero(np.cumsum(over)[: len(pick)] == 0)
    if not len(valid):
        return Segments(none, none, none, np.zeros(0, np.uint64))
    chosen = pick[valid]
    new = np.append(True, (valid[1:] != valid[:-1] + 1) | (chosen[1:] != chosen[:-1]))
    at = np.flatnonzero(new)
    begin, last = valid[at], valid[np.append(at[1:], len(valid)) - 1]
    row = np.searchsorted(first, begin, side="right") - 1
    return Segments(row, begin, last, grams[chosen[at]])


def _spans(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many spans end to end, and the offset of each."""
    size = hi - lo
    first = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(lo - first[:-1], size) + np.arange(first[-1])], first


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the intervals of each doc, sorted."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    part = np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1
    wide = int(hi.max()) + 1
    reach = np.maximum.accumulate(part * wide + hi)
    new = np.append(True, part[1:] * wide + lo[1:] > reach[:-1])
    new[1:] |= part[1:] != part[:-1]
    at = np.flatnonzero(new)
    return doc[at], lo[at], reach[np.append(at[1:], len(doc)) - 1] - part[at] * wide


def _firsts(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first occurrence of their key, and which are later occurrences."""
    order = np.lexsort((begin, doc, k2, k1))
    a, b = k1[order], k2[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(order) else np.zeros(0, bool)
    # rows at the very place of the first are the same occurrence, not a later one
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    same = (doc[order] == doc[lead]) & (begin[order] == begin[lead])
    return order[new], order[~new & ~same]


def repeated_windows(docs: DataFrame, symbols: Symbols, matcher: Matcher, window: int, gram: int, stage: Stage, hot: int = HOT) -> DataFrame:
    """_id, spans: for every document with any, the symbol intervals covered by windows that also start earlier.

    docs has _id (no nulls) and text. "Earlier" is a smaller _id, or the same and
    an earlier start.
    """
    text = stage.write(docs.select("_id", F.xxhash64("text").alias("t"), F.crc32(F.col("text").cast("binary")).alias("c"), F.octet_length("text").alias("n")), "texts")
    firsts = stage.write(text.groupBy("t", "c", "n").agg(F.min("_id").alias("_id")), "firsts")
    copies = text.alias("x").join(firsts.alias("y"), ["t", "c", "n"]).where("x._id <> y._id").select("x._id")
    n_docs = max(1, firsts.count())
    buckets = max(32, n_docs // 1000)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, starts = [], [], []
            for part, buf, off in pieces(batch, "text"):
                syms, first, _, _ = symbols(buf, off)
                seg = segments(prefix_hash(syms), first, window, gram)
                keys.append(seg.anchor)
                ids.append(ids_of(part, "t")[seg.row])
                starts.append(seg.begin - first[seg.row])
            if keys:
                h, doc = np.concatenate(keys), np.concatenate(ids)
                order = np.lexsort((np.concatenate(starts), doc, h))
                h, doc, start = h[order], doc[order], np.concatenate(starts)[order]
                # copies of a text say nothing new
                new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])) if len(h) else np.zeros(0, bool)
                h, doc, start = h[new], doc[new], start[new].astype(np.int32)
                lead = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                size = np.diff(np.append(lead, len(h)))
                often = size >= max(OFTEN, -(-hot * batch.num_rows // n_docs))
                # an anchor this frequent here is hot everywhere: its texts know already, and one mark tells the bucket
                told = np.repeat(often, size)
                known = np.flatnonzero(told & np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else lead
                mark = lead[often]
                at = np.concatenate([np.flatnonzero(~told), mark, known])
                flag = np.repeat([0, MARK, KNOWN], [len(h) - told.sum(), len(mark), len(known)])
                start = np.where(flag == 0, start[at], flag).astype(np.int32)
                h, doc = h[at], doc[at]
                bucket = (np.where(flag == KNOWN, doc.view(np.uint64), mix(h)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                used, at = np.unique(bucket[order], return_index=True)
                first = np.append(at, len(order))
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(binary_array(np.ascontiguousarray(x[order]).view(np.uint8), first * x.itemsize) for x in (h, doc, start))], names=["bucket", "h", "doc", "start"])

    def keep(table):
        h = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("h")])
        doc = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("doc")])
        start = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table.column("start")])
        mine = start == KNOWN
        marks, done = np.unique(h[start == MARK]), (doc[mine], h[mine])
        h, doc, start = (x[start >= 0] for x in (h, doc, start))
        order = np.lexsort((start, doc, h))
        h, doc, start = h[order], doc[order], start[order]
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])) if len(h) else np.zeros(0, bool)
        h, doc = h[new], doc[new]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.append(at, len(h)))
        n = np.repeat(np.where(np.isin(h[at], marks), ALWAYS, np.minimum(size, ALWAYS)), size)
        once = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) & (n > 1) if len(h) else np.zeros(0, bool)
        n = np.concatenate([n[once], np.full(len(done[0]), ALWAYS)]).astype(np.int32)
        return pa.table({"t": np.concatenate([doc[once], done[0]]), "h": np.concatenate([h[once], done[1]]).view(np.int64), "n": n})

    held = docs.select("text", F.xxhash64("text").alias("t")).mapInArrow(send, "bucket int, h binary, doc binary, start binary").groupBy("bucket").applyInArrow(keep, "t long, h long, n int")
    lists = stage.write(held.join(firsts.select("t", "_id"), "t").groupBy("_id").agg(F.collect_list(F.struct("h", "n")).alias("anchors")), "anchors")

    names = ["route", "k1", "k2", "doc", "lo", "hi", "payload"]

    def pack(singles: list[tuple]) -> pa.RecordBatch:
        """Single windows by bucket, 32 bytes each, after the later copies among them as spans."""
        k1, k2, doc, start = (np.concatenate(x) for x in zip(*singles, strict=True))
        lead, later = _firsts(k1, k2, doc, start)
        gone = merged(doc[later], start[later], start[later] + window)
        bucket = (k1[lead] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        used, at = np.unique(bucket[order], return_index=True)
        packed = np.stack([x[lead[order]].view(np.int64) for x in (k1, k2, doc, start)], axis=1)
        m, g = len(used), len(gone[0])
        null = pa.nulls(m + g, pa.int64())
        spans = [pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(x)]) for x in gone]
        data = binary_array(packed.reshape(-1).view(np.uint8), np.append(at, len(order)) * 32)
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(used), pa.nulls(g, pa.int64())]), null, null, *spans, pa.concat_arrays([data, pa.nulls(g, pa.binary())])], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            singles, held = [], 0
            for part, buf, off in pieces(batch, "text"):
                lists = part.column(2)
                flat = lists.flatten()
                if not len(flat):
                    continue
                size = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()])
                tie = np.uint64(0x9E3779B97F4A7C15)
                known = mix(flat.field(0).to_numpy().view(np.uint64) + np.repeat(np.arange(len(size)), size).astype(np.uint64) * tie)
                order = np.argsort(known)
                known, counts = known[order], flat.field(1).to_numpy()[order]
                syms, first, lo, hi = symbols(buf, off)
                prefix = prefix_hash(syms)
                row, begin, last, anchor = segments(prefix, first, window, gram)
                key = mix(anchor + row.astype(np.uint64) * tie)
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = np.flatnonzero(known[at] == key)
                row, begin, last, anchor, n = row[hit], begin[hit], last[hit], anchor[hit], counts[at[hit]]
                other = prefix_hash(mix(syms + tie))
                doc = ids_of(part, "_id")[row]
                k1, k2 = span_hash(prefix, begin, last + window), span_hash(other, begin, last + window)
                lead, later = _firsts(k1, k2, doc, begin - first[row])
                gone = merged(doc[later], (begin - first[row])[later], (last - first[row])[later] + window)
                busy = n[lead] > hot
                cold, warm = lead[~busy], lead[busy]
                wide = (last - begin + 1)[warm]
                each = np.repeat(warm, wide)
                start = begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(wide) - wide, wide)
                if len(each):
                    singles.append((span_hash(prefix, start, start + window), span_hash(other, start, start + window), doc[each], start - first[row[each]]))
                    held += len(each)
                if held > SINGLES:
                    yield pack(singles)
                    singles, held = [], 0
                b, e = begin[cold], last[cold]
                data, at = _spans(buf, b if lo is None else lo[b], e + window if hi is None else hi[e + window - 1])
                null = pa.nulls(len(gone[0]), pa.int64())
                both = lambda x: pa.concat_arrays([pa.array(x.view(np.int64)), null])
                yield pa.RecordBatch.from_arrays([both(anchor[cold]), both(k1[cold]), both(k2[cold]), pa.array(np.concatenate([doc[cold], gone[0]])), pa.array(np.concatenate([b - first[row[cold]], gone[1]])), pa.array(np.concatenate([e - first[row[cold]] + window, gone[2]])), pa.concat_arrays([binary_array(data, at), pa.nulls(len(gone[0]), pa.binary())])], names=names)
            if singles:
                yield pack(singles)

    kind = "route long, k1 long, k2 long, doc long, lo long, hi long, payload binary"
    found = docs.join(lists.hint("shuffle_hash"), "_id", "left").select("_id", "text", "anchors").mapInArrow(cut, kind)
    found = stage.write(found, "segments")
    shards = max(8, found.where("k1 is not null").count() // SHARD)

    def match(table):
        k1, k2, doc, lo, hi = (table.column(x).to_numpy() for x in ("k1", "k2", "doc", "lo", "hi"))
        lead, later = _firsts(k1, k2, doc, lo)
        lead = lead[np.lexsort((lo[lead], doc[lead]))]
        payload = table.column("payload").take(pa.array(lead)).to_pylist()
        which, a, b = matcher(payload, window)
        which = lead[which]
        gone = merged(np.concatenate([doc[later], doc[which]]), np.concatenate([lo[later], lo[which] + a]), np.concatenate([hi[later], lo[which] + b + window]))
        return pa.table({"doc": gone[0].astype(np.int64), "lo": gone[1].astype(np.int64), "hi": gone[2].astype(np.int64)})

    def meet(table):
        packed = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("payload")]).reshape(-1, 4)
        k1, k2, doc, start = np.ascontiguousarray(packed.T)
        _, later = _firsts(k1, k2, doc, start)
        gone = merged(doc[later], start[later], start[later] + window)
        return pa.table(dict(zip(("doc", "lo", "hi"), gone, strict=True)))

    shard = F.pmod(F.xxhash64("route"), F.lit(shards)).cast("int").alias("shard")
    met = found.where("k1 is not null").select(shard, "k1", "k2", "doc", "lo", "hi", "payload").groupBy("shard").applyInArrow(match, "doc long, lo long, hi long")
    single = found.where("route is not null and k1 is null").select("route", "payload").groupBy("route").applyInArrow(meet, "doc long, lo long, hi long")
    gone = met.unionByName(single).unionByName(found.where("route is null").select("doc", "lo", "hi")).unionByName(copies.select(F.col("_id").alias("doc"), F.lit(0).cast("long").alias("lo"), F.lit(WHOLE).cast("long").alias("hi")))
    out = stage.write(gone.groupBy(F.col("doc").alias("_id")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    stage.drop("segments", "anchors", "texts", "firsts")
    return out


def id_of() -> F.Column:
    """The _id of a row: its doc_id; null doc_ids count as the smallest ids, each text by its hash."""
    unnamed = F.lit(NO_ID) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(UNNAMED))
    return F.coalesce(F.col("doc_id").cast("long"), unnamed).alias("_id")


def identified(docs: DataFrame) -> DataFrame:
    """_id and text."""
    return docs.select(id_of(), "text")


def named(column: str) -> F.Column:
    """The doc_id of an _id."""
    return F.when(F.col(column) >= NO_ID + UNNAMED, F.col(column))


def covered(batch: pa.RecordBatch, first: np.ndarray, window: int) -> np.ndarray:
    """For every symbol of the rows whether the row's spans (third column) cover it.

    A copy is covered whole if it has a window at all.
    """
    lists = batch.column(2)
    flat = lists.flatten()
    size = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
    base = np.repeat(first[:-1], size)
    edge = np.zeros(first[-1] + 1, np.int64)
    if len(flat):
        wide = np.repeat(np.diff(first), size)
        lo, hi = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        use = wide >= window
        np.add.at(edge, lo[use] + base[use], 1)
        np.add.at(edge, np.minimum(hi, wide)[use] + base[use], -1)
    return np.cumsum(edge)[:-1] > 0


__all__ = ["NO_ID", "covered", "id_of", "identified", "list_array", "merged", "named", "repeated_windows", "row_of", "segments"]
