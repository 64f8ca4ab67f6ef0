"""N-gram Jaccard join: a size-aware heavy-light set join, and the components of its links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..algorithms.components import connected_components
from .anchors import identified, named
from .common import Stage, binary_array, gram_hash, ids_of, lower_ascii, mix, pieces, prefix_hash, span_hash, word_hashes, words

WORDS = 4
PERCENT = 85
#: Tokens to a bucket of inverted lists, and sets to a group that orders its shingles.
BUCKET = 400_000
GROUP = 2000
#: A shingle in more sets than this, and than one in SHARE of them, is common: it is ordered last without a list.
COMMON, SHARE = 8192, 2048
#: Bytes of a row of the inverted lists, and of both sets of a measured pair for each shingle.
ROW_BYTES, PAIR_BYTES = 40, 16
#: Keys to a yielded batch.
YIELD = 64_000


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and the first of each row."""
    low = lower_ascii(buf)
    starts, ends, first = words(low, off)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    prefix = prefix_hash(word_hashes(low, starts, ends))
    count = np.diff(first)
    grams = gram_hash(prefix, width)
    if len(grams) < len(starts) - width + 1:
        tail = np.array([len(starts) - width])
        grams = np.append(grams, span_hash(prefix, tail, tail + width))
    size = np.maximum(count - width + 1, 0)
    at = np.repeat(first[:-1] - np.cumsum(size) + size, size) + np.arange(size.sum())
    short = np.flatnonzero((count > 0) & (count < width))
    h = np.concatenate([grams[at], span_hash(prefix, first[short], first[short] + count[short])])
    row = np.concatenate([np.repeat(np.arange(len(size)), size), short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(off)))


def _signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's set; 0 for an empty set."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(salt)), dtype=np.uint64)])
        out.append(mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap a set of n has with any set it links to."""
    return -(-percent * n // 100)


def _packed(bucket: np.ndarray, cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    used, at = np.unique(bucket[order], return_index=True)
    first = np.append(at, len(order))
    packed = [binary_array(np.ascontiguousarray(x[order]).view(np.uint8), first * x.itemsize) for x in cols.values()]
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *packed], names=["bucket", *cols])


def _keys(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of (keys, kind, positions, rep, n, single) as one batch."""
    size = [len(r[0]) for r in rows]
    each = [np.repeat(np.array([r[i] for r in rows], t), size) for i, t in ((1, np.int8), (3, np.int64), (4, np.int64), (5, np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([r[0] for r in rows]), each[0], np.concatenate([r[2] for r in rows]).astype(np.int32), *each[1:])], names=names)


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])


def boundary_of(classes: list, boundary: int | None = None) -> int:
    """The largest n that enumerates subsets: where the bytes of both branches are least in all.

    classes: k (quarter powers of two of n), subsets, reach and shingles, summed over
    the sets of the class. A subset is a row. A scanned shingle is a row too, and a
    scan meets the centres of unrelated lists, so one measured pair a set is added.
    Both are sums over single sets, so the boundary does not move as the corpus grows.
    """
    if boundary is not None:
        return boundary
    light = [c.subsets * ROW_BYTES for c in classes]
    heavy = [c.reach * ROW_BYTES + c.shingles * PAIR_BYTES for c in classes]
    # the class below the boundary goes both ways
    options = [(sum(light[:i]) + sum(heavy[max(0, i - 1) :]), i) for i in range(len(classes) + 1)]
    best = min(options)[1]
    return int(2 ** ((classes[best - 1].k + 1) / 4)) if best else 1


def linked_sets(docs: DataFrame, percent: int = PERCENT, width: int = WORDS, boundary: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, parts): _id, n, rep of every document; a, b, overlap of links between different sets; rep, component of linked sets.

    Documents with equal sets are one set, named by its smallest _id. Links span
    every component: sets linked to a list's centre are merged first, and only
    pairs from different components are verified after that, so a component's
    pairs need not all be listed while none between components is lost. Links
    between different sets of one component are left out as well, so the links
    do not give the number of partners of a document.

    1. A set's prefix is its ``n - least overlap + slack`` smallest hashes; of a
       linked pair each shares `slack` with the other. Sets with fewer repeated
       prefix shingles have no partner and go no further. A shingle that two sets
       of a batch have is known to repeat; two of its owners go on to meet those
       of other batches, so a bucket holds two entries a batch of any shingle.
    2. Shingles of the rest are counted and ordered by frequency, rare first and
       common ones last. Sets up to a boundary enumerate the 2-subsets of their
       prefix; larger ones, and those near the boundary, scan the lists of their
       single prefix shingles. The boundary is where the estimated costs of both
       are least (`boundary_of`), unless one is given.
    3. Each list links to its centre; the pairs are measured on whole sets. Then
       pairs of a list from different components are verified, if their overlaps
       with the list's centre and their singles leave the threshold within reach.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "ngrams")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in pieces(batch, "text"):
                h, first = shingle_sets(buf, off, width)
                s1, s2 = _signatures(h, first)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), pa.array(s1), pa.array(s2)], names=["_id", "n", "s1", "s2"])

    sets = stage.write(docs.mapInArrow(describe, "_id long, n long, s1 long, s2 long"), "sets")
    # written, so that the join deals out anew the copies of a set
    reps = stage.write(sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("_id").alias("rep")), "reps")
    members = sets.join(reps, ["n", "s1", "s2"], "left").select("_id", "n", F.coalesce("rep", "_id").alias("rep"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, math.ceil(total * 0.2 / BUCKET))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, owners = [], []
            for _, buf, off in pieces(batch, "text"):
                h, first = shingle_sets(buf, off, width)
                s1, _ = _signatures(h, first)
                n = np.diff(first)
                reach = np.minimum(n, n - _overlap(n, percent) + np.maximum(1, n // 20))
                at = np.repeat(first[:-1] - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())
                tokens.append(h[at])
                owners.append(np.repeat(s1, reach))
            if not tokens:
                continue
            h, own = np.concatenate(tokens), np.concatenate(owners)
            order = np.lexsort((own, h))
            h, own = h[order], own[order]
            new = np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])) if len(h) else np.zeros(0, bool)
            h, own = h[new], own[new]
            lead = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            size = np.diff(np.append(lead, len(h)))
            # owners of a shingle that repeats here are counted at once; the first two speak for it elsewhere
            used, count = np.unique(own[np.repeat(size > 1, size)], return_counts=True)
            yield _packed((used % buckets).astype(np.int64), {"h": used, "own": count.astype(np.int64), "told": np.full(len(used), 2, np.uint8)})
            at = np.sort(np.concatenate([lead, lead[size > 1] + 1]))
            told = np.repeat(size > 1, np.minimum(size, 2)).astype(np.uint8)
            yield _packed((mix(h[at]) % np.uint64(buckets)).astype(np.int64), {"h": h[at], "own": own[at], "told": told})

    def repeated(table):
        h, own, told = _column(table, "h", np.uint64), _column(table, "own", np.int64), _column(table, "told", np.uint8)
        done, counts = h[told == 2].view(np.int64), own[told == 2]
        h, own, told = h[told < 2], own[told < 2], told[told < 2]
        order = np.lexsort((told, own, h))
        h, own, told = h[order], own[order], told[order] > 0
        new = np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])) if len(h) else np.zeros(0, bool)
        h, own, told = h[new], own[new], told[new]
        lead = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.append(lead, len(h)))
        used, count = np.unique(own[np.repeat(size > 1, size) & ~told], return_counts=True)
        return pa.table({"s1": np.concatenate([used, done]), "c": np.concatenate([count, counts]).astype(np.int64)})

    # copies of a set in several batches may count a shingle more than once, which only lets more sets go on
    shared = docs.mapInArrow(send, "bucket int, h binary, own binary, told binary").groupBy("bucket").applyInArrow(repeated, "s1 long, c long")
    shared = shared.groupBy("s1").agg(F.sum("c").alias("c"))
    alive = reps.join(shared, "s1").where(F.col("c") >= F.greatest(F.lit(1), F.expr("n div 20"))).select(F.col("rep").alias("_id"))
    alive = stage.write(alive, "alive")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in pieces(batch, "text"):
                h, first = shingle_sets(buf, off, width)
                rep = ids_of(part, "_id")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), binary_array(h.view(np.uint8), first * 8), pa.array(mix(rep.astype(np.int64).view(np.uint64)).view(np.int64))], names=["rep", "n", "h", "m"])

    full = docs.join(alive.hint("shuffle_hash"), "_id", "left_semi").select("_id", "text").mapInArrow(whole, "rep long, n long, h binary, m long")
    full = stage.write(full.dropDuplicates(["rep"]), "full")
    n_full, held = full.agg(F.count("*"), F.sum("n")).first()
    parts, groups = max(16, math.ceil((held or 0) / BUCKET)), max(8, n_full // GROUP)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, _ in pieces(batch, "h", 1 << 24):
                h, count = np.unique(buf.view(np.uint64), return_counts=True)
                often = count >= max(2, part.num_rows // SHARE)
                yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(count[often])], names=["key", "c"])

    # at most SHARE times the mean size of a set, eight bytes each
    above = max(COMMON, n_full // SHARE)
    seen = full.select("h").mapInArrow(frequent, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") > above)
    common = np.sort(np.array([r.key for r in seen.select("key").collect()], np.int64).view(np.uint64))

    def is_common(h: np.ndarray) -> np.ndarray:
        return common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h if len(common) else np.zeros(len(h), bool)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in pieces(batch, "h", 1 << 23):
                h, rep = buf.view(np.uint64), np.repeat(ids_of(part, "rep"), np.diff(off) // 8)
                last = is_common(h)
                yield _packed((mix(h[~last]) % np.uint64(parts)).astype(np.int64), {"h": h[~last], "rep": rep[~last]})

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in pieces(batch, "h", 1 << 23):
                h, rep = buf.view(np.uint64), np.repeat(ids_of(part, "rep"), np.diff(off) // 8)
                last = is_common(h)
                packed = _packed(mix(rep[last].view(np.uint64)).view(np.int64) % groups, {"h": h[last], "rep": rep[last], "df": np.full(last.sum(), 1 << 40, np.int64)})
                yield packed.rename_columns(["part", "h", "rep", "df"])

    def frequencies(table):
        h, rep = _column(table, "h", np.uint64), _column(table, "rep", np.int64)
        order = np.argsort(h, kind="stable")
        h, rep = h[order], rep[order]
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        df = np.repeat(np.diff(np.append(new, len(h))), np.diff(np.append(new, len(h))))
        h, rep, df = h[df > 1], rep[df > 1], df[df > 1]
        group = mix(rep.view(np.uint64)).view(np.int64) % groups
        order = np.argsort(group, kind="stable")
        used, at = np.unique(group[order], return_index=True)
        first = np.append(at, len(order)) * 8
        cols = [binary_array(np.ascontiguousarray(x[order].astype(t)).view(np.uint8), first) for x, t in ((h, np.uint64), (rep, np.int64), (df, np.int64))]
        return pa.table([pa.array(used.astype(np.int32)), *cols], names=["part", "h", "rep", "df"])

    def order(left, right):
        """For each set of a group: the singles it has, and its repeated shingles by frequency up to the 2-prefix."""
        out = {c: [] for c in ("rep", "n", "single", "h", "reach", "subsets")}
        if len(left) and len(right):
            h, rep, df = _column(left, "h", np.uint64), _column(left, "rep", np.int64), _column(left, "df", np.int64)
            at = np.lexsort((h, df, rep))
            h, rep, df = h[at], rep[at], df[at]
            used, begin = np.unique(rep, return_index=True)
            sizes = dict(zip(right.column("rep").to_pylist(), right.column("n").to_pylist(), strict=True))
            for r, lo, hi in zip(used.tolist(), begin, [*begin[1:], len(rep)], strict=True):
                n = sizes[r]
                single = n - int(hi - lo)
                keep = n - int(_overlap(np.array([n]), percent)[0]) + 2 - single
                if keep > 1:
                    m = min(keep, int(hi - lo))
                    row = (r, n, single, h[lo : lo + m].tobytes(), keep - 1, m * (m - 1) // 2)
                    for c, x in zip(out, row, strict=True):
                        out[c].append(x)
        return pa.table({c: pa.array(x, pa.binary() if c == "h" else pa.int64()) for c, x in out.items()})

    lists = full.mapInArrow(tokens, "bucket int, h binary, rep binary").groupBy("bucket").applyInArrow(frequencies, "part int, h binary, rep binary, df binary")
    if len(common):
        lists = lists.unionByName(full.mapInArrow(ends, "part int, h binary, rep binary, df binary"))
    part = F.pmod("m", F.lit(groups)).cast("int").alias("part")
    ranked = lists.groupBy("part").cogroup(full.select(part, "rep", "n").groupBy("part")).applyInArrow(order, "rep long, n long, single long, h binary, reach long, subsets long")
    ranked = stage.write(ranked, "ranked")
    k = F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int").alias("k")
    boundary = boundary_of(ranked.groupBy(k).agg(F.sum("subsets").alias("subsets"), F.sum(F.least("reach", F.length("h") / 8)).alias("reach"), F.sum("n").alias("shingles")).orderBy("k").collect(), boundary)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "kind", "pos", "rep", "n", "single"]
        for batch in batches:
            out, held = [], 0
            for rep, n, single, raw, reach in zip(ids_of(batch, "rep").tolist(), ids_of(batch, "n").tolist(), ids_of(batch, "single").tolist(), batch.column(3), ids_of(batch, "reach").tolist(), strict=True):
                h = np.frombuffer(raw.as_buffer(), np.uint64)
                if n <= boundary:
                    for b in range(1, len(h)):
                        low, high = np.minimum(h[:b], h[b]), np.maximum(h[:b], h[b])
                        out.append((mix(low + mix(high)).view(np.int64), 0, np.full(b, single + b), rep, n, single))
                        held += b
                        if held >= YIELD:
                            yield _keys(out, names)
                            out, held = [], 0
                if 100 * n >= percent * boundary:
                    one = h[:reach]
                    out.append((one.view(np.int64), 1, single + np.arange(len(one)), rep, n, single))
                    held += len(one)
                if held >= YIELD:
                    yield _keys(out, names)
                    out, held = [], 0
            if out:
                yield _keys(out, names)

    inverted = stage.write(ranked.mapInArrow(keys, "key long, kind byte, pos int, rep long, n long, single long"), "inverted")
    rank = F.struct(F.expr("single * 1000 div n").alias("rank"), F.col("rep").alias("a"), F.col("n").alias("an"), F.col("single").alias("asingle"))
    # centres and open keys are written, so that the joins on them can split a key with many rows
    centres = inverted.groupBy("key", "kind").agg(F.min(rank).alias("c"), F.count("*").alias("m")).where("m > 1").select("key", "kind", "c.a", "c.an", "c.asingle")
    centres = stage.write(centres, "centres")
    can = F.expr(f"{100 + percent} * least(n - single, an - asingle) >= {percent} * (n + an)")
    pairs = inverted.join(centres, ["key", "kind"]).where((F.col("rep") != F.col("a")) & can).select(F.least("rep", "a").alias("a"), F.greatest("rep", "a").alias("b")).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort()
                size.append((int((both[1:] == both[:-1]).sum()), len(both)))
            cols = [pa.array([x[i] for x in size], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["a", "b", "overlap", "both"])

    def verified(pairs: DataFrame) -> DataFrame:
        one = pairs.join(full.select(F.col("rep").alias("a"), F.col("h").alias("ha")), "a")
        two = one.join(full.select(F.col("rep").alias("b"), F.col("h").alias("hb")), "b")
        return two.select("a", "b", "ha", "hb").mapInArrow(verify, "a long, b long, overlap long, both long")

    linked = F.expr(f"{100 + percent} * overlap >= {percent} * both")
    measured = stage.write(verified(pairs), "measured")
    links = measured.where(linked).select("a", "b", "overlap")
    merged = stage.write(connected_components(links, "a", "b"), "merged")
    at = inverted.join(merged.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # a row stays where even the smallest set of another component in its list could link to it
    lists_of = at.groupBy("key", "kind").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("least_n")).where("x < y")
    open_keys = stage.write(lists_of.join(centres.select("key", "kind", F.col("a").alias("centre")), ["key", "kind"]), "open")
    hope = F.expr(f"{percent} * (n + least_n) <= {100 + percent} * least(n - single, n - pos + 1 - l.kind)")
    rest = at.alias("l").join(open_keys.alias("r"), F.expr("l.key = r.key and l.kind = r.kind") & hope).select("l.*", "centre")
    again = rest.groupBy("key", "kind").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key", "kind")
    rest = rest.join(again, ["key", "kind"], "left_semi")
    to_centre = measured.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "overlap")
    rest = rest.join(to_centre, (F.least("rep", "centre") == F.col("_a")) & (F.greatest("rep", "centre") == F.col("_b")), "left")
    inside = F.when(F.col("rep") == F.col("centre"), F.col("n")).otherwise(F.col("overlap"))
    rest = stage.write(rest.select("key", "kind", "pos", "rep", "n", "single", "component", inside.alias("inside")), "rest")
    other = rest.select("key", "kind", F.col("pos").alias("apos"), F.col("rep").alias("a"), F.col("n").alias("an"), F.col("single").alias("asingle"), F.col("component").alias("acomponent"), F.col("inside").alias("ainside"))
    # what both share lies in the centre, where each has `inside`, or outside it, where singles cannot be shared
    near = F.expr(f"{100 + percent} * (least(inside, ainside) + greatest(0, least(n - inside - single, an - ainside - asingle))) >= {percent} * (n + an)")
    # a linked pair of these very sizes shares a key this early in both orders
    early = F.expr(f"{percent} * (n + an) <= {100 + percent} * least(n - pos + 1 - kind, an - apos + 1 - kind)")
    crossing = rest.join(other, ["key", "kind"]).where((F.col("a") < F.col("rep")) & (F.col("component") != F.col("acomponent")) & can & early & F.coalesce(near, F.lit(True)) & ((F.col("kind") == 0) | (F.col("n") > boundary) | (F.col("an") > boundary)))
    more = crossing.select("a", F.col("rep").alias("b")).distinct()
    more = stage.write(verified(more).where(linked).select("a", "b", "overlap"), "more")
    parts = merged.select(F.col("id").alias("rep"), "component")
    if not more.isEmpty():
        # the components found so far are the vertices that the further links connect
        name = lambda side: parts.select(F.col("rep").alias(side), F.col("component").alias(f"{side}_c"))
        across = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_c", "a").alias("x"), F.coalesce("b_c", "b").alias("y"))
        joined = connected_components(across, "x", "y").select(F.col("id").alias("component"), F.col("component").alias("_to"))
        alone = more.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(parts, "rep", "left_anti").select("rep", F.col("rep").alias("component"))
        parts = parts.unionByName(alone).join(joined, "component", "left").select("rep", F.coalesce("_to", "component").alias("component"))
    parts = stage.write(parts, "parts")  # so that the join of members can split the copies of a set
    stage.drop("alive", "full", "ranked", "inverted", "centres", "merged", "open", "rest")
    return members, links.unionByName(more), parts


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WORDS, boundary: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Words are lower-cased in A-Z. A document's set has its distinct shingles of
    `width` words; with fewer words the whole sequence is one. Two documents link
    at 100 * intersection >= percent * union; component_id is the smallest doc_id
    that links reach. Null, empty and blank texts have an empty set and are linked
    with nothing. A null doc_id counts as the smallest and stays null; texts with
    null ids are documents of their own. Repeated rows are copies of one another.
    Other columns are ignored. `boundary` sets the largest n that goes by subsets,
    where the costs shall not choose it; the result is the same.
    """
    out = grouped(identified(docs), percent, width, boundary)
    return out.select(named("_id").alias("doc_id"), "n_shingles", named("_component").alias("component_id"))


def grouped(rows: DataFrame, percent: int = PERCENT, width: int = WORDS, boundary: int | None = None) -> DataFrame:
    """_id, n_shingles, _component of every row of (_id, text); see `near_duplicates`."""
    members, _, parts = linked_sets(rows, percent, width, boundary)
    return members.join(parts, "rep", "left").select("_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("_component"))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle, and all that links reach.
OP1_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as materialized (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from w where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by 1),
pairs as materialized (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as materialized (
  select a, b from pairs join n x on a = x.doc_id join n y on b = y.doc_id where 100 * shared >= 85 * (x.n + y.n - shared)),
step as materialized (select a, b from links union select b, a from links),
reach(id, r) as (select doc_id, doc_id from documents union select reach.id, step.b from reach join step on reach.r = step.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id
from documents d left join n on d.doc_id = n.doc_id join (select id, min(r) as component_id from reach group by 1) c on d.doc_id = c.id
"""

__all__ = ["grouped", "linked_sets", "near_duplicates", "op1_ngram_join", "shingle_sets"]
