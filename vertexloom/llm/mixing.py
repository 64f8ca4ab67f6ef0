"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
BLOCK = 128
#: Above this many sources the source table is joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 20_000


#: Rows or parts to a window: a level has at most FAN times as many groups as the one above it.
ROWS, FAN = 2000, 4096


def _rows_below(df: DataFrame, group: str, levels: list[str], order: list, value: F.Column, name: str) -> DataFrame:
    """Sum of `value` over the rows of `group` that stand before, in (levels, order).

    levels: columns from the coarsest to the finest, each a refinement of the one
    before it. Totals are summed level by level, so every window holds a bounded
    number of rows, and a group with most of the rows is spread over its parts.
    """
    totals, offsets = [], None
    for k in range(len(levels), 0, -1):
        below = totals[0].select(group, *levels[:k], "_total") if totals else df.select(group, *levels[:k], value.alias("_total"))
        totals.insert(0, below.groupBy(group, *levels[:k]).agg(F.sum("_total").alias("_total")))
    for k, total in enumerate(totals):
        before = Window.partitionBy(group, *levels[:k]).orderBy(levels[k]).rowsBetween(Window.unboundedPreceding, -1)
        here = total.withColumn("_at", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
        if offsets is not None:
            here = here.join(offsets, [group, *levels[:k]]).withColumn("_at", F.col("_at") + F.col("_offset")).drop("_offset")
        offsets = here.withColumnRenamed("_at", "_offset")
    inner = Window.partitionBy(group, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(offsets, [group, *levels])
    return df.withColumn(name, F.col("_offset") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_offset", *levels)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per source: rank, source, source_size, weight, target, take.

    Sources in code-point order, null last, take `weights` in turn. Targets share
    the words of all sources by weight; none is above `most` times its source's
    words, and what that cuts off goes to the others by weight. The windows run
    over one row per source.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    src = src.withColumn("rank", rank)
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % n + 1).cast("int")))
    full = Window.partitionBy()
    before = Window.orderBy((F.col("source_size") / F.col("weight")), "rank").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.lit(float(most)) * F.col("source_size")
    src = src.withColumn("rest", F.sum("source_size").over(full).cast("double") - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
    src = src.withColumn("wrest", F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    src = src.withColumn("capped", cap * F.col("wrest") < F.col("rest") * F.col("weight"))
    free = F.when(~F.col("capped"), F.lit(1))
    level = (F.sum("source_size").over(full).cast("double") - F.coalesce(F.sum(F.when(F.col("capped"), cap)).over(full), F.lit(0.0))) / F.sum(free * F.col("weight")).over(full)
    src = src.withColumn("target", F.when(F.col("capped"), cap).otherwise(level * F.col("weight")))
    return src.select("rank", "source", "source_size", "weight", "target", F.floor(F.col("target") + 0.5).cast("long").alias("take"))


def schedule(spark, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots of the mix: slot, rank (of the source), j (the source's j-th block), words.

    Slot k draws the point frac((k + 1) * golden ratio), whose place among the
    sources' cumulative targets names the source; slots are ranked within their
    source. A source that the points leave a slot short of its target gets it at
    the end; one they overfill loses its last. The join is on grid cells, as many
    as sources, so it grows with slots and sources, not with their product.
    """
    total, n_sources = sources.agg(F.sum("take"), F.count("*")).first()
    total, cells = int(total or 0), max(1, int(n_sources))
    slots = total // block
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    spans = sources.withColumn("_lo", F.coalesce(F.sum("take").over(before), F.lit(0)) / F.lit(float(max(1, total)))).withColumn("_hi", F.col("_lo") + F.col("take") / F.lit(float(max(1, total))))
    spans = spans.withColumn("_hi", F.when(F.max("rank").over(Window.partitionBy()) == F.col("rank"), F.lit(2.0)).otherwise(F.lead("_lo").over(Window.orderBy("rank"))))
    spans = spans.select("rank", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") * cells).cast("long"), F.least(F.lit(cells - 1), F.floor(F.col("_hi") * cells)).cast("long"))).alias("_cell"))
    coarse = math.modf(float(1 << 20) * GOLDEN)[0]
    k = F.col("id") + 1
    point = F.expr(f"(id + 1) div {1 << 20}") * F.lit(coarse) + (k % (1 << 20)) * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u")).withColumn("_cell", F.floor(F.col("u") * cells).cast("long"))
    depth = max(1, math.ceil(math.log(max(2, slots), FAN)) - 1)
    parts = [F.expr(f"slot div {FAN ** k}").alias(f"_p{k}") for k in range(depth, 0, -1)]
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else lambda x: x
    drawn = points.join(small(spans), "_cell").where("_lo <= u and u < _hi").select("slot", "rank", *parts)
    drawn = _rows_below(drawn, "rank", [f"_p{k}" for k in range(depth, 0, -1)], ["slot"], F.lit(1), "j").select("slot", "rank", "j")
    need = F.ceil(F.col("take") / F.lit(float(block))).cast("long")
    have = drawn.groupBy("rank").agg(F.count("*").alias("_have"))
    short = sources.join(have, "rank", "left").select("rank", need.alias("_need"), F.coalesce("_have", F.lit(0)).alias("_have")).where("_have < _need")
    added = short.select("rank", F.explode(F.sequence(F.col("_have"), F.col("_need") - 1)).alias("j")).select((F.lit(slots) + F.col("j") * cells + F.col("rank")).alias("slot"), "rank", "j")
    both = drawn.unionByName(added).join(small(sources.select("rank", "take")), "rank")
    return both.where(F.col("j") * block < F.col("take")).select("slot", "rank", "j", F.least(F.lit(block), F.col("take") - F.col("j") * block).alias("words"))


def mix(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Plan a mix of all documents: (pieces, documents).

    pieces: slot, doc_id, words: the words that a slot of the schedule takes from
    a document. documents: doc_id, source, size, source_size, target, taken, n_slots
    and first_slot (how many slots take from it, and the first; null if none), and
    text_hash, which with doc_id tells rows apart.

    Each source's documents stand in the order of the md5 of their id, end to end,
    as one line of words cut into blocks of `block` words. The slot of rank j
    takes the line's j-th block; a source whose target exceeds its words starts
    again, at most `most` times. A source's taken words equal its rounded target.

    Null, empty and blank texts have size 0 and are never taken. A null source is
    a source of its own, the last. A null doc_id stands by the md5 of its text.
    Rows that repeat a doc_id are documents of their own, side by side in the order
    of their size and the hash of their text. Other columns are ignored. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "mix")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    # a row's number is fixed where it is written
    sizes = stage.write(docs.select("doc_id", "source", size.alias("size"), key.alias("key"), F.xxhash64("text").alias("text_hash")).withColumn("_row", F.monotonically_increasing_id()), "sizes")
    sources = stage.write(source_targets(sizes, weights, most), "sources")
    n_rows, n_sources = sizes.count(), sources.count()
    digits = max(1, math.ceil(math.log(max(1, n_rows) / ROWS, 16))) if n_rows > ROWS else 1
    cuts = list(range(digits, 0, -3))[::-1]
    small = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    placed = sizes.alias("d").join(small.alias("s"), F.expr("d.source <=> s.source")).select("_row", "doc_id", "text_hash", "d.source", "size", "key", "rank", "source_size", "target", "take", *[F.substring("key", 1, k).alias(f"_k{k}") for k in cuts])
    placed = stage.write(_rows_below(placed, "rank", [f"_k{k}" for k in cuts], ["key", F.col("doc_id").asc_nulls_last(), "size", "text_hash", "_row"], F.col("size"), "start").drop("key"), "placed")
    rounds = placed.where("size > 0").select("_row", "doc_id", "rank", "size", "take", "source_size", "start", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("round"))
    rounds = rounds.withColumn("lo", F.col("round") * F.col("source_size") + F.col("start")).where("lo < take").withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("take")))
    parts = rounds.select("_row", "doc_id", "rank", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))).alias("j"))
    parts = parts.select("_row", "doc_id", "rank", "j", (F.least("hi", (F.col("j") + 1) * block) - F.greatest("lo", F.col("j") * block)).alias("words"))
    pieces = schedule(spark, sources, block).select("slot", "rank", "j").join(parts, ["rank", "j"]).select("slot", "_row", "doc_id", "words")
    taken = pieces.groupBy("_row").agg(F.sum("words").alias("taken"), F.count("*").alias("n_slots"), F.min("slot").alias("first_slot"))
    out = placed.select("_row", "doc_id", "text_hash", "source", "size", "source_size", "target").join(taken, "_row", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("taken", "n_slots")}).drop("_row")
    return pieces.drop("_row"), out


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes words from, with all their columns and size, target (of the source) and taken.

    Rows with null or repeated ids meet their own part of the plan; equal rows share
    theirs in any order. A column of the documents named size, target or taken gives
    way to the mix's. An empty table gives no rows.
    """
    new = ("size", "target", "taken")
    plan = mix(docs)[1].select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), *new)
    copy = Window.partitionBy("_i", "_h").orderBy(F.col("taken").desc())
    plan = plan.withColumn("_n", F.row_number().over(copy)).where("taken > 0")
    names = [c for c in docs.columns if c.lower() not in new]
    rows = docs.select(F.struct(*names).alias("_d"), F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_h"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_i", "_h").orderBy(F.lit(1))))
    both = rows.alias("d").join(plan.alias("p"), F.expr("d._i <=> p._i and d._h = p._h and d._n = p._n"))
    return both.select(*[F.col("d._d").getField(c).alias(c) for c in names], *[F.col(f"p.{c}").alias(c) for c in new])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))[1].drop("source", "text_hash")


#: The same mix by one window and one join of all points with the sources' ranges.
OP6_SQL = r"""
with s as (
  select row_number() over () as id, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(coalesce(doc_id::varchar, text, '')) as key, text
  from documents),
g as (select source, sum(size)::bigint as source_size from s group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as rank from g),
w as (select *, case rank % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from r),
b as (
  select *, sum(source_size) over ()::double as total, sum(weight) over () as wsum,
    coalesce(sum(3.0::double * source_size) over (order by source_size / weight, rank rows between unbounded preceding and 1 preceding), 0) as gone,
    coalesce(sum(weight) over (order by source_size / weight, rank rows between unbounded preceding and 1 preceding), 0) as wgone
  from w),
c as (select *, 3.0::double * source_size * (wsum - wgone) < (total - gone) * weight as capped from b),
l as (
  select *, (total - coalesce(sum(case when capped then 3.0::double * source_size end) over (), 0))
    / sum(case when not capped then weight end) over () as level
  from c),
t as (select rank, source, source_size, case when capped then 3.0::double * source_size else level * weight end as target from l),
u as (select *, floor(target + 0.5)::bigint as take from t),
n as (select sum(take)::bigint as total, count(*) as cells, (sum(take) // 128)::bigint as slots from u),
lo as (
  select rank, take, coalesce(sum(take) over (order by rank rows between unbounded preceding and 1 preceding), 0)::double
    / greatest(1, (select total from n))::double as lo
  from u),
span as (select *, coalesce(lead(lo) over (order by rank), 2.0::double) as hi from lo),
point as (
  select slot, ((slot + 1) // 1048576)::double * COARSE::double + ((slot + 1) % 1048576)::double * 0.6180339887498949::double as x
  from range(0, (select slots from n)) as k(slot)),
drawn as (
  select slot, rank, row_number() over (partition by rank order by slot) - 1 as j
  from (select slot, x - floor(x) as u from point) join span on lo <= u and u < hi),
have as (
  select u.rank, take, ceil(take / 128.0::double)::bigint as need, count(d.slot) as have
  from u left join drawn d on u.rank = d.rank group by u.rank, take),
added as (
  select n.slots + x.j * n.cells + rank as slot, rank, x.j
  from have, n, range(have, need) as x(j) where have < need),
plan as (select d.* from (select * from drawn union all select * from added) d join u on d.rank = u.rank where d.j * 128 < u.take),
p as (
  select s.id, s.doc_id, s.size, u.rank, u.source_size, u.target, u.take,
    (sum(s.size) over (partition by u.rank order by s.key, s.doc_id nulls last, s.size, s.text, s.id rows unbounded preceding) - s.size)::bigint as start
  from s join u on s.source is not distinct from u.source),
turn as (
  select id, rank, r.i * source_size + start as first, least(r.i * source_size + start + size, take) as past
  from p, range(0, 3) as r(i) where size > 0 and r.i * source_size + start < take),
block as (
  select id, rank, j, least(past, (j + 1) * 128) - greatest(first, j * 128) as words
  from (select *, unnest(range(first // 128, (past - 1) // 128 + 1)) as j from turn)),
got as (
  select b.id, sum(words)::bigint as taken, count(*) as n_slots, min(slot) as first_slot
  from block b join plan on b.rank = plan.rank and b.j = plan.j group by b.id)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, coalesce(n_slots, 0)::bigint as n_slots, first_slot
from p left join got on p.id = got.id
""".replace("COARSE", repr(math.modf(float(1 << 20) * GOLDEN)[0]))
