"""Bulk-synchronous iteration with Column expressions for the three functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph, _col
from .lineage import cut, without_estimate

ACTIVE = {"out": "src__a", "in": "dst__a", "either": "src__a or dst__a", "both": "src__a and dst__a"}


class NotConverged(RuntimeError):
    """The loop reached its limit with messages still on their way."""


def pregel(graph: PropertyGraph, state: Mapping[str, Column | str], update: Mapping[str, Column | str], merge: Sequence[Column], to_dst: Mapping[str, Column | str] | None = None, to_src: Mapping[str, Column | str] | None = None, dst_if: Column | str | None = None, src_if: Column | str | None = None, max_iter: int = 100, active: str = "either", strict: bool = True) -> PropertyGraph:
    """Vertices get `state`; then rounds of messages, merge and `update` until none is sent.

    Messages are expressions over the triplet (src_*, dst_* and edge columns);
    merge aggregates them by receiver; update gives the new state of the receivers
    from old state and merged columns, other vertices keep theirs. From the second
    round an edge sends only if its `active` ends received a message in the last.
    A round is one checkpointed job. `strict` raises NotConverged where messages
    are left after max_iter rounds (a cycle with an unconditional send never ends).
    """
    names = list(state)
    vertices = cut(graph.vertices.select("id", *[_col(v).alias(k) for k, v in state.items()], F.lit(True).alias("_a")))
    edges = cut(graph.edges)
    for _ in range(max_iter):
        turn = PropertyGraph(vertices, edges)
        live = PropertyGraph(vertices, turn.triplets().where(ACTIVE[active]))
        messages = _messages(live.edges, merge, to_src, to_dst, src_if, dst_if)
        joined = vertices.join(messages.withColumn("_hit", F.lit(True)), "id", "left")
        new = [F.when(F.col("_hit"), _col(update[k])).otherwise(vertices[k]).alias(k) if k in update else vertices[k] for k in names]
        nxt = without_estimate(cut(joined.select("id", *new, F.coalesce("_hit", F.lit(False)).alias("_a"))))
        received = nxt.where("_a").limit(1).count()
        vertices = nxt
        if not received:
            break
    else:
        if strict:
            raise NotConverged(f"messages left after {max_iter} rounds")
    return PropertyGraph(vertices.drop("_a"), edges)


def _messages(triplets: DataFrame, merge, to_src, to_dst, src_if, dst_if) -> DataFrame:
    sent = []
    for target, fields, when in (("src", to_src, src_if), ("dst", to_dst, dst_if)):
        if fields is not None:
            message = F.struct(F.col(target).alias("id"), *[_col(v).alias(k) for k, v in fields.items()])
            sent.append(message if when is None else F.when(_col(when), message))
    rows = triplets.select(F.explode(F.array(*sent)).alias("m")).where("m is not null").select("m.*")
    return rows.groupBy("id").agg(*merge)
