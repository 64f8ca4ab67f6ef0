"""PageRank, fixed rounds or to a tolerance, full or personalised."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.lineage import cut
from ..plans.pregel import NotConverged


def _step(graph: PropertyGraph, links: DataFrame, ranks: DataFrame, damping: float, source: int | None) -> DataFrame:
    share = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out_degree")).alias("got"))
    base = F.lit(1 - damping) if source is None else F.when(F.col("id") == source, 1 - damping).otherwise(0.0)
    return ranks.select("id").join(share, "id", "left").select("id", (base + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"))


def _prepared(graph: PropertyGraph) -> DataFrame:
    links = graph.edges.select("src", "dst").join(graph.out_degrees().withColumnRenamed("id", "src"), "src")
    return cut(links)


def _start(graph: PropertyGraph, init: float, source: int | None) -> DataFrame:
    first = F.lit(float(init)) if source is None else F.when(F.col("id") == source, F.lit(float(init))).otherwise(0.0)
    return graph.vertices.select("id", first.alias("rank"))


def _normalized(ranks: DataFrame) -> DataFrame:
    total = ranks.agg((F.count("*") / F.sum("rank")).alias("_f"))
    return ranks.crossJoin(F.broadcast(total)).select("id", (F.col("rank") * F.col("_f")).alias("rank"))  # one row


def pagerank_rounds(graph: PropertyGraph, rounds: int, damping: float = 0.85, init: float = 1.0, normalize: bool = False, source: int | None = None) -> DataFrame:
    """id, rank after a fixed number of rounds of ``(1 - damping) + damping * sum(rank / out_degree)``.

    The rank of vertices without out-edges is not passed on; `normalize` scales
    the result to a mean of 1. With `source` only that vertex starts and teleports.
    """
    return pagerank_stages(graph, (rounds,), damping, init, normalize, source)[0]


def pagerank_stages(graph: PropertyGraph, rounds: Sequence[int], damping: float = 0.85, init: float = 1.0, normalize: bool = False, source: int | None = None) -> list[DataFrame]:
    """The ranks after each number of rounds, out of one run."""
    links, ranks = _prepared(graph), _start(graph, init, source)
    at = {0: ranks}
    for k in range(max(rounds)):
        ranks = at[k + 1] = cut(_step(graph, links, ranks, damping, source))
    return [_normalized(at[k]) if normalize else at[k] for k in rounds]


def pagerank(graph: PropertyGraph, tol: float = 0.001, damping: float = 0.85, init: float = 1.0, source: int | None = None, max_rounds: int = 200) -> DataFrame:
    """id, rank: rounds until no rank moves by `tol` or more; NotConverged where one still does after max_rounds."""
    links, ranks = _prepared(graph), cut(_start(graph, init, source))
    for _ in range(max_rounds):
        nxt = cut(_step(graph, links, ranks, damping, source))
        moved = nxt.join(ranks.withColumnRenamed("rank", "old"), "id").agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = nxt
        if (moved or 0.0) < tol:
            return ranks
    raise NotConverged(f"ranks still move by {moved} after {max_rounds} rounds")
