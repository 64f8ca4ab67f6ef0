"""Shortest paths: weighted with traces, hops to landmarks, deepest hops of a DAG, greedy tours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.lineage import cut
from ..plans.pregel import NotConverged, pregel


def shortest_paths(graph: PropertyGraph, source: int, weight: str = "weight", max_rounds: int = 500, unreachable: float | None = None) -> DataFrame:
    """id, dist: least directed path weight from source, by relaxing the edges of a frontier.

    A round relaxes only the out-edges of vertices whose distance fell, so the
    rounds are those of the longest best path. Unreachable vertices have
    `unreachable` (null by default). Negative edges are fine, negative cycles raise.
    """
    paths = _relaxed(graph, source, weight, max_rounds, False)
    out = graph.vertices.select("id").join(paths, "id", "left")
    return out.select("id", F.coalesce("dist", F.lit(unreachable).cast("double")).alias("dist"))


def shortest_path_traces(graph: PropertyGraph, source: int, weight: str = "weight", max_rounds: int = 500) -> DataFrame:
    """id, dist, path: the ids before a vertex on a best path, itself left out; of equal paths the first in order."""
    return graph.vertices.select("id").join(_relaxed(graph, source, weight, max_rounds, True), "id", "left")


def _relaxed(graph: PropertyGraph, source: int, weight: str, max_rounds: int, trace: bool) -> DataFrame:
    edges = cut(graph.edges.select("src", "dst", F.col(weight).cast("double").alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")))
    none = F.array().cast("array<bigint>")
    best = graph.vertices.where(F.col("id") == source).select("id", F.lit(0.0).alias("dist"), none.alias("path"), F.lit(True).alias("_new"))
    best = cut(best)
    for _ in range(max_rounds):
        front = best.where("_new").select(F.col("id").alias("src"), "dist", "path")
        path = F.array_append("path", F.col("src")) if trace else F.col("path")
        offers = front.join(edges, "src").select(F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"), path.alias("path"))
        offers = offers.groupBy("id").agg(F.min(F.struct("dist", "path")).alias("o"))
        joined = best.join(offers, "id", "full")
        better = F.col("o").isNotNull() & (F.col("dist").isNull() | (F.struct(F.col("o.dist"), F.col("o.path")) < F.struct("dist", "path")))
        best = cut(joined.select("id", F.when(better, F.col("o.dist")).otherwise(F.col("dist")).alias("dist"), F.when(better, F.col("o.path")).otherwise(F.col("path")).alias("path"), better.alias("_new")))
        if not best.where("_new").limit(1).count():
            return best.select("id", "dist", *(["path"] if trace else []))
    raise NotConverged(f"distances still fall after {max_rounds} rounds")


def hops_to_landmarks(graph: PropertyGraph, landmarks: Sequence[int], max_rounds: int = 500) -> DataFrame:
    """id, landmark, hops along edge directions; pairs without a path are absent."""
    back = graph.edges.where("src <> dst").select(F.col("dst").alias("at"), F.col("src").alias("id")).distinct()
    back = cut(back)
    found = cut(graph.vertices.where(F.col("id").isin(list(landmarks))).select("id", F.col("id").alias("landmark"), F.lit(0).cast("long").alias("hops")))
    front, hops = found, 0
    for _ in range(max_rounds):
        hops += 1
        step = front.select(F.col("id").alias("at"), "landmark").join(back, "at").select("id", "landmark").distinct()
        front = cut(step.join(found, ["id", "landmark"], "left_anti").withColumn("hops", F.lit(hops).cast("long")))
        if not front.limit(1).count():
            return found
        found = cut(found.unionByName(front))
    raise NotConverged(f"new vertices after {max_rounds} rounds")


def max_hops(graph: PropertyGraph, max_iter: int) -> DataFrame:
    """id, hops: the longest path that ends at a vertex of a DAG. A cycle raises NotConverged after max_iter rounds."""
    out = pregel(graph, {"hops": F.lit(0).cast("long")}, {"hops": "greatest(hops, best)"}, [F.max("m").alias("best")], to_dst={"m": "src_hops + 1"}, max_iter=max_iter, active="out")
    return out.vertices


def propagate_edge_count(graph: PropertyGraph, max_iter: int = 1000) -> DataFrame:
    """id, count: every vertex takes the largest count of a predecessor plus one, until the sum no longer grows."""
    edges = cut(graph.edges.select("src", "dst").distinct())
    state, total = cut(graph.vertices.select("id", F.lit(0).cast("long").alias("count"))), 0
    for _ in range(max_iter):
        sent = edges.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg((F.max("count") + 1).alias("new"))
        nxt = cut(state.select("id").join(sent, "id", "left").select("id", F.coalesce("new", F.lit(0)).cast("long").alias("count")))
        now = nxt.agg(F.sum("count")).first()[0] or 0
        if now <= total:
            return state
        state, total = nxt, now
    raise NotConverged(f"counts still grow after {max_iter} rounds")


def greedy_tour(graph: PropertyGraph, origin: int, weight: str = "weight", max_steps: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(vertices: id, visited), (edges with chosen, step): the walk to the nearest vertex not seen yet, over edges in either direction.

    Ties go to the smaller (src, dst); of parallel edges one is marked. The walk
    stops where no new vertex is adjacent, and does not return; NotConverged where
    it could go on after max_steps. One small query a step: only the edges at the
    present vertex are read.
    """
    spark = graph.vertices.sparkSession
    edges = cut(graph.edges.withColumn("_w", F.col(weight).cast("double")).withColumn("_e", F.monotonically_increasing_id()))
    at, seen, chosen = origin, [origin], []
    while True:
        near = edges.where(((F.col("src") == at) & ~F.col("dst").isin(seen)) | ((F.col("dst") == at) & ~F.col("src").isin(seen)))
        best = near.select("src", "dst", "_w", "_e").orderBy("_w", "src", "dst", "_e").limit(1).collect()
        if not best:
            break
        if len(chosen) == max_steps:
            raise NotConverged(f"the walk goes on after {max_steps} steps")
        edge = best[0]
        chosen.append((edge._e, len(chosen)))
        at = edge.dst if edge.src == at else edge.src
        seen.append(at)
    picked = spark.createDataFrame(chosen, "_e long, step int")
    visited = graph.vertices.select("id", F.col("id").isin(seen).alias("visited"))
    marked = edges.join(picked, "_e", "left").withColumn("chosen", F.col("step").isNotNull()).drop("_e", "_w")
    return visited, marked
