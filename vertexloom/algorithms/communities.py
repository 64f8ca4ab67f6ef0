"""Strongly connected components, label propagation, triangles and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.lineage import cut, fingerprint
from ..plans.pregel import NotConverged
from .components import connected_components
from .corners import corner_counts


def component_members(labels: DataFrame) -> DataFrame:
    """component, members (sorted ids)."""
    return labels.groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members"))


def strong_components(graph: PropertyGraph, max_rounds: int = 200) -> DataFrame:
    """id, component: the smallest id of the strongly connected component.

    A round trims vertices without in- or out-edges among those left (each is its
    own component), spreads the smallest id forward as a colour, and walks back
    from every colour's root inside its colour: what it reaches is the root's
    component. Only vertices without a component stay for the next round.
    """
    ids = cut(graph.vertices.select("id"))
    edges = cut(graph.edges.where("src <> dst").select("src", "dst").distinct())
    done = ids.select("id", F.col("id").alias("component")).limit(0)
    left = ids
    for _ in range(max_rounds):
        while True:
            both = edges.select(F.col("dst").alias("id")).intersect(edges.select(F.col("src").alias("id")))
            kept = cut(left.join(both, "id", "left_semi"))
            gone = left.join(kept, "id", "left_anti")
            if not gone.limit(1).count():
                break
            done = cut(done.unionByName(gone.select("id", F.col("id").alias("component"))))
            left = kept
            edges = cut(_within(edges, left))
        if not left.limit(1).count():
            return done
        colour = left.select("id", F.col("id").alias("colour"))
        state = None
        while True:
            sent = edges.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("m"))
            colour = cut(colour.join(sent, "id", "left").select("id", F.least("colour", "m").alias("colour")))
            now = fingerprint(colour, "id", "colour")
            if now == state:
                break
            state = now
        tinted = edges.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("d")), "dst").where("c = d").select("src", "dst")
        back = cut(tinted)
        found = cut(colour.where("id = colour"))
        front = found
        while True:
            step = back.join(front.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "colour").distinct()
            front = cut(step.join(found, "id", "left_anti"))
            if not front.limit(1).count():
                break
            found = cut(found.unionByName(front))
        done = cut(done.unionByName(found.withColumnRenamed("colour", "component")))
        left = cut(left.join(found, "id", "left_anti"))
        edges = cut(_within(edges, left))
    raise NotConverged(f"vertices without a component after {max_rounds} rounds")


def _within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def label_propagation(graph: PropertyGraph, rounds: int = 5) -> DataFrame:
    """id, label after synchronous rounds: the most frequent label among neighbours in either direction, the smallest on ties."""
    pairs = cut(graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("n")), F.struct(F.col("dst").alias("id"), F.col("src").alias("n")))).alias("e")).select("e.*"))
    labels = graph.vertices.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        votes = pairs.join(labels.withColumnRenamed("id", "n"), "n").groupBy("id", "label").agg(F.count("*").alias("votes"))
        won = votes.groupBy("id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "label")).alias("w")).select("id", F.col("w.label").alias("new"))
        labels = cut(labels.join(won, "id", "left").select("id", F.coalesce("new", "label").alias("label")))
    return labels


def simple_edges(edges: DataFrame) -> DataFrame:
    """Undirected simple edges (a < b), one of each."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _counts(edges: DataFrame) -> DataFrame:
    """id, triangles of the vertices of simple edges that have any."""
    return corner_counts(cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))))


def triangles(graph: PropertyGraph) -> DataFrame:
    """id, triangles of every vertex, of the undirected simple graph."""
    found = _counts(simple_edges(graph.edges))
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))


def bucketed_triangles(graph: PropertyGraph, width: int, buckets: int) -> DataFrame:
    """bucket, total: per-vertex triangle counts added up in the subgraph of ids [width * bucket, width * (bucket + 1)).

    One plan for all buckets. They go up to that of the largest id, and there are at least `buckets`.
    """
    spark = graph.vertices.sparkSession
    inside = graph.edges.where(F.expr(f"src div {width} = dst div {width} and src >= 0 and dst >= 0"))
    found = _counts(simple_edges(inside)).groupBy(F.expr(f"id div {width}").alias("bucket")).agg(F.sum("triangles").alias("total"))
    last = graph.vertices.agg(F.max(F.expr(f"id div {width}"))).first()[0]
    return spark.range(max(buckets, (last or 0) + 1)).select(F.col("id").alias("bucket")).join(found, "bucket", "left").select("bucket", F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def clustering_coefficient(graph: PropertyGraph) -> DataFrame:
    """One row: triangles (over vertices, three times the triangles), triplets, coefficient (0 without triplets)."""
    simple = cut(simple_edges(graph.edges))
    degree = simple.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("g"))
    triplets = degree.agg(F.coalesce(F.sum(F.expr("g * (g - 1) div 2")), F.lit(0)).alias("triplets"))
    closed = _counts(simple).agg(F.coalesce(F.sum("triangles"), F.lit(0)).alias("triangles"))
    return closed.crossJoin(triplets).select("triangles", "triplets", F.when(F.col("triplets") > 0, F.col("triangles") / F.col("triplets")).otherwise(0.0).alias("coefficient"))


__all__ = ["bucketed_triangles", "clustering_coefficient", "component_members", "connected_components", "label_propagation", "simple_edges", "strong_components", "triangles"]
