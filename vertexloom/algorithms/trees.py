"""Minimum spanning forests by Boruvka rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.lineage import cut
from .components import connected_components


def minimum_spanning_forest(graph: PropertyGraph, weight: str = "weight") -> DataFrame:
    """src, dst, weight of the chosen edges, as stored; one tree for each connected component.

    Edges are ordered by (weight, src, dst), which makes the tree unique; of
    parallel edges one is taken. A round picks every fragment's least outgoing
    edge and merges fragments, so the rounds grow with the logarithm of the
    vertices where picking one edge at a time would take as many as vertices.
    """
    edges = graph.edges.where("src <> dst").groupBy("src", "dst").agg(F.min(weight).alias("w"))
    open_edges = cut(edges.select("src", "dst", "w", F.col("src").alias("x"), F.col("dst").alias("y")))
    chosen = None
    while open_edges.limit(1).count():
        order = F.struct("w", "src", "dst")
        sides = open_edges.select(F.explode(F.array("x", "y")).alias("f"), order.alias("e"))
        pick = sides.groupBy("f").agg(F.min("e").alias("e")).select("e.*").distinct()
        pick = cut(pick.join(open_edges, ["w", "src", "dst"]).select("src", "dst", "w", "x", "y"))
        chosen = pick.select("src", "dst", "w") if chosen is None else cut(chosen.unionByName(pick.select("src", "dst", "w")))
        parts = cut(connected_components(pick, "x", "y"))
        px, py = parts.select(F.col("id").alias("x"), F.col("component").alias("cx")), parts.select(F.col("id").alias("y"), F.col("component").alias("cy"))
        moved = open_edges.join(px, "x", "left").join(py, "y", "left").select("src", "dst", "w", F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y"))
        open_edges = cut(moved.where("x <> y"))
    if chosen is None:
        chosen = edges.limit(0)
    return chosen.select("src", "dst", F.col("w").alias(weight))
