"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, fingerprint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """id, component for every endpoint: the smallest id its undirected component holds.

    The rounds grow with the logarithm of the component size, not with the
    diameter. Every aggregation combines on the map side, so a vertex with most of
    the edges sends one row a task to it; the join that follows does bring all
    edges of such a vertex to one task. Self-loops only name their vertex.
    """
    pairs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    pairs = cut(pairs.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct())
    stars = pairs.where("u <> v")
    state = fingerprint(stars, "u", "v")
    for _ in range(max_rounds):
        stars = cut(_small_star(_large_star(stars)))
        now = fingerprint(stars, "u", "v")
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"connected_components: no fixpoint in {max_rounds} rounds")
    found = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
