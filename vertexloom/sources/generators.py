"""Seeded graph generators."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph


def rmat(spark: SparkSession, vertices: int, edges: int, seed: int = 17, a: float = 0.45, b: float = 0.15, c: float = 0.15) -> PropertyGraph:
    """Recursive quadrant sampling; vertices are rounded up to a power of two, repeated edges merge."""
    bits = max(1, (vertices - 1).bit_length())
    draws = spark.range(edges).select(*[F.rand(seed + k).alias(f"u{k}") for k in range(bits)])
    src = dst = F.lit(0).cast("long")
    for k in range(bits):
        u = F.col(f"u{k}")
        src = src * 2 + F.when(u < a + b, 0).otherwise(1)
        dst = dst * 2 + F.when((u < a) | ((u >= a + b) & (u < a + b + c)), 0).otherwise(1)
    pairs = draws.select(src.alias("src"), dst.alias("dst")).distinct()
    return PropertyGraph.from_edge_tuples(pairs)


def log_normal(spark: SparkSession, vertices: int, mu: float = 4.0, sigma: float = 1.3, seed: int = 17) -> PropertyGraph:
    """Out-degrees are log-normal, at most the number of vertices; destinations uniform. Vertex attr is 1."""
    degree = F.least(F.lit(vertices), F.floor(F.exp(F.lit(mu) + F.lit(sigma) * F.randn(seed)))).cast("int")
    sources = spark.range(vertices).select(F.col("id").alias("src"), degree.alias("n")).where("n > 0")
    edges = sources.select("src", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    edges = edges.select("src", F.floor(F.rand(seed + 1) * vertices).cast("long").alias("dst"), F.lit(1).alias("attr"))
    return PropertyGraph(spark.range(vertices).withColumn("attr", F.lit(1)), edges)


def grid(spark: SparkSession, rows: int, cols: int) -> PropertyGraph:
    """A lattice with edges to the right and down; ids row by row, attributes row and col."""
    vertices = spark.range(rows * cols).select("id", F.expr(f"id div {cols}").alias("row"), F.expr(f"id % {cols}").alias("col"))
    right = vertices.where(F.col("col") < cols - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = vertices.where(F.col("row") < rows - 1).select(F.col("id").alias("src"), (F.col("id") + cols).alias("dst"))
    return PropertyGraph(vertices, right.unionByName(down).withColumn("attr", F.lit(1)))


def star(spark: SparkSession, vertices: int) -> PropertyGraph:
    """Edges from every other vertex to vertex 0."""
    return PropertyGraph(spark.range(vertices).withColumn("attr", F.lit(1)), spark.range(1, vertices).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(1).alias("attr")))
