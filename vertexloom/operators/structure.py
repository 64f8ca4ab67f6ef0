"""Whole-graph operators: merging, keyed tables, ego circles, extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..algorithms.components import connected_components
from ..graph import PropertyGraph, endpoints
from ..plans.lineage import cut
from ..sources.readers import dense_ids


def merge_graphs(one: PropertyGraph, two: PropertyGraph, attribute: str = "attr") -> PropertyGraph:
    """Vertices unified by attribute value under new ids; the edges of both, re-keyed, duplicates kept."""
    ids = dense_ids(one.vertices.select(attribute).unionByName(two.vertices.select(attribute)), attribute)

    def rekeyed(g: PropertyGraph) -> DataFrame:
        new = g.vertices.select("id", attribute).join(ids.withColumnRenamed("id", "new"), attribute).select("id", "new")
        rest = [c for c in g.edges.columns if c not in ("src", "dst")]
        out = g.edges.join(new.select(F.col("id").alias("src"), F.col("new").alias("_s")), "src").join(new.select(F.col("id").alias("dst"), F.col("new").alias("_d")), "dst")
        return out.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *rest)

    return PropertyGraph(ids, rekeyed(one).unionByName(rekeyed(two)))


class KeyedTable:
    """A key-unique table with point reads and writes; every write gives a new table and leaves the old one valid."""

    def __init__(self, rows: DataFrame, key: str = "k"):
        self.rows, self.key = rows, key

    @staticmethod
    def of(rows: DataFrame, key: str = "k", partitions: int | None = None) -> KeyedTable:
        """Rows dealt by key; of repeated keys one stays."""
        rows = rows.dropDuplicates([key])
        return KeyedTable(rows.repartition(partitions, key) if partitions else rows, key)

    def get(self, *keys: object) -> DataFrame:
        return self.rows.where(F.col(self.key).isin(list(keys)))

    def put(self, rows: DataFrame) -> KeyedTable:
        """Insert, or replace rows of the same key; of repeated keys in `rows` one goes in."""
        rows = rows.dropDuplicates([self.key])
        return KeyedTable(self.rows.join(rows.select(self.key), self.key, "left_anti").unionByName(rows), self.key)

    def delete(self, keys: DataFrame) -> KeyedTable:
        return KeyedTable(self.rows.join(keys.select(self.key), self.key, "left_anti"), self.key)

    def inner_join(self, other: KeyedTable, **columns: Column) -> DataFrame:
        return self.rows.alias("a").join(other.rows.alias("b"), self.key).select(self.key, *[v.alias(k) for k, v in columns.items()])


def ego_circles(edges: DataFrame) -> DataFrame:
    """ego, component, members of (ego, src, dst) edges: the components of every ego's network, in one run.

    (ego, id) pairs are numbered once, so all networks contract together instead
    of one job for each.
    """
    nodes = edges.select("ego", F.explode(F.array("src", "dst")).alias("id")).distinct()
    keys = cut(dense_ids(nodes.select(F.struct("ego", "id").alias("node")), "node").select(F.col("id").alias("k"), "node.ego", "node.id"))
    src, dst = keys.select(F.col("k").alias("a"), "ego", F.col("id").alias("src")), keys.select(F.col("k").alias("b"), "ego", F.col("id").alias("dst"))
    pairs = edges.join(src, ["ego", "src"]).join(dst, ["ego", "dst"]).select("a", "b")
    parts = connected_components(pairs, "a", "b")
    named = keys.join(parts.withColumnRenamed("id", "k"), "k")
    circles = named.groupBy("ego", F.col("component").alias("_c")).agg(F.sort_array(F.collect_list("id")).alias("members"))
    return circles.select("ego", F.col("members")[0].alias("component"), "members")


def extreme(table: DataFrame, value: str, largest: bool = True) -> DataFrame:
    """The row with the largest (or smallest) value; ties to the smaller id."""
    return table.orderBy(F.col(value).desc() if largest else F.col(value).asc(), "id").limit(1)


def iterate_state(graph: PropertyGraph, rounds: int, step, every: int = 50) -> DataFrame:
    """Applies `step(vertices, edges)` to the vertices `rounds` times; the lineage is cut every `every` rounds."""
    vertices = graph.vertices
    for k in range(1, rounds + 1):
        vertices = step(vertices, graph.edges)
        if k % every == 0:
            vertices = cut(vertices)
    return vertices


__all__ = ["KeyedTable", "ego_circles", "endpoints", "extreme", "iterate_state", "merge_graphs"]
