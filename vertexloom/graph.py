"""The property graph: two DataFrames and the operations between them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECTIONS = ("in", "out", "either")


@dataclass(frozen=True)
class PropertyGraph:
    """A directed multigraph: vertices(id, ...) with unique ids, edges(src, dst, ...).

    Every operation returns a new graph over the same lazy plans. Parallel edges
    and self-loops are legal and never merged implicitly.
    """

    vertices: DataFrame
    edges: DataFrame

    # -- construction --------------------------------------------------------

    @staticmethod
    def build(vertices: DataFrame, edges: DataFrame, default: Mapping[str, object] | None = None) -> PropertyGraph:
        """Vertices plus those that only edges name, with `default` attributes (null where absent). Repeated ids keep one row."""
        known = vertices.dropDuplicates(["id"])
        ends = endpoints(edges)
        missing = ends.join(known.select("id"), "id", "left_anti")
        kinds = dict(known.dtypes)
        values = default or {}
        filled = missing.select("id", *[F.lit(values.get(c)).cast(kinds[c]).alias(c) for c in known.columns if c != "id"])
        return PropertyGraph(known.unionByName(filled.select(*known.columns)), edges)

    @staticmethod
    def from_edges(edges: DataFrame, **attributes: object) -> PropertyGraph:
        """Vertices are the distinct endpoints, each with the given constant attributes."""
        return PropertyGraph(endpoints(edges).select("id", *[F.lit(v).alias(k) for k, v in attributes.items()]), edges)

    @staticmethod
    def from_edge_tuples(pairs: DataFrame, value: int = 1) -> PropertyGraph:
        """(src, dst) rows become edges; vertices and edges carry attr = value."""
        return PropertyGraph.from_edges(pairs.select("src", "dst", F.lit(value).alias("attr")), attr=value)

    # -- views ---------------------------------------------------------------

    def triplets(self, src: Sequence[str] | None = None, dst: Sequence[str] | None = None) -> DataFrame:
        """Edges with the endpoints' attributes as src_* and dst_*; naming only the needed ones leaves out the other join."""
        out = self.edges
        attrs = [c for c in self.vertices.columns if c != "id"]
        for side, wanted in (("src", src), ("dst", dst)):
            cols = attrs if wanted is None else list(wanted)
            if cols:
                v = self.vertices.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in cols])
                out = out.join(v, side)
        return out

    def in_degrees(self) -> DataFrame:
        """id, in_degree of vertices with an incoming edge."""
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))

    def out_degrees(self) -> DataFrame:
        """id, out_degree of vertices with an outgoing edge."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))

    def degrees(self) -> DataFrame:
        """id, degree; a self-loop counts twice."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        return ends.groupBy("id").agg(F.count("*").alias("degree"))

    # -- maps ----------------------------------------------------------------

    def map_vertices(self, **attributes: Column | str) -> PropertyGraph:
        """New vertex attributes from expressions over id and the old ones; the old ones go."""
        return PropertyGraph(self.vertices.select("id", *[_col(v).alias(k) for k, v in attributes.items()]), self.edges)

    def map_edges(self, **attributes: Column | str) -> PropertyGraph:
        return PropertyGraph(self.vertices, self.edges.select("src", "dst", *[_col(v).alias(k) for k, v in attributes.items()]))

    def map_triplets(self, **attributes: Column | str) -> PropertyGraph:
        """New edge attributes from expressions over the triplet."""
        return PropertyGraph(self.vertices, self.triplets().select("src", "dst", *[_col(v).alias(k) for k, v in attributes.items()]))

    def _named(self, condition: Column | str) -> tuple[list[str], list[str]]:
        """The source's and the destination's attributes that a condition over the triplet may name."""
        text = condition if isinstance(condition, str) else None
        attrs = [c for c in self.vertices.columns if c != "id"]
        return tuple([c for c in attrs if text is None or f"{side}_{c}".lower() in text.lower()] for side in ("src", "dst"))

    # -- restriction ---------------------------------------------------------

    def subgraph(self, vertices: Column | str | None = None, edges: Column | str | None = None) -> PropertyGraph:
        """Vertices that pass, and edges that pass (over the triplet) with both endpoints passing."""
        kept, left = self.vertices, self.edges
        if edges is not None:
            left = self.triplets(*self._named(edges)).where(_col(edges)).select(*self.edges.columns)
        if vertices is not None:
            kept = kept.where(_col(vertices))
            ids = kept.select("id")
            left = left.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return PropertyGraph(kept, left.select(*self.edges.columns))

    def remove_singletons(self) -> PropertyGraph:
        """Vertices without any edge go; a self-loop keeps its vertex."""
        return PropertyGraph(self.vertices.join(endpoints(self.edges), "id", "left_semi"), self.edges)

    def canonical(self) -> PropertyGraph:
        """Every edge turned so that src <= dst; duplicates stay."""
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return PropertyGraph(self.vertices, self.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *rest))

    def partition_edges(self, n: int) -> PropertyGraph:
        """Edges dealt by the hash of both ends, so a vertex with most edges is spread over partitions."""
        return PropertyGraph(self.vertices, self.edges.repartition(n, "src", "dst"))

    # -- joins ---------------------------------------------------------------

    def join_vertices(self, table: DataFrame, **updates: Column | str) -> PropertyGraph:
        """Attributes of vertices that table (keyed by id) matches are replaced; the others keep theirs, even where a new value is null."""
        flag = table.withColumn("_hit", F.lit(True))
        joined = self.vertices.join(flag, "id", "left")
        cols = [F.when(F.col("_hit"), _col(updates[c])).otherwise(self.vertices[c]).alias(c) if c in updates else self.vertices[c] for c in self.vertices.columns]
        return PropertyGraph(joined.select(*cols), self.edges)

    def outer_join_vertices(self, table: DataFrame, **attributes: Column | str) -> PropertyGraph:
        """Left outer join on id; the attributes are computed from both sides and added or replaced."""
        return PropertyGraph(self.vertices.join(table, "id", "left").select(*[c for c in self.vertices.columns if c not in attributes], *[_col(v).alias(k) for k, v in attributes.items()]), self.edges)

    # -- messages ------------------------------------------------------------

    def aggregate_messages(self, *merge: Column, to_src: Mapping[str, Column | str] | None = None, to_dst: Mapping[str, Column | str] | None = None, src_if: Column | str | None = None, dst_if: Column | str | None = None, src: Sequence[str] | None = None, dst: Sequence[str] | None = None) -> DataFrame:
        """id and the merged messages: each edge sends a struct to its source, its destination or both.

        to_src / to_dst name the message's fields as expressions over the triplet,
        src_if / dst_if say when one is sent, `merge` are aggregates over the
        fields. Vertices without a message are absent. Aggregates combine on the
        map side before the shuffle.
        """
        sent = []
        for target, fields, when in (("src", to_src, src_if), ("dst", to_dst, dst_if)):
            if fields is not None:
                message = F.struct(F.col(target).alias("id"), *[_col(v).alias(k) for k, v in fields.items()])
                sent.append(message if when is None else F.when(_col(when), message))
        rows = self.triplets(src, dst).select(F.explode(F.array(*sent)).alias("m")).where("m is not null").select("m.*")
        return rows.groupBy("id").agg(*merge)

    def neighbor_ids(self, direction: str = "either") -> DataFrame:
        """id, neighbors: sorted ids across edges of the direction, with duplicates; isolated vertices have an empty array."""
        if direction not in DIRECTIONS:
            raise ValueError(f"direction is one of {DIRECTIONS}")
        pairs = {"out": [("src", "dst")], "in": [("dst", "src")], "either": [("src", "dst"), ("dst", "src")]}[direction]
        ends = F.array(*[F.struct(F.col(a).alias("id"), F.col(b).alias("n")) for a, b in pairs])
        lists = self.edges.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.sort_array(F.collect_list("e.n")).alias("neighbors"))
        return self.vertices.select("id").join(lists, "id", "left").select("id", F.coalesce("neighbors", F.array().cast(lists.schema["neighbors"].dataType)).alias("neighbors"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def _col(value: Column | str) -> Column:
    return F.expr(value) if isinstance(value, str) else value
