"""Readers of edge lists, features, triples, ego networks, word bags and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import PropertyGraph
from ..plans.lineage import cut


def read_edge_list(spark: SparkSession, path: str, canonical: bool = False, partitions: int | None = None) -> PropertyGraph:
    """Lines ``src dst`` apart by white space; lines that start with # and blank lines are skipped. All attributes are 1.

    canonical turns every edge to src < dst; duplicates stay. Lines without two
    numbers raise, as casts do in ANSI mode.
    """
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    part = F.split(F.trim("value"), r"\s+")
    edges = lines.select(part[0].cast("long").alias("src"), part[1].cast("long").alias("dst"))
    graph = PropertyGraph.from_edge_tuples(edges)
    graph = graph.canonical() if canonical else graph
    return graph.partition_edges(partitions) if partitions else graph


def read_first_feature(spark: SparkSession, path: str) -> DataFrame:
    """id, feature (whether the first feature is 1) of lines ``id f1 f2 ...``."""
    part = F.split(F.trim("value"), " ")
    return spark.read.text(path).where("trim(value) <> ''").select(part[0].cast("long").alias("id"), (part[1].cast("int") == 1).alias("feature"))


def read_distances(spark: SparkSession, path: str) -> PropertyGraph:
    """CSV rows nameA, nameB, distance: vertices (id, name) numbered by name, edges with weight."""
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("weight", T.DoubleType())])
    rows = spark.read.csv(path, schema=schema)
    return encode(rows.select(F.col("a").alias("subject"), F.col("b").alias("object"), "weight"), "name")


def dense_ids(values: DataFrame, column: str) -> DataFrame:
    """id, column: the distinct values numbered from 0 in order.

    Values are dealt by range, counted a partition, and numbered within it, so the
    order is total without one task seeing all.
    """
    ranged = values.select(column).distinct().repartitionByRange(column).select(column, F.spark_partition_id().alias("_p"))
    ranged = cut(ranged)  # the partition numbers must not change between the two uses
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
    return ranged.withColumn("_r", inside).join(offset, "_p").select((F.col("_o") + F.col("_r")).cast("long").alias("id"), column)


def encode(triples: DataFrame, attribute: str = "value") -> PropertyGraph:
    """(subject, object, ...) rows as a graph: a dictionary of both columns' values, two joins, duplicates kept."""
    values = triples.select(F.explode(F.array("subject", "object")).alias(attribute)).where(F.col(attribute).isNotNull())
    ids = dense_ids(values, attribute)
    rest = [c for c in triples.columns if c not in ("subject", "object")]
    src, dst = ids.select(F.col("id").alias("src"), F.col(attribute).alias("subject")), ids.select(F.col("id").alias("dst"), F.col(attribute).alias("object"))
    edges = triples.join(src, "subject").join(dst, "object").select("src", "dst", *rest)
    return PropertyGraph(ids, edges)


def read_rdf(spark: SparkSession, path: str) -> PropertyGraph:
    """TSV with (ignored, subject, predicate, object): vertices (id, value), edges with predicate. Repeated triples stay."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "subject", "predicate", "object")])
    rows = spark.read.csv(path, schema=schema, sep="\t", quote="")
    return encode(rows.select("subject", "object", "predicate"))


def read_egonets(spark: SparkSession, path: str) -> DataFrame:
    """ego, src, dst of all files: lines ``src: dst dst ...``; a vertex without neighbours gets a self-loop.

    ego is the number before ``.egonet`` in the file's name, "NO MATCH" without one.
    """
    lines = spark.read.text(path).select(ego_of(F.col("_metadata.file_path")).alias("ego"), "value")
    return ego_edges(lines)


def ego_of(path) -> F.Column:
    found = F.regexp_extract(path, r"^.*?(\d+).egonet", 1)
    return F.when(found == "", "NO MATCH").otherwise(found)


def ego_edges(lines: DataFrame) -> DataFrame:
    part = F.split("value", ":")
    src = F.trim(part[0]).cast("long")
    others = F.transform(F.filter(F.split(F.coalesce(F.get(part, F.lit(1)), F.lit("")), " "), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long"))
    rows = lines.where("trim(value) <> ''").select("ego", src.alias("src"), others.alias("others"))
    return rows.select("ego", "src", F.explode(F.when(F.size("others") == 0, F.array("src")).otherwise(F.col("others"))).alias("dst"))


def word_bags(docs: DataFrame, least: int = 6, without: tuple[str, ...] = ("reuter",)) -> DataFrame:
    """doc_id, term, count: lower-cased words of at least `least` characters."""
    word = F.explode(F.split("text", " ")).alias("term")
    words = docs.select("doc_id", word).where(F.length("term") >= least).select("doc_id", F.lower("term").alias("term"))
    return words.where(~F.col("term").isin(list(without))).groupBy("doc_id", "term").agg(F.count("*").alias("count"))


def read_pixels(spark: SparkSession, path: str, shrink: int = 8) -> DataFrame:
    """id, rgb of an image: block means of shrink x shrink pixels, row by row, packed into 24 bits."""
    image = spark.read.format("image").load(path)
    side = F.struct(F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("data"))
    flat = image.select(side.alias("i")).select("i.h", "i.w", "i.c", "i.data")
    at = flat.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(h div {shrink}) * (w div {shrink}) - 1"))).alias("id"))
    at = at.select("*", F.explode(F.sequence(F.lit(0), F.lit(shrink * shrink - 1))).alias("k"))
    place = F.expr(f"((id div (w div {shrink})) * {shrink} + k div {shrink}) * w + (id % (w div {shrink})) * {shrink} + k % {shrink}")
    byte = lambda n: F.conv(F.hex(F.substring("data", (F.col("place") * F.col("c") + F.least(F.lit(n), F.col("c") - 1) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    means = at.withColumn("place", place).groupBy("id").agg(*[F.avg(byte(n)).cast("int").alias(c) for n, c in enumerate("bgr")])
    return means.select(F.col("id").cast("long"), (F.shiftleft("r", 16) + F.shiftleft("g", 8) + F.col("b")).alias("rgb"))
