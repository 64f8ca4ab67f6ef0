"""GEXF 1.2 export, submission lines and image rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph

# Red, green and blue of the classes' colours.
COLOURS = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 175, 175), (255, 0, 255), (64, 64, 64)]
# The frame of the document and the shape of its lines.
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft"%s version="1.2">\n  <graph mode="static" defaultedgetype="directed">\n    <nodes>\n'
VIZ = ' xmlns:viz="http://www.gexf.net/1.1draft/viz"'
MIDDLE, TAIL = "    </nodes>\n    <edges>\n", "    </edges>\n  </graph>\n</gexf>"


def escaped(text: Column) -> Column:
    out = text.cast("string")
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def gexf_nodes(graph: PropertyGraph, label: str) -> DataFrame:
    """id, line of every vertex."""
    return graph.vertices.select("id", F.concat(F.lit('\t<node id="'), F.col("id").cast("string"), F.lit('" label="'), F.coalesce(escaped(F.col(label)), F.lit("null")), F.lit('" />')).alias("line"))


def gexf_edges(graph: PropertyGraph, label: str) -> DataFrame:
    """src, dst, line of every edge."""
    line = F.concat(F.lit('      <edge source="'), F.col("src").cast("string"), F.lit('" target="'), F.col("dst").cast("string"), F.lit('" label="'), F.coalesce(escaped(F.col(label)), F.lit("null")), F.lit('" />'))
    return graph.edges.select("src", "dst", line.alias("line"))


def gexf_viz_nodes(graph: PropertyGraph, scale: float, class_num: str = "class_num") -> DataFrame:
    """id, line: nodes with scaled positions, and a colour where the vertex has a class (classes beyond the colours repeat them)."""
    colours = F.array(*[F.lit(f'        <viz:color r="{r}" g="{g}" b="{b}" />\n') for r, g, b in COLOURS])
    colour = F.when(F.col(class_num).isNotNull(), F.element_at(colours, (F.col(class_num) % len(COLOURS) + 1).cast("int"))).otherwise("")
    at = lambda i: (F.col("pos")[i] * scale).cast("string")
    line = F.concat(F.lit('      <node id="'), F.col("id").cast("string"), F.lit('" label="'), F.col("id").cast("string"), F.lit('">\n        <viz:position x="'), at(0), F.lit('" y="'), at(1), F.lit('" />\n'), colour, F.lit("      </node>"))
    return graph.vertices.select("id", line.alias("line"))


def gexf_lines(graph: PropertyGraph, vertex_label: str | None = None, edge_label: str = "attr", scale: float | None = None) -> DataFrame:
    """part, a, b, line in document order; with `scale` nodes carry layout and colour."""
    spark = graph.vertices.sparkSession
    nodes = gexf_viz_nodes(graph, scale) if scale is not None else gexf_nodes(graph, vertex_label or "attr")
    frame = spark.createDataFrame([(0, 0, 0, (HEAD % (VIZ if scale is not None else "")).rstrip("\n")), (2, 0, 0, MIDDLE.rstrip("\n")), (4, 0, 0, TAIL)], "part int, a long, b long, line string")
    body = nodes.select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "line")
    body = body.unionByName(gexf_edges(graph, edge_label).select(F.lit(3).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), "line"))
    return frame.unionByName(body).orderBy("part", "a", "b", "line")


def write_gexf(graph: PropertyGraph, path: str, **options) -> None:
    """One text file in a folder at `path`; the lines stay in Spark."""
    gexf_lines(graph, **options).select("line").coalesce(1).write.mode("overwrite").text(path)


def to_gexf(graph: PropertyGraph, **options) -> str:
    """The document as a string, for graphs that fit the driver."""
    return "\n".join(r.line for r in gexf_lines(graph, **options).collect())


def submission(circles: DataFrame) -> DataFrame:
    """UserId, Prediction of (ego, component, members) rows: circles apart by ;, members by blanks."""
    text = F.array_join(F.transform("members", lambda m: m.cast("string")), " ")
    rows = circles.select("ego", F.struct("component", text.alias("t")).alias("c"))
    return rows.groupBy("ego").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["t"]), ";").alias("Prediction")).select(F.col("ego").alias("UserId"), "Prediction")


def image_rows(clusters: DataFrame, width: int) -> DataFrame:
    """row, pixels: cluster ids of (id, cluster) as rows of an image, left to right."""
    return clusters.groupBy(F.expr(f"id div {width}").alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.expr(f"id % {width}").alias("x"), "cluster"))), lambda p: p["cluster"]).alias("pixels"))


def write_png(rows: DataFrame, path: str) -> None:
    """A black-and-white PNG of (row, pixels); the picture's rows come to the driver one at a time and go to the file compressed."""
    import struct
    import zlib

    size = rows.agg(F.count("*"), F.max(F.size("pixels"))).first()
    pack = zlib.compressobj()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    with open(path, "wb") as out:
        out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size[1] or 0, size[0], 8, 0, 0, 0, 0)))
        for r in rows.orderBy("row").toLocalIterator():
            out.write(chunk(b"IDAT", pack.compress(bytes([0] + [255 if p else 0 for p in r.pixels]))))
        out.write(chunk(b"IDAT", pack.flush()) + chunk(b"IEND", b""))
