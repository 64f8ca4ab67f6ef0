"""The corpus pipeline: from raw documents to a mix, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs. All but the last return the columns of
`documents`; the last adds size, target and taken. An empty table passes through.
Stages judge rows by their texts, so null ids stay rows of their own; columns
beside doc_id, text, source and n_chars pass through unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.anchors import id_of, identified
from vertexloom.llm.common import Stage
from vertexloom.llm.decontamination import without_leaks
from vertexloom.llm.mixing import mixed
from vertexloom.llm.ngram_join import grouped
from vertexloom.llm.quality import without_low
from vertexloom.llm.secrets import redact

#: A document below this score is rejected.
LEAST_QUALITY = 0.3
#: Near duplicates: shingles of so many words, linked at this percentage of their union.
SHINGLE, PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject; null and empty texts are judged by their zero features."""
    return without_low(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), LEAST_QUALITY)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Null ids count as the smallest, each text as a document of its own. Of equal
    rows one stays; null and empty texts are in no group.
    """
    rows = identified(docs)
    first = grouped(rows, PERCENT, SHINGLE).where("_id = _component").select(F.col("_id").alias("_f")).distinct()
    first = Stage(spark, "firsts").write(first, "ids")
    named = docs.select(F.struct(*docs.columns).alias("_d"), id_of(), F.xxhash64("text").alias("_h"))
    kept = named.join(first.hint("shuffle_hash"), F.col("_id") == F.col("_f"), "left_semi").dropDuplicates(["_id", "_h"])
    return kept.select(*[F.col("_d").getField(c).alias(c) for c in docs.columns])


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; null and empty texts hold none."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live secrets replaced in the texts they were found in."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words from, with size, target (of the source) and taken; null and empty texts have none."""
    return mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", keep_clean),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
]

#: SQL does not express a fitted classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    stage, docs = Stage(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage.write(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
