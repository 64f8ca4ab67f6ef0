"""Cutting the lineage of loops at reliable checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, one of our own on a local master, whose executors are threads
    of one process; on a cluster no folder of the driver can stand for it.
    """
    context = spark.sparkContext
    held = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if held:
        return held
    if re.fullmatch(r"local(\[[^\]]*\])?", context.master) is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="vertexloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint: the plan stops growing, and lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def without_estimate(df: DataFrame) -> DataFrame:
    """A cut's rows without its size estimate.

    A checkpoint keeps the estimate of its plan, a product over joins. A loop that
    joins its state with itself multiplies the digits of that number each round,
    and after some 20 rounds planning does not end.
    """
    spark, plan = df.sparkSession, df._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.queryExecution().toRdd(), plan.schema(), False), spark)


def fingerprint(df: DataFrame, *columns: str) -> tuple[int, int]:
    """Number of rows and an order-free hash, for telling whether a round changed anything."""
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("h")).first()
    return row.n, row.h or 0
