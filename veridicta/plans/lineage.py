"""Cutting lineage in the shared folder, and order without a window over everything."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridicta.functions.expressions import free


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only a local session without one gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="veridicta-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame, *columns: Column) -> DataFrame:
    """Adds the columns by way of a generator.  Spark takes a filter on a computed column down to what it is made of, and
    so computes that again, once for each place that names it; a generator's columns it leaves where they are."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def kept(df: DataFrame, condition: Column) -> DataFrame:
    """``where`` for a condition on computed columns, which are then computed once a row."""
    (name,) = free(df.columns, "kept")
    return settled(df, condition.alias(name)).where(name).drop(name)


def in_ranges(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` dealt by ranges of ``order``, sorted, with the range's number as ``name``; a range is a partition, and stays
    one when it is read again."""
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(name, F.spark_partition_id()))


def sums_before(df: DataFrame, weight: str, name: str, *order: str) -> DataFrame:
    """Adds the sum of ``weight`` over all rows before in ``order``.  Sums within ranges; the driver adds up one number a
    range.  Rows of equal ``order`` must be told apart by more of it."""
    (at,) = free(df.columns, "range")
    ranged = in_ranges(df, at, *order)
    start, total = [0] * (max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1), 0
    for k, n in sorted(ranged.groupBy(at).agg(F.sum(weight)).collect()):
        start[k], total = total, total + n
    within = F.sum(weight).over(W.partitionBy(at).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return ranged.withColumn(name, F.element_at(F.lit(start), F.col(at) + 1) + F.coalesce(within, F.lit(0))).drop(at)
