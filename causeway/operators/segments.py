"""Running numbers over groups of any size: a group that holds most rows is dealt to many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores, if all that it scans is too little for Spark to make a task a core of it; else as it is.

    Files are cut to pieces of no less than the bytes that opening one costs, so a table below those bytes a core comes in few
    tasks, however much work a row is. The shuffle is bounded by them too; only the plan's estimates are read.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    scanned = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores) if scanned < cores * spark._jsparkSession.sessionState().conf().filesOpenCostInBytes() else df


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, the place (from 0) of each row among those of its ``keys`` in ``order``, which must be total.

    The rows are dealt by ranges of (keys, order), so a key with most rows has many blocks; numbers run within a block,
    and the blocks' counts, a row a block and key, are summed up to where each block begins. Null keys are a group.
    """
    placed = written(df.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()), "blocks")
    sizes = placed.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*keys, "_block").orderBy(*order)
    found = placed.join(begins, same).withColumn(name, F.col("_begin") + F.row_number().over(within) - 1)
    return found.select(*df.columns, name)
