"""Partitioning helpers shared by the query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, min_tasks: int | None = None) -> DataFrame:
    """Round-robin a CPU-heavy narrow stage over the cores when the scan is too coarse.

    A scan of big files already yields one task per split (``maxPartitionBytes``),
    and then this is a no-op: no shuffle is added at scale. A scan of one small
    file yields a single task, and a per-row text job would then run on one
    core; only in that case the rows are dealt out to ``min_tasks`` tasks
    (default: the cluster's default parallelism).
    """
    spark = df.sparkSession
    want = min_tasks or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)
