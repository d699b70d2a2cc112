"""Readers of the project's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``<directory>/<name>.parquet``, a file or a folder of part files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """``df`` in at least ``per_core`` partitions a core.

    An input that already has as many scan partitions is returned as it is, so
    that large tables are never shuffled for it; so is a plan with an exchange
    of its own, whose stages would run only to be counted.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism * per_core
    if partitions(df, wanted) >= wanted:
        return df
    return df.repartition(wanted)


def partitions(df: DataFrame, unknown: int) -> int:
    """Number of scan partitions of ``df``; ``unknown`` where its plan has an
    exchange, which would run only to be counted."""

    def shuffled(node) -> bool:
        # an adaptive plan is one with exchanges
        if node.nodeName() in ("AdaptiveSparkPlan", "Exchange", "BroadcastExchange"):
            return True
        children = node.children()
        return any(shuffled(children.apply(k)) for k in range(children.size()))

    return unknown if shuffled(df._jdf.queryExecution().executedPlan()) else df.rdd.getNumPartitions()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
