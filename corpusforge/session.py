"""Session construction and settings shared by all jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with the engine's settings; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName("corpusforge")
    for key, value in (SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)}).items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only where
    none is configured and the master is local, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
    path = configured or os.path.join(tempfile.gettempdir(), "corpusforge-checkpoints")
    spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder: cuts the lineage as a
    checkpoint does, in compressed columns."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
