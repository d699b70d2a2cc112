"""Streams: stateful duplicates, event-time windows, sessions, upserts.

Each function takes a streaming (or batch) frame and returns one; ``drain``
runs a stream over what is there now and gives its result as a frame.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def read_folder(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A stream of the parquet at ``path``: a folder of part files, or one file."""
    schema = spark.read.parquet(path).schema
    folder, name = (path, "*") if os.path.isdir(path) else os.path.split(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name if name != "*" else "*.parquet").parquet(folder)


def first_of_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text has not come before: state is a digest, not the text."""
    return df.withColumn("_h", F.md5(F.coalesce(F.col(text_col), F.lit("\x00null")))).dropDuplicates(["_h"]).drop("_h")


def window_counts(df: DataFrame, time: str = "ts", size: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Counts and sums of tumbling windows; rows later than ``late`` are left out."""
    # times without a zone are read in the session's, which is UTC
    w = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(df: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "2 hours", by: str = "user_id") -> DataFrame:
    s = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def best_rows(df: DataFrame, k: int = 3, by: str = "run_name", order: tuple[str, ...] = ("written_at", "step"), loss: str = "val_loss", step: str = "step") -> DataFrame:
    """(by, version, step, loss): the ``k`` rows of least loss of each key so
    far, given anew whenever they change, with a rising version. State is those
    rows. A row as bad as the worst of k kept ones does not come in; rows of one batch come in
    by ``order``, null last. Null losses, steps and keys are left out."""
    import pandas as pd

    def run(key, frames, state):
        version, kept = (state.get[0], list(zip(state.get[1], state.get[2]))) if state.exists else (0, [])
        rows = [r for frame in frames for r in frame[[*order, step, loss]].itertuples(index=False, name=None)]
        before = list(kept)
        for *_, at, value in sorted(rows, key=lambda r: [(pd.isna(v), 0 if pd.isna(v) else v) for v in r]):
            if len(kept) < k or value < kept[-1][1]:
                kept.append((int(at), float(value)))
                kept.sort(key=lambda x: x[1])  # stable: of equals the earlier stays in front
                del kept[k:]
        if kept != before:
            version += 1
        state.update((version, [a for a, _ in kept], [v for _, v in kept]))
        yield pd.DataFrame({by: key[0], "version": version, step: [a for a, _ in kept], loss: [v for _, v in kept]})

    known = df.filter(F.col(loss).isNotNull() & F.col(step).isNotNull() & F.col(by).isNotNull())
    return known.groupBy(by).applyInPandasWithState(run, f"{by} string, version long, {step} long, {loss} double", "version long, steps array<long>, losses array<double>", "update", "NoTimeout")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives over its present input, from parquet in the shared
    folder (``complete`` results: the last batch; ``update``: every batch)."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    if mode == "update":

        def add(batch: DataFrame, number: int) -> None:
            # by the batch's number, so that one that runs again is there once
            batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

        stream.writeStream.outputMode(mode).foreachBatch(add).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    elif mode == "append":
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    else:

        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out")

        stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{base}/out")


def upserted(stream: DataFrame, keys: list[str], written: str, metrics: tuple[str, ...]) -> DataFrame:
    """The upsert of metric rows as a running aggregate: one state a key."""
    last = [F.max(F.when(F.col(m).isNotNull(), F.struct(F.col(written), F.col(m))))[m].alias(m) for m in metrics]
    return stream.groupBy(*keys).agg(*last)
