"""Metric series: upsert by step, running values, summaries, schedules."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(df: DataFrame, keys: list[str], written: str, metrics: Sequence[str]) -> DataFrame:
    """One row a key: of each metric the value written last that is not null;
    of values written at one time the greatest. Partial maxima go before the
    shuffle, so a run that holds most rows is cut down on every task."""
    last = [F.max(F.when(F.col(m).isNotNull(), F.struct(F.col(written), F.col(m))))[m].alias(m) for m in metrics]
    return df.groupBy(*keys).agg(*last)


def running(df: DataFrame, by: str, order: str, value: str, kind: str, name: str, width: int = 4096) -> DataFrame:
    """``df`` with the running min or sum of ``value`` in ``order`` inside ``by``.

    In two steps, so that one long series is not one task: inside blocks of
    ``width`` of the integer ``order``, then with the blocks before (a frame of
    one row a block).
    """
    agg = {"min": F.min, "sum": F.sum}[kind]
    b = df.withColumn("_b", F.floor(F.col(order) / width))
    blocks = b.groupBy(by, "_b").agg(agg(value).alias("_v"))
    before = blocks.withColumn("_before", agg("_v").over(Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_v")
    j = b.join(before, [by, "_b"])
    inside = agg(value).over(Window.partitionBy(by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    total = F.least(inside, "_before") if kind == "min" else inside + F.coalesce("_before", F.lit(0))
    return j.withColumn(name, total).drop("_b", "_before")


def summarise(steps: DataFrame) -> DataFrame:
    """(run_name, last_step, best_val, best_step, n_steps) of upserted steps."""
    best = F.min(F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", "step")))
    return steps.groupBy("run_name").agg(F.max("step").alias("last_step"), best["val_loss"].alias("best_val"), best["step"].alias("best_step"), F.count(F.lit(1)).alias("n_steps"))


def _half_cosine(step: Column, begin: int, length: int, low: float) -> Column:
    """From 1 to ``low`` along half a cosine of ``length`` steps from ``begin`` on."""
    part = F.least(F.lit(1.0), (step - begin) / float(max(1, length)))
    return low + (1 - low) * 0.5 * (1 + F.cos(math.pi * part))


def cosine(step: Column, top: float, low: float, warm: int, total: int) -> Column:
    """Learning rate: from 0 linearly to ``top`` in ``warm`` steps, then half a
    cosine to ``low`` of it at ``total``."""
    return top * F.when(step < warm, step / float(max(1, warm))).otherwise(_half_cosine(step, warm, total - warm, low))


def warm_stable_decay(step: Column, top: float, low: float, warm: int, total: int, decay: float) -> Column:
    """Learning rate: warm-up, ``top``, and in the last ``decay`` of the steps half a cosine to ``low`` of it."""
    falling = int(total * decay)
    return top * F.when(step < warm, step / float(max(1, warm))).when(step < total - falling, F.lit(1.0)).otherwise(_half_cosine(step, total - falling, falling, low))


def parameter_count(shapes: DataFrame, vocabulary: int = 50_257) -> DataFrame:
    """``shapes`` (d_model, n_layers, d_ff, activation) with ``n_params`` of a
    decoder whose output shares the embedding: a gated unit (swiglu) has three
    matrices in its forward layer, any other two; two norms a block, one at the end."""
    h, f = F.col("d_model"), F.col("d_ff")
    block = 4 * h * h + F.when(F.col("activation") == "swiglu", 3).otherwise(2) * h * f + 2 * h
    return shapes.withColumn("n_params", (vocabulary * h + F.col("n_layers") * block + h).cast("long"))


def sweep(checkpoints: DataFrame, betas: Sequence[float], epochs: Sequence[int]) -> DataFrame:
    """(name, checkpoint, beta, epochs): every setting of every row of
    ``checkpoints`` (place from 1, checkpoint), as explosions of its rows."""
    out = checkpoints.withColumn("beta", F.explode(F.array(*[F.lit(b) for b in betas]))).withColumn("epochs", F.explode(F.array(*[F.lit(e) for e in epochs])))
    return out.select(F.concat(F.lit("sft"), "place", F.lit("_b"), F.col("beta").cast("string"), F.lit("_e"), "epochs").alias("name"), "checkpoint", "beta", "epochs")


def best_per_group(runs: DataFrame, by: str, name: str, loss: str, other: str) -> DataFrame:
    """(by, name, by_loss): of each group the run of least ``loss``; where none
    has one, that of greatest ``other``. Null where neither is there."""
    least = F.min(F.when(F.col(loss).isNotNull(), F.struct(F.col(loss), F.col(name))))
    most = F.max(F.when(F.col(other).isNotNull(), F.struct(F.col(other), F.col(name))))
    return runs.groupBy(by).agg(F.coalesce(least[name], most[name]).alias(name), (F.count(loss) > 0).alias("by_loss"))


def improvement(runs: DataFrame, loss: str = "best_val") -> DataFrame:
    """``runs`` with ``gain_pct``, how far below the worst loss each is, in percent of it."""
    worst = runs.agg(F.max(loss).alias("_worst"))
    return runs.crossJoin(F.broadcast(worst)).withColumn("gain_pct", F.lit(100.0) * (F.col("_worst") - F.col(loss)) / F.col("_worst")).drop("_worst")  # one row
