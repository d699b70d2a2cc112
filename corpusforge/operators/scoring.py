"""Evaluation and preference metrics over logged scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nucleus(df: DataFrame, by: str, item: str, logit: str, p: float) -> DataFrame:
    """(by, item, prob): the items of each group kept by top-p: in order of
    falling logit an item goes when the mass before it is above ``p``; the first
    stays. Of ties the smaller item is first."""
    top = F.max(logit).over(Window.partitionBy(by))
    e = df.withColumn("_e", F.exp(F.col(logit) - top))
    prob = e.withColumn("prob", F.col("_e") / F.sum("_e").over(Window.partitionBy(by)))
    before = F.sum("prob").over(Window.partitionBy(by).orderBy(F.desc(logit), item).rowsBetween(Window.unboundedPreceding, -1))
    return prob.withColumn("_before", F.coalesce(before, F.lit(0.0))).filter(F.col("_before") <= p).select(by, item, "prob")


def top_k(df: DataFrame, by: str, score: str, k: int) -> DataFrame:
    """The rows of the k greatest scores of each group; ties with the k-th stay."""
    return df.withColumn("_r", F.rank().over(Window.partitionBy(by).orderBy(F.desc(score)))).filter(F.col("_r") <= k).drop("_r")


def choose(df: DataFrame, by: str, choice: str, score: str) -> DataFrame:
    """(by, choice): the choice of greatest score, the first on ties; null and
    minus infinity lose to any number."""
    return df.groupBy(by).agg(F.max(F.struct(F.coalesce(score, F.lit(float("-inf"))), -F.col(choice)))["col2"].alias("_c")).select(by, (-F.col("_c")).alias(choice))


def choose_allowed(df: DataFrame, by: str, item: str, score: str, allowed: Sequence[int]) -> DataFrame:
    """(by, item): ``choose`` among the items allowed; among all, where none is
    allowed, or all that are have minus infinity or null."""
    ok = F.col(item).isin(*allowed) & F.col(score).isNotNull() & (F.col(score) > float("-inf")) if allowed else F.lit(False)
    key = F.struct(ok.alias("ok"), F.coalesce(score, F.lit(float("-inf"))).alias("s"), (-F.col(item)).alias("i"))
    return df.groupBy(by).agg(F.max(key)["i"].alias("_c")).select(by, (-F.col("_c")).alias(item))


def mean_score(df: DataFrame, keys: list[str], logp: str) -> DataFrame:
    """Mean token log-probability of each choice; minus infinity for an empty span."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(logp), F.lit(float("-inf"))).alias("score"))


def windows(df: DataFrame, id_col: str, n_col: str, context: int, stride: int) -> DataFrame:
    """(id, start, end, score_from, n_scored): the sliding windows of a text of
    n tokens. A window after the first scores from ``stride`` on in it, so tokens
    are scored once only where the stride is half the context."""
    w = df.filter(F.col(n_col) > 1).withColumn("start", F.explode(F.sequence(F.lit(0), F.col(n_col) - 2, F.lit(stride))))
    end = F.least(F.col("start") + context, F.col(n_col) - 1)
    return w.withColumn("end", end).withColumn("score_from", F.when(F.col("start") == 0, 0).otherwise(F.col("start") + stride)).select(id_col, "start", "end", "score_from", F.greatest(F.lit(0), F.col("end") - F.col("score_from")).alias("n_scored"))


def sequence_logprob(logps: str, labels: str, mean: bool = False, ignored: int = -100) -> Column:
    """Sum, or mean, of the log-probabilities whose label is not ignored; labels
    are shifted by one."""
    shifted = F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))
    pairs = F.filter(F.arrays_zip(F.col(logps).alias("p"), shifted.alias("l")), lambda x: x["p"].isNotNull() & (x["l"] != ignored))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["p"])
    return total / F.greatest(F.size(pairs), F.lit(1)) if mean else total


def preference(df: DataFrame, beta: float = 0.1, smoothing: float = 0.0, kind: str = "sigmoid", reference_free: bool = False) -> DataFrame:
    """``df`` (pi_c, pi_r, ref_c, ref_r) with advantage, rewards, margin and loss."""
    rc, rr = (F.lit(0.0), F.lit(0.0)) if reference_free else (F.col("ref_c"), F.col("ref_r"))
    a = (F.col("pi_c") - F.col("pi_r")) - (rc - rr)
    x = beta * a

    def soft(v: Column) -> Column:
        # log(1 + exp(-v)) without overflow
        return F.greatest(-v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))

    loss = F.pow(a - 1 / (2 * beta), F.lit(2.0)) if kind == "ipo" else (1 - smoothing) * soft(x) + smoothing * soft(-x)
    return df.withColumns({"advantage": a, "reward_c": beta * (F.col("pi_c") - rc), "reward_r": beta * (F.col("pi_r") - rr), "loss": loss}).withColumn("margin", F.col("reward_c") - F.col("reward_r"))


def penalise(logit: Column, seen: Column, penalty: float) -> Column:
    """A seen item's logit, times the penalty below 0 and divided by it above."""
    return F.when(seen & (logit < 0), logit * penalty).when(seen, logit / penalty).otherwise(logit)
