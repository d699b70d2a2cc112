"""Mixing sources to target weights (problem 8).

Tokens are summed per source; a source's rate is its budget over its tokens,
at most its cap on repetition; each document comes floor(rate) times, and once
more with the probability of the fraction, decided by a seeded hash of its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import source_key
from .tokens import source_totals


def rates(counts: DataFrame, configs: DataFrame, plans: DataFrame) -> DataFrame:
    """(source, n_documents, tokens, target_tokens, max_repeats, rate, reachable)
    of each config; ``counts`` has doc_id, n_tokens and key, the ``source_key``.

    The budget is the sum of ``plans.target_tokens``; a source's target is that
    of its plan, else its ``ratio`` of the budget. A source without tokens has
    rate 0. Null ``max_repeats`` is 1.
    """
    budget = plans.agg(F.coalesce(F.sum("target_tokens"), F.lit(0)).alias("budget"))
    goal = plans.groupBy(source_key("name").alias("plan_key")).agg(F.sum("target_tokens").alias("planned"))
    totals = source_totals(counts, configs)
    return (
        configs.select(F.col("name").alias("source"), "ratio", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
        .join(totals, "source")
        .join(goal, source_key("source") == F.col("plan_key"), "left")
        .crossJoin(F.broadcast(budget))  # one row
        .withColumn("target_tokens", F.coalesce("planned", F.round(F.col("ratio") * F.col("budget")).cast("long"), F.lit(0)))
        .select(
            "source",
            "n_documents",
            "tokens",
            "target_tokens",
            "max_repeats",
            F.when(F.col("tokens") > 0, F.least(F.col("target_tokens") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0).alias("rate"),
            (F.col("tokens") * F.col("max_repeats") >= F.col("target_tokens")).alias("reachable"),
        )
    )


def copies(counts: DataFrame, rated: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, n_copies): every document of a rated source
    with the number of times it is used, 0 included.

    ``floor(rate)`` and one more when a hash of seed and id, as a number in
    [0, 1), is below the fraction; never above ``max_repeats``.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    few = rated.select("source", source_key("source").alias("key"), "rate", "max_repeats")
    return (
        counts.filter("key is not null")
        .join(few, "key")
        .withColumn("n_copies", F.least(F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int"), F.col("max_repeats")).cast("int"))
        .select("doc_id", "source", "n_tokens", "n_copies")
    )


def mix(used: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, copy): one row a copy, numbered from 1."""
    return used.filter("n_copies > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))


def shares(used: DataFrame, rated: DataFrame, configs: DataFrame) -> DataFrame:
    """(source, ratio, target_tokens, mixed_tokens, share): the shares really
    reached, of all mixed tokens; a source without documents has 0."""
    got = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("mixed_tokens"))
    total = got.agg(F.sum("mixed_tokens").alias("total"))
    return (
        rated.select("source", "target_tokens")
        .join(configs.select(F.col("name").alias("source"), "ratio"), "source")
        .join(got, "source", "left")
        .crossJoin(F.broadcast(total))  # one row
        .select("source", "ratio", "target_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce(F.col("mixed_tokens") / F.col("total"), F.lit(0.0)).alias("share"))
    )
