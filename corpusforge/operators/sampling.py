"""Seeded samples, budgets, splits and weights.

An order is the MD5 of seed and id: the same on every cluster and in SQL.
Counts per group come from an aggregate; ranks are needed only inside a group,
and a global rank is taken in two steps (ranges first, then inside each range)
so that no task sees all rows. The number of ranges follows that of the input's
partitions.
"""

from __future__ import annotations

from hashlib import sha256
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import partitions, shuffle_partitions


def order_key(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def take(df: DataFrame, n: int, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """``n`` rows in the seeded order: a top-k on each task, then one merge."""
    return df.orderBy(order_key(id_col, seed), id_col).limit(n)


def ranked(df: DataFrame, by: list[str] | None, id_col: str, seed: int = 42, name: str = "rn", digits: int | None = None) -> DataFrame:
    """``df`` with the rank of each row in the seeded order, inside ``by`` or over all.

    The first hex digits of the key cut the rows into ranges, two digits or as
    many more as give four ranges for each partition of the input, so a group
    that holds most rows is still spread, whatever its size; the number of rows
    in the earlier ranges is added from a small table.
    """
    by = by or []
    if digits is None:
        digits = max(2, ceil(log(4 * max(1, partitions(df, shuffle_partitions(df.sparkSession))), 16)))
    keyed = df.withColumn("_k", order_key(id_col, seed)).withColumn("_b", F.substring("_k", 1, digits))
    sizes = keyed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row a group and range
    offsets = sizes.withColumn("_before", before).drop("_n")
    cond = None
    for c in [*by, "_b"]:
        e = keyed[c].eqNullSafe(offsets[c])
        cond = e if cond is None else cond & e
    joined = keyed.join(offsets, cond).select(keyed["*"], "_before")
    w = Window.partitionBy(*by, "_b").orderBy("_k", id_col)
    return joined.withColumn(name, F.row_number().over(w) + F.col("_before")).drop("_k", "_b", "_before")


# Characters a token, oversampling, and usual lengths by source.
CHARS_PER_TOKEN, OVERSAMPLE = 4.0, 1.10
AVERAGE_CHARS = {"openwebtext": 2000, "fineweb": 2500, "fineweb_edu": 2500, "c4": 2000, "wikipedia": 8000, "bookcorpus": 5000}


def document_estimate(plans: DataFrame, name: str = "name", tokens: str = "target_tokens") -> DataFrame:
    """``plans`` with ``n_docs``, the documents to read for a token target."""
    table = F.create_map(*[F.lit(x) for kv in AVERAGE_CHARS.items() for x in kv])
    avg = F.coalesce(F.try_element_at(table, F.col(name)), F.lit(2000))
    return plans.withColumn("n_docs", F.greatest(F.lit(1), F.floor(F.col(tokens) * CHARS_PER_TOKEN * OVERSAMPLE / avg)).cast("long"))


def allocate(configs: DataFrame, total_tokens: int) -> DataFrame:
    """``configs`` with ``target_tokens``: the whole tokens of each ratio."""
    return configs.withColumn("target_tokens", F.floor(F.col("ratio") * total_tokens).cast("long"))


def split_corpus(df: DataFrame, id_col: str = "doc_id", fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the last max(1, fraction of all) rows of the order are val."""
    n = df.agg(F.count(F.lit(1)).alias("_total"))
    val = F.greatest(F.lit(1), F.floor(F.col("_total") * fraction))
    r = ranked(df, None, id_col, seed).crossJoin(F.broadcast(n))  # one row
    return r.withColumn("split", F.when(F.col("rn") > F.col("_total") - val, "val").otherwise("train")).drop("rn", "_total")


def split_groups(df: DataFrame, by: str = "source", id_col: str = "row_id", fraction: float = 0.05, seed: int = 42, clamp: bool = True) -> DataFrame:
    """``df`` with ``split``: in each group the first max(1, fraction) rows are
    val, all but one at most (``clamp``); none where the fraction is 0."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_total"))
    val = F.greatest(F.lit(1), F.floor(F.col("_total") * fraction))
    if clamp:
        val = F.when(F.col("_total") > 1, F.least(val, F.col("_total") - 1)).otherwise(val)
    if fraction <= 0:
        val = F.lit(0)
    r = ranked(df, [by], id_col, seed)
    sizes = sizes.withColumnRenamed(by, "_by")
    return r.join(sizes, r[by].eqNullSafe(sizes["_by"])).withColumn("split", F.when(F.col("rn") <= val, "val").otherwise("train")).drop("rn", "_total", "_by")


def split_pooled(df: DataFrame, id_col: str = "row_id", fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the first max(1, fraction of all) rows of the order
    are val, whatever their groups; one row alone is val."""
    n = df.agg(F.count(F.lit(1)).alias("_total"))
    r = ranked(df, None, id_col, seed).crossJoin(F.broadcast(n))  # one row
    return r.withColumn("split", F.when(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("_total") * fraction)), "val").otherwise("train")).drop("rn", "_total")


def take_each(df: DataFrame, budgets: DataFrame, by: str = "source", id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """The first rows of each group of ``df`` in the seeded order, as many as
    ``budgets`` (``by``, n_docs) says; groups without a budget are left out."""
    r = ranked(df, [by], id_col, seed)
    return r.join(budgets.select(by, F.col("n_docs").alias("_n")), by).filter("rn <= _n").drop("rn", "_n")


def check_weights(weights: dict[str, float], known: set[str]) -> None:
    for name, w in weights.items():
        if name not in known:
            raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted(known))}")
        if not (w > 0 and w < float("inf")):
            raise ValueError(f"weight of {name!r} must be finite and above 0, not {w}")


def weight_copies(df: DataFrame, weights: dict[str, float], by: str = "source", id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """Each group at ``weights`` times its size: whole copies of all rows and
    one more of the first rows of the order; (``df``.*, copy from 1). A group
    without a weight has 1. The target is rounded half to even, 1 at least."""
    check_weights(weights, set(weights))
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(by, "_by")
    r = ranked(df, [by], id_col, seed)
    j = r.join(sizes, r[by].eqNullSafe(sizes["_by"]))
    target = F.greatest(F.lit(1), F.bround(F.col("_n") * F.coalesce(F.try_element_at(table, F.col(by)), F.lit(1.0)))).cast("long")
    copies = (F.floor(target / F.col("_n")) + (F.col("rn") <= target % F.col("_n")).cast("long")).cast("int")
    return j.withColumn("_c", copies).filter("_c > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_c")))).drop("_c", "_n", "_by", "rn")


def cap(df: DataFrame, n: int, by: str = "source", id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """The first ``n`` rows of each group in the seeded order. A limit on the
    rank of a group is applied on each task before the shuffle."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(order_key(id_col, seed), id_col))
    return df.withColumn("_rn", k).filter(F.col("_rn") <= n).drop("_rn")


def probe_windows(spark: SparkSession, n: int, total: Column, source: DataFrame, length: int, seed: int = 42) -> DataFrame:
    """(k, start): ``n`` seeded starts of windows of ``length`` in a stream whose
    size is the one row of ``source``; none where the stream is shorter."""
    room = total - length - 1
    pick = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long")
    sized = spark.range(n).withColumnRenamed("id", "k").crossJoin(F.broadcast(source))  # one row
    return sized.filter(room > 0).select("k", (pick % room).alias("start"))


def batches(df: DataFrame, size: int, id_col: str, seed: int = 42, drop_last: bool = True) -> DataFrame:
    """``df`` with ``batch_id`` in the seeded order; the last short one is left out on wish."""
    n = df.agg(F.count(F.lit(1)).alias("_total"))
    r = ranked(df, None, id_col, seed).withColumn("batch_id", F.floor((F.col("rn") - 1) / size))
    if drop_last:
        r = r.crossJoin(F.broadcast(n)).filter((F.col("batch_id") + 1) * size <= F.col("_total")).drop("_total")  # one row
    return r.drop("rn")


def cache_key(weights: dict[str, float], names: list[str], length: int, limit: int | None, filtered: bool) -> str:
    """A short digest of everything that shapes a cached set."""
    parts = [",".join(sorted(names)), ",".join(f"{k}={weights[k]:.12g}" for k in sorted(weights)), str(length), str(limit), str(filtered)]
    return sha256("|".join(parts).encode()).hexdigest()[:16]
