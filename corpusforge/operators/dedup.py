"""Exact, cross-source and near-duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_words
from ..session import checkpoint_dir


def exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of their text's.

    Digests and ids are grouped, partially before the shuffle, so a text that a
    third of all rows share costs one row a task. Of the texts that stand more
    than once the later ids are then taken out of ``df``: where those are few,
    adaptive execution broadcasts them and no text moves. Null texts are one
    group of their own; rows with a null id stay.
    """
    keyed = df.select(F.col(id_col).alias("_id"), F.md5(F.coalesce(F.col(text_col), F.lit("\x00null"))).alias("_h"))
    repeated = keyed.groupBy("_h").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h", "_first")
    later = keyed.join(repeated, "_h").filter("_id > _first").select(F.col("_id").alias(id_col))
    return df.join(later, id_col, "left_anti")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text_md5, n, first_id) of the texts that stand more than once."""
    return df.groupBy(F.md5(text_col).alias("text_md5")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).filter("n > 1")


def flags(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, duplicated, first): whether a row's text stands more than once, and
    the smallest id with it, for every row of ``df``; null texts are equal. Digests are
    counted before the shuffle; only the repeated ones are joined back."""
    keyed = df.select(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("\x00null"))).alias("_h"))
    repeated = keyed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.min(id_col).alias("_first")).filter("_n > 1").select("_h", "_first")
    return keyed.join(repeated, "_h", "left").select(id_col, F.col("_first").isNotNull().alias("duplicated"), F.coalesce("_first", id_col).alias("first"))


def cross_source(df: DataFrame, priority: Sequence[str], source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Without rows whose text stands in a source of higher priority.

    Sources not named come after those named, in order of their name; null
    last. Copies inside the winning source stay. Only (digest, rank) of the
    digests that several sources share is joined.
    """
    known = F.array_position(F.array(*[F.lit(p) for p in priority]), F.coalesce(F.col(source_col), F.lit("")))
    rank = F.when(known > 0, F.format_string("0%06d", known)).when(F.col(source_col).isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col(source_col)))
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("\x00null")))
    ranked = df.withColumns({"_h": digest, "_rank": rank})
    best = ranked.groupBy("_h").agg(F.min("_rank").alias("_best"), F.max("_rank").alias("_worst")).filter("_best < _worst").select("_h", "_best")
    return ranked.join(best, "_h", "left").filter("_best is null or _rank = _best").drop("_h", "_rank", "_best")


def greedy_gone(members: DataFrame) -> DataFrame:
    """(id) of the rows that go when, in order of the id, a row goes that shares
    a band with one that stayed. ``members`` (id, band, key) has the rows of each
    band.

    In each round a band's rows are compared with its smallest id that is not
    yet gone: a row that is the smallest in all its bands stays, and the other
    rows of these bands go, from their other bands too. The smallest id of all
    that are open stays in every round, so the rounds end.
    """
    checkpoint_dir(members.sparkSession)
    open_ = members.distinct().checkpoint()
    gone = open_.select("id").limit(0)
    while not open_.isEmpty():
        led = open_.join(open_.groupBy("band", "key").agg(F.min("id").alias("low")), ["band", "key"])
        stays = led.groupBy("id").agg(F.max(F.col("low") < F.col("id")).alias("behind")).filter("not behind").select(F.col("id").alias("low"), F.lit(True).alias("stays"))
        led = led.join(stays, "low", "left").checkpoint()
        sure = led.filter("stays and id > low").select("id").distinct().checkpoint()
        gone = gone.union(sure).checkpoint()
        open_ = led.filter("stays is null").join(sure, "id", "left_anti").select("id", "band", "key").checkpoint()
    return gone


def minhash_keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, rows: int = 13, bands: int = 9, greedy: bool = True) -> DataFrame:
    """(id, kept): whether a row stays under sequential near-duplicate removal.

    Bands of minimum hashes over lower-case runs of five words; in order of
    the id a row goes when it shares a band with a row that stayed. Texts under
    five words stay. Rows of one band are never linked to each other;
    ``greedy`` follows the order by rounds (``greedy_gone``), else a row goes as
    soon as any smaller id shares a band.
    """
    rng = np.random.default_rng(13)
    factors = rng.integers(1, 1 << 62, rows * bands, dtype=np.uint64) | np.uint64(1)
    terms = rng.integers(1, 1 << 62, rows * bands, dtype=np.uint64)

    @F.pandas_udf("array<bigint>")
    def keys(hashed: pd.Series) -> pd.Series:
        out = []
        for one in hashed:
            x = np.asarray(one, np.int64).view(np.uint64)
            least = np.full(rows * bands, np.iinfo(np.uint64).max, np.uint64)
            for start in range(0, len(x), 2048):
                np.minimum(least, (x[start : start + 2048, None] * factors + terms).min(0), out=least)
            mixed = np.zeros(bands, np.uint64)
            for r in range(rows):
                mixed = (mixed ^ least[r::rows]) * np.uint64(0x9E3779B97F4A7C15)
            out.append(mixed.view(np.int64))
        return pd.Series(out, index=hashed.index)

    # the word array is bound once as a lambda variable, else it is computed per position
    shingles = F.flatten(F.transform(F.array(split_words(text_col)), lambda w: F.when(F.size(w) >= shingle, F.transform(F.sequence(F.lit(1), F.size(w) - shingle + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, shingle), " ")))).otherwise(F.array().cast("array<bigint>"))))
    hashed = df.select(F.col(id_col).alias("id"), F.array_distinct(shingles).alias("s"))
    banded = hashed.filter(F.col("id").isNotNull() & (F.size("s") > 0)).select("id", F.posexplode(keys("s")).alias("band", "key"))
    # read twice, so the texts are hashed once
    checkpoint_dir(df.sparkSession)
    banded = banded.checkpoint()
    shared = banded.groupBy("band", "key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    linked = banded.join(shared, ["band", "key"])
    gone = greedy_gone(linked.select("id", "band", "key")) if greedy else linked.filter("id > low").select("id").distinct()
    return df.select(F.col(id_col).alias("id")).join(gone.withColumn("_gone", F.lit(True)), "id", "left").select(F.col("id").alias(id_col), F.col("_gone").isNull().alias("kept"))
