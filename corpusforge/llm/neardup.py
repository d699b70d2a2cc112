"""Near-duplicate records with small edits (problem 4).

Covering locality-sensitive hashing. A text's set of word shingles becomes a
vector of lanes, each the least value of one hash function over the set, so
that the lanes in which two texts differ number about (1 - similarity) of all.
The lanes are cut into parts of six; in each part every lane has its own code,
a nonzero vector of three bits, and each nonzero mask of three bits keeps the
lanes whose code has an odd product with it. Two vectors that differ in at most
two lanes of a part agree on all lanes of at least one of its seven masks,
whichever lanes those are: the codes of two lanes leave a nonzero mask
orthogonal to both. So every pair within the radius of some part collides in
some table. That a pair exceeds the radius in all of ``PARTS`` parts at once
has the probability 9e-4 at similarity 0.6, 5e-6 at 0.7 and 1e-9 at 0.8.

Candidates are compared by their lanes, where five deviations below the
expected agreement are let through (at most 2e-5 of the true pairs are not),
and then exactly, on the full sets of shingles. Equal texts are folded into one
representative first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.tables import spread
from .common import slices, words

#: Parts of six lanes; seven masks each.
PARTS = 9
LANES = 6 * PARTS
#: Codes of a part's lanes; the seventh nonzero vector stays unused.
CODES = (1, 2, 3, 4, 5, 6)
MASKS = [[k for k, code in enumerate(CODES) if bin(code & mask).count("1") % 2] for mask in range(1, 8)]

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(1, 1 << 63, n, dtype=np.uint64)


def shingle_hashes(found: list[str], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words."""
    if len(found) < size:
        return np.empty(0, np.uint64)
    one = np.fromiter((xxhash.xxh64_intdigest(w) for w in found), np.uint64, len(found))
    n = len(found) - size + 1
    mixed = one[:n].copy()
    for k in range(1, size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _PRIME + one[k : k + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _PRIME
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def lanes(hashes: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, as 32 bits."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 4096):
        block = hashes[start : start + 4096, None] * factors
        block += terms
        np.minimum(least, block.min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def keys(vectors: np.ndarray) -> np.ndarray:
    """(texts, tables): the lanes that each mask keeps, hashed with the table's
    number; ``vectors`` is (texts, lanes)."""
    out = np.empty((len(vectors), PARTS * len(MASKS)), np.uint64)
    wide = vectors.astype(np.uint64)
    for table, (part, mask) in enumerate((p, m) for p in range(PARTS) for m in MASKS):
        h = np.full(len(vectors), table + 1, np.uint64) * _PRIME
        for k in mask:
            h = (h ^ wide[:, 6 * part + k]) * _PRIME
            h ^= h >> np.uint64(31)
        out[:, table] = h
    return out.view(np.int64)


def sketches(df: DataFrame, id_col: str, text_col: str, size: int, least_words: int) -> DataFrame:
    """(id, same, n, sketch): a digest of the word sequence, the number of
    distinct shingles, and the lanes, of texts of ``least_words`` words or more;
    of a text without words the digest is its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factors, terms = _constants(LANES)
        for frame in slices(frames, "text", 1 << 24):
            rows = []
            for i, text in zip(frame["id"], frame["text"]):
                found = words(text)
                if len(found) >= least_words:
                    hashes = shingle_hashes(found, size)
                    rows.append((i, xxhash.xxh128_digest(" ".join(found) or text), len(hashes), lanes(hashes, factors, terms).tobytes()))
            yield pd.DataFrame(rows, columns=["id", "same", "n", "sketch"])

    slim = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null"))
    return slim.mapInPandas(run, "id long, same binary, n int, sketch binary")


def _buckets(representatives: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), 4096):
                part = frame.iloc[start : start + 4096]
                if len(part):
                    every = keys(np.frombuffer(b"".join(part["sketch"]), np.uint32).reshape(-1, LANES))
                    ids = np.repeat(part["id"].to_numpy(np.int64), every.shape[1])
                    yield pd.DataFrame({"key": every.ravel(), "id": ids})

    return representatives.select("id", "sketch").mapInPandas(run, "key long, id long")


def _prepared(df: DataFrame, size: int, least_words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(members, kept): id and representative of each text, and id, n and sketch of
    the representatives that have shingles."""
    checkpoint_dir(df.sparkSession)
    made = sketches(df, id_col, text_col, size, least_words).checkpoint()
    firsts = made.groupBy("same").agg(F.min("id").alias("representative"), F.min(F.struct("id", "n", "sketch")).alias("first"))
    members = made.select("id", "same").distinct().join(firsts.select("same", "representative"), "same").select("id", "representative")
    # texts shorter than a shingle are like no other but their equals
    return members, firsts.select("first.*").filter("n > 0")


def _near(candidates: DataFrame, kept: DataFrame, similarity: float) -> DataFrame:
    """The candidate pairs (a, b) that their sizes and lanes let be similar."""
    # lanes: agreement below the expected less five deviations
    floor = max(0.0, similarity - 5 * (similarity * (1 - similarity) / LANES) ** 0.5)

    @F.pandas_udf("double")
    def agreement(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        p = np.frombuffer(b"".join(x), np.uint32).reshape(-1, LANES)
        q = np.frombuffer(b"".join(y), np.uint32).reshape(-1, LANES)
        return pd.Series((p == q).mean(1))

    return (
        candidates.join(kept.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a")
        .join(kept.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")), "b")
        .filter((F.col("n_a") >= similarity * F.col("n_b")) & (F.col("n_b") >= similarity * F.col("n_a")))
        .filter(agreement("s_a", "s_b") >= floor)
        .select("a", "b")
        .checkpoint()
    )


def similar_pairs(df: DataFrame, similarity: float = 0.8, size: int = 5, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, members).

    ``members`` (id, representative): each text of ``least_words`` words or
    more and the smallest id with the same words. ``pairs`` (a, b, jaccard),
    a < b: representatives with different words whose sets of distinct runs of
    ``size`` words have at least ``similarity`` in common. Null ids and texts
    and shorter texts are in neither; repeated ids count once. Texts of fewer
    than ``size`` words, where asked for, are in no pair; those without words
    are equal where they are the same text.

    ``similarity`` is at least 0.6, for which the parts are chosen. There are as
    many pairs as there are: ``document_groups`` is the form that stays linear.
    """
    members, kept = _prepared(df, size, least_words, id_col, text_col)
    buckets = _buckets(kept)
    # both sides are one plan, so the buckets are shuffled once; a hot key is split by the join (AQE)
    left, right = buckets.alias("l"), buckets.alias("r")
    candidates = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    return _verified(_near(candidates, kept, similarity), df, similarity, size, id_col, text_col), members


def _verified(near: DataFrame, df: DataFrame, similarity: float, size: int, id_col: str, text_col: str) -> DataFrame:
    """Exact similarities of candidate pairs, from the full sets of shingles."""
    wanted = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", 1 << 24):
            yield pd.DataFrame({"id": frame["id"], "hashes": [shingle_hashes(words(t), size).tobytes() for t in frame["text"]]})

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null").join(wanted, "id", "left_semi")
    sets = slim.mapInPandas(run, "id long, hashes binary").dropDuplicates(["id"])

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            common = len(np.intersect1d(p, q, assume_unique=True))
            out.append(common / max(1, len(p) + len(q) - common))
        return pd.Series(out, dtype=float)

    return (
        near.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("h_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("h_b")), "b")
        .select("a", "b", jaccard("h_a", "h_b").alias("jaccard"))
        .filter(F.col("jaccard") >= similarity)
    )


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of ids whose texts are equal or similar; as
    many rows as there are such pairs. ``groups`` is the form that stays linear."""
    m, o = members.alias("m"), members.alias("o")
    equal = m.join(o, F.col("m.representative") == F.col("o.representative")).filter("m.id < o.id").select(F.col("m.id").alias("a"), F.col("o.id").alias("b"))
    left = members.select(F.col("representative").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("representative").alias("b"), F.col("id").alias("y"))
    similar = pairs.select("a", "b").join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return equal.unionByName(similar)


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group): one row a text, with the smallest id of its connected
    component under the pairs; a text like no other is its own group.

    Alternating large-star and small-star rounds over the edges until nothing
    changes, which they reach whatever the edges; the number of rounds grows
    with the logarithm of the longest chain.
    """
    spark = pairs.sparkSession
    checkpoint_dir(spark)
    edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct().checkpoint()
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = small.checkpoint()
        state = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return members.join(roots, F.col("representative") == F.col("u"), "left").select("id", F.coalesce("root", "representative").alias("group"))


#: Pairs a bucket row that are compared without thinking; beyond, buckets are thinned by stars first.
PAIRS_A_ROW = 16


def document_groups(df: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text", pairs_a_row: int = PAIRS_A_ROW) -> DataFrame:
    """(id, group): the smallest id of each text's connected component under
    ``similar_pairs``, for all ids of ``df`` but null, whatever the size of
    their texts. Texts of fewer than ``size`` words are grouped with their
    equals; a null text is its own group.

    Only pairs in different components are ever compared. While the buckets
    hold more than ``pairs_a_row`` of them a row, each bucket's texts are
    compared with one of its texts, another one each round, and what is
    similar becomes one component: a family of n copies costs n pairs, not
    n²/2. When there are few left, or a round joins nothing, the pairs that
    are left are compared, so no link between components is lost.
    """
    members, kept = _prepared(df, size, 0, id_col, text_col)
    every = _buckets(kept)
    several = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    buckets = every.join(several, "key", "left_semi").checkpoint()
    ids = kept.select("id", F.col("id").alias("representative"))
    edges: DataFrame | None = None
    found = kept.select("id", F.col("id").alias("group"))
    joined, turn = True, 0
    while True:
        placed = buckets.join(found, "id").select("key", "id", "group").checkpoint()
        counts = placed.groupBy("key", "group").agg(F.count(F.lit(1)).alias("c"))
        by_key = counts.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max(F.struct("c", "group"))["group"].alias("main"), F.count(F.lit(1)).alias("groups")).filter("groups > 1").checkpoint()
        open_ = by_key.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        thin = joined and open_["pairs"] > pairs_a_row * open_["rows"]
        if thin:
            # one text of each bucket, another each round, with all others
            first = F.min(F.struct(F.xxhash64(F.lit(turn), F.col("id")).alias("h"), "id", "group"))
            stars = placed.join(by_key.select("key"), "key", "left_semi").groupBy("key").agg(first.alias("f")).select("key", F.col("f.id").alias("x"), F.col("f.group").alias("x_group"))
            both = placed.join(stars, "key").filter("group <> x_group")
            candidates = both.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()
        else:
            # those outside the largest component of a bucket with all of other components
            rest = placed.join(by_key.select("key", "main"), "key").withColumn("out", F.col("group") != F.col("main"))
            one, all_ = rest.filter("out").alias("l"), rest.alias("r")
            both = one.join(all_, F.col("l.key") == F.col("r.key")).filter("l.group <> r.group and (not r.out or l.id < r.id)")
            candidates = both.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
        new = _verified(_near(candidates, kept, similarity), df, similarity, size, id_col, text_col).select("a", "b").checkpoint()
        joined, turn = not new.isEmpty(), turn + 1
        if joined:
            edges = new if edges is None else edges.unionByName(new)
            found = groups(edges, ids).checkpoint()
        if not thin:
            break
    grouped = members.join(found.withColumnRenamed("id", "representative"), "representative", "left").select("id", F.coalesce("group", "representative").alias("group"))
    empty = df.filter(F.col(text_col).isNull()).select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct()
    return grouped.unionByName(empty.join(grouped.select("id"), "id", "left_anti").select("id", F.col("id").alias("group")))
