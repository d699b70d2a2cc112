"""Removal of evaluation text: word runs, sentences, prompt hashes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import sentences
from ..functions.text import decontam_normalise, split_words, squeeze, strip, text_of
from ..sources.tables import spread

#: Most hashes of word runs in a block: 16 MB; a task holds one block at a time.
INDEX_BLOCK = 2_000_000


def word_runs(words: Column, n: int) -> Column:
    """Runs of ``n`` words joined by blanks; none for fewer words. The array is
    bound once as a lambda variable, or it would be computed for every run."""
    return F.flatten(
        F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>")))
    )


def segments_of(items: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(t): the texts of columns of any of these shapes: a string, a list of
    strings, a struct with ``text`` (a string or a list), a list of such structs.
    Null ones are left out."""
    out = None
    for name in names:
        kind, c = items.schema[name].dataType, F.col(name)
        if kind.typeName() == "struct":
            kind, c = kind["text"].dataType, c["text"]
        if kind.typeName() == "array":
            if kind.elementType.typeName() == "struct":
                c = F.transform(c, lambda x: x["text"])
            c = F.explode(c)
        part = items.select(c.alias("t"))
        out = part if out is None else out.unionAll(part)
    return out.filter("t is not null")


def ngram_index(items: DataFrame, text_cols: tuple[str, ...] = ("text",), n: int = 13) -> DataFrame:
    """(gram): the distinct MD5 digests of the word runs of all text columns,
    of any shape ``segments_of`` reads."""
    return segments_of(items, text_cols).select(F.explode(word_runs(split_words("t"), n)).alias("g")).select(F.md5("g").alias("gram")).distinct()


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def ngram_hits(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text: str = "text", n: int = 13) -> DataFrame:
    """(id, hits): the number of word runs of each text, with multiplicity, that
    stand in some item; texts without one have no row.

    Rolling hashes of the items' runs, 8 bytes each, are broadcast in blocks; in
    one scan of ``df`` they pick the runs that could match, and only the digests of those
    are joined with the index, which settles each match. Null ids or texts have no row.
    """
    spark = df.sparkSession
    slim = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null"))
    kind = df.schema[id_col].dataType.simpleString()
    blocks = [spark.sparkContext.broadcast(x) for x in _hash_blocks(items.select(F.col(item_text).alias("text")), n)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _Roller(n)
        for frame in frames:
            texts = [_words(t) for t in frame["text"]]
            hashes = [own.hashes(w) for w in texts]
            found = [np.zeros(len(h), bool) for h in hashes]
            for block in blocks:
                index = block.value
                for h, hit in zip(hashes, found):
                    hit |= index[np.minimum(np.searchsorted(index, h), len(index) - 1)] == h
                if len(blocks) > 1:
                    # of many blocks a worker keeps none but the one at hand
                    vars(block).pop("_value", None)
            rows = [(i, md5(" ".join(words[k : k + n]).encode("utf-8", "surrogatepass")).hexdigest()) for i, words, hit in zip(frame["id"], texts, found) for k in np.flatnonzero(hit).tolist()]
            yield pd.DataFrame(rows, columns=["id", "gram"])

    schema = f"id {kind}, gram string"
    could = slim.mapInPandas(run, schema) if blocks else spark.createDataFrame([], schema)
    per_run = could.groupBy("id", "gram").agg(F.count(F.lit(1)).alias("k"))
    return per_run.join(ngram_index(items, (item_text,), n), "gram", "left_semi").groupBy("id").agg(F.sum("k").alias("hits")).withColumnRenamed("id", id_col)


def _hash_blocks(items: DataFrame, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct rolling hashes of the items' word runs, in blocks of
    ``INDEX_BLOCK``; they are made by the tasks and come piece by piece."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roller = _Roller(n)
        for frame in frames:
            found = [roller.hashes(_words(t)) for t in frame["text"]]
            every = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
            yield pd.DataFrame({"h": [every[k : k + (1 << 17)].tobytes() for k in range(0, len(every), 1 << 17)]})

    held: list[np.ndarray] = []
    for (piece,) in items.filter("text is not null").mapInPandas(run, "h binary").toLocalIterator():
        held.append(np.frombuffer(bytes(piece), np.uint64))
        if sum(map(len, held)) >= INDEX_BLOCK:
            yield np.unique(np.concatenate(held))
            held = []
    if held:
        yield np.unique(np.concatenate(held))


class _Roller:
    """Rolling hashes of word runs; a word's hash is its own digest, cached."""

    def __init__(self, n: int):
        self.n, self.known = n, {}
        rng = np.random.default_rng(5)
        self.factors = rng.integers(1, 1 << 62, n, dtype=np.uint64) | np.uint64(1)

    def hashes(self, words: list[str]) -> np.ndarray:
        if len(words) < self.n:
            return np.empty(0, np.uint64)
        if len(self.known) > 1_000_000:
            self.known.clear()
        one = np.empty(len(words), np.uint64)
        for k, w in enumerate(words):
            h = self.known.get(w)
            if h is None:
                h = self.known[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            one[k] = h
        m = len(words) - self.n + 1
        out = np.zeros(m, np.uint64)
        for k in range(self.n):
            out += one[k : k + m] * self.factors[k]
        return out


def remove_hit(df: DataFrame, hits: DataFrame, id_col: str = "doc_id", threshold: int = 0) -> DataFrame:
    """The rows of ``df`` with at most ``threshold`` hits."""
    return df.join(hits.filter(F.col("hits") > threshold).select(id_col), id_col, "left_anti")


def sentence_hashes(items: DataFrame, text_col: str = "text", least: int = 10) -> DataFrame:
    """(h): MD5 of the items' sentences, normalised, of ``least`` characters or more."""
    s = items.filter(F.col(text_col).isNotNull()).select(F.explode(sentences(text_col)).alias("s")).select(squeeze("s").alias("s"))
    return s.filter(F.length("s") >= least).select(F.md5("s").alias("h")).distinct()


def remove_sentences(df: DataFrame, blocked: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """(id, text, n_removed): texts without the blocked sentences, the rest
    joined by blanks; shorter sentences stay, a text that loses all is empty,
    a null text stays null.

    Digests of sentences look for blocked ones; only the ids with a hit and
    their blocked digests meet the texts, which are cut where they lie. Rows of
    one id are cut alike; a null id loses nothing.
    """
    digest = lambda s: F.md5(squeeze(s))
    own = F.array_distinct(F.transform(F.filter(sentences(text_col), lambda s: F.length(squeeze(s)) >= least), digest))
    hit = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col), F.explode(own).alias("h")).join(blocked.select("h").distinct(), "h", "left_semi")
    bad = hit.groupBy(id_col).agg(F.collect_set("h").alias("_bad"))
    cut = df.select(id_col, F.col(text_col).alias("_old"), sentences(text_col).alias("_s")).join(bad, id_col, "left")
    cut = cut.withColumn("_kept", F.when(F.col("_bad").isNull(), F.col("_s")).otherwise(F.filter("_s", lambda s: ~(F.array_contains("_bad", digest(s)) & (F.length(squeeze(s)) >= least)))))
    return cut.select(id_col, F.when(F.col("_old").isNotNull(), F.array_join("_kept", " ")).alias("text"), (F.size("_s") - F.size("_kept")).cast("long").alias("n_removed"))


def prompt_hashes(instruction: str, given: str) -> Column:
    """SHA-256 of the normalised instruction, instruction with input, and first
    paragraph of the instruction; without those that are empty."""
    i, x = text_of(instruction), text_of(given)
    forms = [i, F.when(strip(x) != "", F.concat(i, F.lit("\n\n"), x)), F.split(i, "\n\n")[0]]
    return F.array_distinct(F.filter(F.transform(F.array(*[decontam_normalise(f) for f in forms]), lambda t: F.when(t != "", F.sha2(t, 256))), lambda h: h.isNotNull()))


def eval_hashes(items: DataFrame, text_col: str = "text", set_col: str = "eval_set") -> DataFrame:
    """(h, eval_sets) of the items' normalised texts; the sets of a hash in order."""
    h = items.select(decontam_normalise(text_col).alias("t"), F.col(set_col)).filter("t <> ''").select(F.sha2("t", 256).alias("h"), set_col)
    return h.groupBy("h").agg(F.array_sort(F.collect_set(set_col)).alias("eval_sets"))


def matching_sets(rows: DataFrame, hashes: DataFrame, id_col: str = "row_id", instruction: str = "instruction", given: str = "input") -> DataFrame:
    """(id, eval_set): the evaluation sets a prompt matches."""
    return (
        rows.select(id_col, F.explode(prompt_hashes(instruction, given)).alias("h"))
        .join(hashes, "h")
        .select(id_col, F.explode("eval_sets").alias("eval_set"))
        .distinct()
    )
