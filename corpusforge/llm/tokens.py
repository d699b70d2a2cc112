"""Tokens of a public vocabulary: encoding, decoding, counting, budgets.

Counting (problem 1) never encodes a document. The distinct pieces of the
corpus, as cut by the vocabulary's pre-splitting pattern, are spread over
partitions by their prefix; each partition walks them as a trie and carries the
exact state of the byte-pair encoder along shared prefixes; the number of
tokens at a piece's last node is then joined to the piece's postings, so that
only (piece, postings) is shuffled and never the text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import partitions, spread
from .common import TOKENIZER_DIR, slices, source_key

#: Fixed value: the pre-splitting pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts above this many characters are cut at safe boundaries before encoding.
BLOCK = 1 << 16

#: Places where a piece always begins and the one before always ends: at a
#: single blank or newline between visible characters, and between letters,
#: digits and other marks, but for an apostrophe before a letter.
SAFE = regex.compile(r"(?<=\S)[ \n](?=\S)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


@lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> tiktoken.Encoding:
    """The tokenizer of a rank file ``<folder>/<name>.tiktoken``, without special tokens."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def blocks(text: str, size: int = BLOCK) -> list[str]:
    """``text`` in runs of about ``size`` characters that can be encoded alone.

    Each cut is at a place of ``SAFE``, so the ids of the runs joined are the
    ids of the text. A stretch without one is a single piece, or blanks.
    """
    parts, start = [], 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    parts.append(text[start:])
    return parts


def encode_text(coder: tiktoken.Encoding, text: str | None) -> list[int]:
    """Ids of a text; none for an empty or null one."""
    if not text:
        return []
    if len(text) <= BLOCK:
        return coder.encode_ordinary(text)
    return [i for part in blocks(text) for i in coder.encode_ordinary(part)]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id, ids): every text as ids of a public vocabulary.

    One row for each row of ``df``; an empty or null text has the empty list.
    Strings that look like special tokens are ordinary text. Null ids stay
    null, repeated rows stay repeated, other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(name, folder)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                lists = [encode_text(coder, t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                flat = np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    slim = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return slim.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id, text): the texts of lists of ids, joined as raw bytes first, since a
    character may lie across tokens. Bytes that are no UTF-8 become U+FFFD; a
    null list gives null, an empty one the empty text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(name, folder)
        for frame in frames:
            texts = [None if x is None else coder.decode_bytes([int(i) for i in x]).decode("utf-8", "replace") for x in frame["ids"]]
            yield pd.DataFrame({"id": frame["id"], "text": pd.Series(texts, dtype=object, index=frame.index)})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInPandas(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


class PieceTrie:
    """Exact numbers of tokens of pieces, by states carried along prefixes.

    The state of a prefix is (last token, number of tokens) of its encoding. A
    sequence of tokens is the encoding of its bytes exactly when each pair of
    neighbours is the encoding of its own bytes, so the state of a prefix
    follows from those of shorter prefixes: the one token that ends it and is
    compatible with the last token before it.
    """

    def __init__(self, coder: tiktoken.Encoding):
        self.single, self.ranks = coder._encode_single_piece, coder._mergeable_ranks
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.tails = {b[k:] for b in self.ranks for k in range(len(b))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.before, self.states = b"", [(-1, 0)]

    def fits(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            known = self.pairs[left, right] = self.single(self.bytes[left] + self.bytes[right]) == [left, right]
        return known

    def extend(self, piece: bytes, states: list[tuple[int, int]]) -> None:
        """Append the states of the prefixes of ``piece`` that are longer than those given."""
        ranks, tails = self.ranks, self.tails
        for end in range(len(states), len(piece) + 1):
            ending, size = [], 1
            while size <= end and (tail := piece[end - size : end]) in tails:
                if (token := ranks.get(tail)) is not None:
                    ending.append((size, token))
                size += 1
            for size, token in reversed(ending):
                last, count = states[end - size]
                if count == 0 or self.fits(last, token):
                    states.append((token, count + 1))
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")

    def count(self, piece: bytes) -> int:
        """Number of tokens of a piece; of what it shares with the piece asked
        for before, the states are there, so sorted pieces walk the trie once."""
        before, states = self.before, self.states
        shared, most = 0, min(len(piece), len(before))
        if piece[:most] == before[:most]:
            shared = most
        else:
            while piece[shared] == before[shared]:
                shared += 1
        del states[shared + 1 :]
        self.extend(piece, states)
        self.before = piece
        return states[-1][1]


def _postings(frame: pd.DataFrame, cutter: regex.Pattern, salts: int, chunk: int, keep: tuple[str, ...]) -> pd.DataFrame:
    """One row a distinct piece of the frame's texts: the rows that hold it and
    how often; and one row with the frame's ids and kept columns, under a null piece."""
    index: dict[str, int] = {}
    flat, sizes = [], []
    for text in frame["text"]:
        found = cutter.findall(text) if text else []
        sizes.append(len(found))
        flat.append(np.fromiter((index.setdefault(p, len(index)) for p in found), np.int64, len(found)))
    kept = [[None if v is None else str(v) for v in frame[name]] for name in keep]
    rows = [(chunk, None, 0, np.asarray(frame["id"], np.int64).tobytes(), b"", kept)]
    n = len(frame)
    keys, times = np.unique(np.concatenate(flat) * n + np.repeat(np.arange(n), sizes), return_counts=True)
    starts = np.searchsorted(keys, np.arange(len(index) + 1) * n)
    at, times = (keys % n).astype(np.int32), times.astype(np.int32)
    for piece, i in index.items():
        a, b = starts[i], starts[i + 1]
        raw = piece.encode("utf-8", "replace")
        rows.append((chunk, raw, ((chunk >> 32) + chunk) % salts, np.diff(at[a:b], prepend=np.int32(0)).astype(np.int32).tobytes(), b"" if (times[a:b] == 1).all() else times[a:b].tobytes(), None))
    return pd.DataFrame(rows, columns=["chunk", "piece", "salt", "rows", "times", "kept"])


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, prefix: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, n_tokens): the exact number of tokens of each text.

    By partitioned tries of distinct pieces (see the module). ``id_col`` is an
    integer column; rows with a null id have none; an empty or null text has 0.
    Repeated ids keep a row for each of their rows. The columns of ``keep``
    travel with the ids, as strings, so that totals by them need no join.

    The postings of one prefix, however frequent, are spread over a number of
    tasks that grows with the text, so a task's share of it does not.
    """
    spark = df.sparkSession
    scanned = partitions(df.select(text_col), 1)
    salts = max(4, scanned // 4)
    # as many lanes as the text has partitions at least, so that a task's share stays the same as the corpus grows
    lanes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * scanned)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = regex.compile(PATTERN)
        # the same for a task that runs again
        first = TaskContext.get().partitionId() << 32
        for k, part in enumerate(slices(frames, "text", 1 << 24)):
            yield _postings(part, cutter, salts, first + k, keep)

    def pack(sums: dict[int, np.ndarray]) -> pd.DataFrame:
        rows = []
        for c, x in sums.items():
            some = np.flatnonzero(x)
            values = x[some] if 2 * len(some) < len(x) else x
            # positions only where most of the chunk's rows are not touched here
            wide = x.max(initial=0) >> 31
            raw = values.astype(np.int64 if wide else np.int32).tobytes()
            rows.append((c, None, some.astype(np.int32).tobytes(), raw, None) if values is not x else (c, None, b"", (b"8" if wide else b"4").ljust(8) + raw, None))
        return pd.DataFrame(rows, columns=["chunk", "ids", "at", "part", "kept"])

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Token counts of a lane's pieces, which come sorted, met with their
        postings: partial sums of each chunk's rows. Ids pass through."""
        trie = PieceTrie(encoding(name, folder))
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            known = frame["piece"].isna()
            if known.any():
                own = frame[known]
                yield pd.DataFrame({"chunk": own["chunk"], "ids": own["rows"], "at": b"", "part": None, "kept": own["kept"]})
                frame = frame[~known]
            last, n = None, 0
            for chunk, piece, rows, times in zip(frame["chunk"], frame["piece"], frame["rows"], frame["times"]):
                if piece != last:
                    last, n = piece, trie.count(piece)
                at = np.cumsum(np.frombuffer(rows, np.int32))
                most = int(at[-1]) + 1
                total = sums.get(chunk)
                if total is None or len(total) < most:
                    grown = np.zeros(max(most, 2 * (0 if total is None else len(total))), np.int64)
                    if total is not None:
                        grown[: len(total)] = total
                    total = sums[chunk] = grown
                total[at] += n * (np.frombuffer(times, np.int32) if times else 1)
            if sum(map(len, sums.values())) > 1 << 22:
                yield pack(sums)
                sums = {}
        if sums:
            yield pack(sums)

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["ids"].notna()].iloc[0]
        ids = np.frombuffer(own["ids"], np.int64)
        total = np.zeros(len(ids), np.int64)
        for at, part in zip(frame["at"], frame["part"]):
            if not part:
                continue
            if at:
                place = np.frombuffer(at, np.int32)
                total[place] += np.frombuffer(part, np.int32 if len(part) == 4 * len(place) else np.int64)
            else:
                # dense from the first row on; the first byte tells 4 from 8 bytes a row
                wide = part[:1] == b"8"
                x = np.frombuffer(part, np.int64 if wide else np.int32, offset=8)[: len(ids)]
                total[: len(x)] += x
        return pd.DataFrame({"id": ids} | {k: pd.Series(list(v), dtype=object) for k, v in zip(keep, own["kept"])} | {"n_tokens": total})

    slim = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(k).cast("string").alias(k) for k in keep])).filter("id is not null")
    postings = slim.mapInPandas(cut, "chunk long, piece binary, salt int, rows binary, times binary, kept array<array<string>>")
    # one exchange: pieces go by prefix and salt, a chunk's ids by the chunk
    key = F.when(F.col("piece").isNull(), F.xxhash64("chunk")).otherwise(F.xxhash64(F.substring("piece", 1, prefix), "salt"))
    lane = postings.withColumn("lane", key).repartition(lanes, "lane").drop("lane").sortWithinPartitions("piece")
    sums = lane.mapInPandas(walk, "chunk long, ids binary, at binary, part binary, kept array<array<string>>")
    kept = "".join(f"`{k}` string, " for k in keep)
    return sums.groupBy("chunk").applyInPandas(join, f"id long, {kept}n_tokens long").withColumnRenamed("id", id_col)


def source_totals(counts: DataFrame, names: DataFrame) -> DataFrame:
    """(source, n_documents, tokens): the tokens of each name in ``names.name``,
    from ``counts`` with ``key``, the documents' ``source_key``.

    Other spellings of a name belong to it; documents with a null source or
    one in no name are left out; a name without documents has 0.
    """
    totals = counts.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("tokens"))
    return (
        names.select(F.col("name").alias("source"), source_key("name").alias("key"))
        .join(totals, "key", "left")
        .select("source", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    )


def domain_key(column: str) -> "F.Column":
    """A site's name without case, scheme, ``www.`` and final dot or slash."""
    return F.regexp_replace(F.lower(F.trim(F.col(column))), "^(?:[a-z]+://)?(?:www\\.)?|[./\\s]+$", "")


#: Two-letter codes and the other spellings they are delivered in.
LANGUAGE_NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "it": ("it", "ita", "italian"),
    "pt": ("pt", "por", "portuguese"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "ru": ("ru", "rus", "russian"),
}


#: A label: the language, then region or script after a separator or in brackets.
LABEL = r"([a-z]+)(?:[-_ ][a-z0-9()]+)*"


def lang_key(column: str) -> "F.Column":
    """The two-letter code of a label in any spelling; null where it is missing
    or names no known language. A region is left out."""
    first = F.regexp_extract(F.lower(F.trim(F.col(column))), f"^{LABEL}$", 1)
    known = F.create_map(*[F.lit(x) for code, names in LANGUAGE_NAMES.items() for n in names for x in (n, code)])
    return F.try_element_at(known, first)
