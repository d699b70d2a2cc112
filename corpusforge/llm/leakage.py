"""Evaluation texts inside training texts (problem 2).

Each shard of the corpus becomes a sequence of word numbers and a suffix array
over it, ordered by its first six words, once. Every suffix of every test item
is looked up in every shard by binary search; the range found holds all places
that share its first words. Each place is extended to the longest verbatim
match, and the passage around it is compared word by word, and by alignment
where words were dropped or added, under the tolerance of the problem.

The test items are the query set, cut into blocks of a bounded number of words;
a shard takes one block after the other and holds one at a time.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .common import WORD, slices
from .langid import HIDDEN, INVISIBLE

#: Words by which suffixes are ordered.
DEPTH = 6
#: Most words of test items in a block: 2 million words take some 30 MB.
BLOCK_WORDS = 2_000_000
#: Words that may stand where an item has its blank.
FILL = 8
#: Offsets looked at around a match, and shifts by dropped or added words.
REACH, SHIFT = 40, 3


def normal_words(text: str) -> list[str]:
    """Words without regard to case, marks, spacing, invisible and compatibility characters."""
    if not text.isascii():
        if HIDDEN.search(text):
            text = text.translate(INVISIBLE)
        text = unicodedata.normalize("NFKC", text)
    return WORD.findall(text.lower())


def seed_length(n: int, tolerance: int = 8) -> int:
    """Words that must stand verbatim somewhere if at most one in ``tolerance``
    of ``n`` differs: the differing words cut the rest into that many runs and one."""
    k = n // tolerance
    return max(1, min(DEPTH, -(-(n - k) // (k + 1))))


class Items:
    """A block of test items as numbers: equal texts are one."""

    def __init__(self, rows: list[tuple[int, str]], stretch: int = 20, tolerance: int = 8):
        self.stretch, self.tolerance = stretch, tolerance
        by: dict[tuple, list[int]] = defaultdict(list)
        for i, text in rows:
            parts = [normal_words(p) for p in text.split("_")]
            flat = [w for p in parts for w in p]
            if flat:
                blanks = tuple(np.cumsum([len(p) for p in parts[:-1]]).tolist())
                by[tuple(flat), blanks].append(i)
        self.ids = [sorted(set(v)) for v in by.values()]
        # words by their number in the block; a shard has numbers of its own
        vocabulary: dict[str, int] = {}
        texts = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], np.int64) for ws, _ in by]
        self.words = list(vocabulary)
        self.blanks = [set(b) for _, b in by]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        pad = np.full(REACH + DEPTH + FILL, -1, np.int64)
        chunks, self.starts, at = [pad], [], len(pad)
        for t in texts:
            self.starts.append(at)
            chunks += [t, pad]
            at += len(t) + len(pad)
        self.flat = np.concatenate(chunks)
        self.starts = np.array(self.starts, np.int64)
        # every suffix that is long enough to be a seed, and the seed's length
        owner, place, seed = [], [], []
        for k, n in enumerate(self.sizes.tolist()):
            s = seed_length(min(n, stretch), tolerance)
            if self.blanks[k]:
                s = max(1, min(s, 4))  # the blank cuts a run once more
            for q in range(n - s + 1):
                owner.append(k)
                place.append(self.starts[k] + q)
                seed.append(s)
        self.owner, self.place, self.seed = (np.array(x, np.int64) for x in (owner, place, seed))


def _pack(flat: np.ndarray, at: np.ndarray, length: np.ndarray | None = None, fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two keys of the six words from each place; beyond ``length`` words are ``fill``."""
    keys = []
    for half in (0, 3):
        key = np.zeros(len(at), np.int64)
        for k in range(half, half + 3):
            digit = np.maximum(flat[at + k], 0)
            if length is not None:
                digit = np.where(k < length, digit, fill)
            key = (key << 21) | digit
        keys.append(key)
    return keys[0], keys[1]


def _search(a1: np.ndarray, a2: np.ndarray, k1: np.ndarray, k2: np.ndarray, right: bool) -> np.ndarray:
    """Places of keys in a sorted array of pairs, all by binary search at once."""
    low, high = np.zeros(len(k1), np.int64), np.full(len(k1), len(a1), np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = np.where(open_, (low + high) // 2, 0)
        x1, x2 = a1[mid], a2[mid]
        below = (x1 < k1) | ((x1 == k1) & ((x2 <= k2) if right else (x2 < k2)))
        low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)


class Shard:
    """Texts as numbers, and the suffix array over them."""

    def __init__(self, texts: list[str]):
        pad = [0] * (REACH + DEPTH + FILL)
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        flat: list[int] = list(pad)
        begins = []
        for text in texts:
            begins.append(len(flat))
            flat += [number(w, len(self.vocabulary) + 1) for w in normal_words(text)]
            flat += pad
        self.flat, self.first = np.array(flat, np.int64), np.array(begins, np.int64)
        suffixes = np.flatnonzero(self.flat)
        a1, a2 = _pack(self.flat, suffixes)
        order = np.lexsort((a2, a1))
        self.suffixes, self.keys = suffixes[order], (a1[order], a2[order])

    def numbered(self, items: Items) -> Items:
        """``items`` in the shard's numbers, -2 for words it has not; seeds with such a word are left out."""
        known = self.vocabulary.get
        number = np.array([-2, *[known(w, -2) for w in items.words], -1], np.int64)
        own = copy(items)
        own.flat = number[items.flat]  # padding is -1, the last
        whole = own.flat[items.place] > 0
        for k in range(1, DEPTH):
            whole &= (own.flat[items.place + k] > 0) | (items.seed <= k)
        own.place, own.owner, own.seed = items.place[whole], items.owner[whole], items.seed[whole]
        return own


def scan(block: Items, shard: Shard) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word in the text, first word in the item, length of
    the longest verbatim match) of the texts of a shard that leak an item."""
    if not len(shard.suffixes):
        return []
    items, train, first, suffixes = shard.numbered(block), shard.flat, shard.first, shard.suffixes
    top = (1 << 21) - 1
    low = _search(*shard.keys, *_pack(items.flat, items.place, items.seed, 0), right=False)
    high = _search(*shard.keys, *_pack(items.flat, items.place, items.seed, top), right=True)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    tried: set[tuple[int, int, int]] = set()
    sizes = high - low
    some = np.flatnonzero(sizes)
    # in runs of a bounded number of places
    ends = np.cumsum(sizes[some])
    a = 0
    while a < len(some):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 200_000, "right")))
        part = some[a:b]
        a = b
        n = sizes[part]
        at = np.repeat(low[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        p, q, k = suffixes[at], np.repeat(items.place[part], n), np.repeat(items.owner[part], n)
        # a run of matching words is looked at once, from its first word
        new = train[p - 1] != items.flat[q - 1]
        p, q, k = p[new], q[new], k[new]
        for s in range(0, len(p), 20_000):
            _judge(items, train, first, p[s : s + 20_000], q[s : s + 20_000], k[s : s + 20_000], found, tried)
    return [(t, k, x, y, n) for (t, k), (x, y, n) in found.items()]


def _judge(items: Items, train: np.ndarray, first: np.ndarray, p: np.ndarray, q: np.ndarray, k: np.ndarray, found: dict, tried: set) -> None:
    """Add to ``found`` the passages around places (p, q) of items k that hold."""
    if not len(p):
        return
    stretch, tolerance = items.stretch, items.tolerance
    off = np.arange(-REACH, REACH + 1)
    beyond = len(train) - 1
    item_at = items.flat[np.clip(q[:, None] + off, 0, len(items.flat) - 1)]
    base = items.starts[k]
    inside = (q[:, None] + off >= base[:, None]) & (q[:, None] + off < (base + items.sizes[k])[:, None])
    same = inside & (train[np.clip(p[:, None] + off, 0, beyond)] == item_at)
    run = same[:, REACH:]
    longest = np.where(run.all(1), run.shape[1], run.argmin(1))
    # a run that fills the window is followed to its real end; padding ends it
    ahead, on = np.arange(REACH), np.flatnonzero(run.all(1))
    while len(on):
        x, y = (p[on] + longest[on])[:, None] + ahead, (q[on] + longest[on])[:, None] + ahead
        more = train[np.minimum(x, beyond)] == items.flat[np.minimum(y, len(items.flat) - 1)]
        full = more.all(1)
        longest[on] += np.where(full, REACH, more.argmin(1))
        on = on[full]
    near = same.copy()
    shifts = [d for d in range(-SHIFT, SHIFT + 1) if d]
    with_blank = np.array([bool(items.blanks[x]) for x in k.tolist()])
    for d in shifts:
        near |= inside & (train[np.clip(p[:, None] + off + d, 0, beyond)] == item_at)
    if with_blank.any():
        for d in range(SHIFT + 1, FILL + 1):
            for e in (d, -d):
                near[with_blank] |= inside[with_blank] & (train[np.clip(p[with_blank, None] + off + e, 0, beyond)] == item_at[with_blank])
    text = np.searchsorted(first, p, "right") - 1
    done = np.zeros(len(p), bool)

    def windows(matrix: np.ndarray, length: int) -> np.ndarray:
        total = np.cumsum(np.pad(matrix, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
        return total[:, length:] - total[:, :-length]

    def accept(rows: np.ndarray) -> None:
        for r in rows.tolist():
            key = (int(text[r]), int(k[r]))
            n = int(longest[r])
            if key not in found or found[key][2] < n:
                found[key] = (int(p[r] - first[text[r]]), int(q[r] - base[r]), n)
        done[rows] = True

    short = items.sizes[k] < stretch
    if short.any():
        total, need = same.sum(1), items.sizes[k] - items.sizes[k] // tolerance
        accept(np.flatnonzero(short & (total >= need)))
    lengths = (stretch, stretch + tolerance // 2, 32, 40)
    for length in lengths:
        need = length - length // tolerance
        fits = windows(inside, length) == length
        accept(np.flatnonzero(~done & ~short & ((windows(same, length) >= need) & fits).any(1)))
    # words dropped or added, or a filled blank: align what could still hold
    for length in lengths[:2]:
        need = length - length // tolerance
        fits = windows(inside, length) == length
        could = (windows(near, length) >= need) & fits
        for r in np.flatnonzero(~done & ~short & could.any(1)).tolist():
            key = (int(text[r]), int(k[r]), int(p[r]))
            if key in tried or ((key[0], key[1]) in found and found[key[0], key[1]][2] >= longest[r]):
                continue
            tried.add(key)
            for c in np.flatnonzero(could[r]).tolist():
                a = int(q[r] - base[r]) + c - REACH
                lo = int(p[r]) + c - REACH - FILL - SHIFT
                if _aligned(items.flat[base[r] + a : base[r] + a + length], train[max(lo, 0) : lo + length + 2 * (FILL + SHIFT)], {x - a for x in items.blanks[k[r]]}, length // tolerance):
                    accept(np.array([r]))
                    break
    for r in np.flatnonzero(~done & short & (near.sum(1) >= items.sizes[k] - items.sizes[k] // tolerance)).tolist():
        n = int(items.sizes[k[r]])
        lo = int(p[r] - (q[r] - base[r])) - FILL - SHIFT
        if _aligned(items.flat[base[r] : base[r] + n], train[max(lo, 0) : lo + n + 2 * (FILL + SHIFT)], items.blanks[k[r]], n // tolerance):
            accept(np.array([r]))


def _aligned(item: np.ndarray, text: np.ndarray, blanks: set[int], most: int) -> bool:
    """Whether some part of ``text`` is ``item`` with at most ``most`` words
    changed, dropped or added; up to ``FILL`` words at a blank are free."""
    t, width = text.tolist(), len(text)
    row = [0] * (width + 1)
    for i, w in enumerate(item.tolist()):
        if i in blanks:
            # the words of the filled blank
            row = [min(row[max(0, j - FILL) : j + 1]) for j in range(width + 1)]
        new = [row[0] + 1]
        for j in range(1, width + 1):
            new.append(min(row[j - 1] + (t[j - 1] != w), row[j] + 1, new[j - 1] + 1))
        row = new
        if min(row) > most:
            return False
    return min(row) <= most


def leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, item_id, doc_word, item_word, n_words): the texts of ``df`` that
    hold all words of an item's text, or an unbroken stretch of 20 of them, in
    order, where up to one word in eight may differ; with the place and length
    of the longest verbatim match.

    Case, marks, spacing, invisible characters and a filled blank (``_``) make
    no difference. Each item id of a text counts. Items or texts that are null
    or without words are in nothing; repeated rows count once.
    """
    spark = df.sparkSession
    slim = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null"))
    kind, item_kind = df.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    clean = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null").distinct()
    schema = f"id {kind}, item {item_kind}, doc_word int, item_word int, n_words int"
    blocks = [spark.sparkContext.broadcast(Items(rows)) for rows in _blocks(clean, block_words)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", 1 << 22):
            ids, shard = frame["id"].tolist(), Shard(frame["text"].tolist())
            for block in blocks:
                own = block.value
                out = [(ids[t], i, x, y, n) for t, k, x, y, n in scan(own, shard) for i in own.ids[k]]
                yield pd.DataFrame(out, columns=["id", "item", "doc_word", "item_word", "n_words"])
                if len(blocks) > 1:
                    # of many blocks a worker keeps none but the one at hand; the file stays on its disk
                    vars(block).pop("_value", None)

    result = slim.mapInPandas(run, schema) if blocks else spark.createDataFrame([], schema)
    best = result.groupBy("id", "item").agg(F.max(F.struct("n_words", "doc_word", "item_word")).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "m.doc_word", "m.item_word", "m.n_words")


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_words`` words, read one at a time."""
    rows, size = [], 0
    for item, text in items.orderBy("item").toLocalIterator():
        rows.append((item, text))
        size += len(text) // 4 + 1
        if size >= block_words:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def without_leaks(df: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``df`` without the rows whose id is in ``found``; null ids stay."""
    return df.join(found.select(id_col).distinct(), id_col, "left_anti")
