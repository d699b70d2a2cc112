"""Languages of documents and of the segments of mixed ones (problem 5).

A linear-chain conditional random field labels each word of a text: features of
a word are its lexical form, prefixes, suffixes and character n-grams, hashed;
transitions are learned apart within a sentence and across its end. Labels and
their probabilities come from forward-backward. It is trained on the clean
sentences of ``lang_samples``, joined at random into code-switched texts.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .common import WORD, labelled_sample, slices
from .mojibake import model as garble_model
from .mojibake import training_texts
from .quality import COMMON, with_kinds
from .tokens import LABEL, LANGUAGE_NAMES

#: Number of hashed features.
FEATURES = 1 << 15

#: Characters without width that may stand inside a word.
INVISIBLE = dict.fromkeys([0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])

HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")

ENDS = re.compile(r"[.!?…\n]+")

#: Words labelled at a time: of longer texts the messages are carried from window to window.
WINDOW = 4096

#: Words of questions and requests, beside the function words.
ASKING = {
    "en": "explain why describe tell me about how would you list what link between which option give write is put answer shorten summarize needs need help",
    "de": "erkläre warum beschreibe was weißt du über schreibe drei sätze braucht hilfe nenne fasse zusammen wie würden welche",
    "fr": "expliquez pourquoi décrivez que savez vous sur écrivez trois phrases besoin aide quelle quel comment résumez donnez",
    "es": "explica por qué describe sabes sobre escribe tres frases necesita ayuda cuál cómo resume dime",
    "it": "spiega perché descrivi cosa sai su scrivi tre frasi ha bisogno aiuto quale come riassumi",
    "pt": "explique por que descreva o você sabe sobre escreva três frases precisa ajuda qual como resuma",
    "nl": "leg uit waarom beschrijf wat weet je over schrijf drie zinnen heeft hulp nodig welke hoe vat samen",
    "ru": "объясните почему опишите что вы знаете напишите три предложения нужна помощь какой как расскажите",
}
LEXICON: dict[str, set[str]] = {}
for _code, _words in [*COMMON.items(), *ASKING.items()]:
    for _word in _words.split():
        LEXICON.setdefault(_word, set()).add(_code)


@lru_cache(maxsize=200_000)
def features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word."""
    if word.isdigit():
        return ()
    edged = f"<{word}>"
    names = {f"w{word}"}
    names |= {f"p{word[:k]}" for k in (1, 2, 3, 4)} | {f"s{word[-k:]}" for k in (1, 2, 3, 4)}
    names |= {edged[i : i + k] for k in (2, 3, 4) for i in range(len(edged) - k + 1)}
    names |= {f"lexicon {code}" for code in LEXICON.get(word, ())}
    if not word.isascii():
        names |= {f"c{c}" for c in word if c > "\x7f"}
        if any("Ѐ" <= c <= "ӿ" for c in word):
            names.add("cyrillic")
    return tuple(crc32(n.encode()) % FEATURES for n in sorted(names))


def units(text: str) -> tuple[list[str], np.ndarray]:
    """Lower-case words of a text, and for each whether a sentence ends before it."""
    if not text.isascii():
        if HIDDEN.search(text):
            text = text.translate(INVISIBLE)
        text = unicodedata.normalize("NFC", text)
    if "&" in text:
        text = html.unescape(text)
    found: list[str] = []
    begins = []
    for sentence in ENDS.split(text.lower()):
        if part := WORD.findall(sentence):
            begins.append(len(found))
            found += part
    starts = np.zeros(len(found), bool)
    starts[begins] = True
    return found, starts


class LanguageModel:
    """The trained field: emissions of words and two transition matrices.

    It is trained on ``texts`` synthetic texts of two to five sentences, or on
    as many more as it takes until every sentence of ``rows`` is in one.
    """

    def __init__(self, rows: list[tuple[str, str]], seed: int = 7, rounds: int = 50, texts: int = 320):
        if not rows:
            raise ValueError("no labelled sentences to train on")
        self.languages = sorted({lang for lang, _ in rows})
        self.weights = np.zeros((FEATURES, len(self.languages)))
        self.steps = np.zeros((2, len(self.languages), len(self.languages)))
        self._train(rows, seed, rounds, texts)
        self.weights = self.weights.astype(np.float32)
        self.steps = self.steps.astype(np.float32)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.languages)), np.float32)

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "weights": self.weights, "steps": self.steps}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._forget()

    def _train(self, rows: list[tuple[str, str]], seed: int, rounds: int, least: int) -> None:
        rng = np.random.default_rng(seed)
        by = {k: [units(t)[0] for g, t in rows if g == k] for k in self.languages}
        # a language's sentences come in a new order each time that all have been drawn
        orders: list[list[int]] = [[] for _ in self.languages]
        unused = len(rows)
        drawn = [0] * len(self.languages)
        texts = []
        while len(texts) < least or unused:
            seq: list[tuple[list[str], int]] = []
            lang = int(rng.integers(len(self.languages)))
            for _ in range(int(rng.integers(2, 6))):
                if rng.random() < 0.25:
                    lang = int(rng.integers(len(self.languages)))
                pool = by[self.languages[lang]]
                orders[lang] = orders[lang] or rng.permutation(len(pool)).tolist()
                seq.append((pool[orders[lang].pop()], lang))
                unused -= drawn[lang] < len(pool)
                drawn[lang] += 1
            ws = [w for s, _ in seq for w in s]
            ys = [y for s, y in seq for _ in s]
            es = [k == 0 for s, _ in seq for k in range(len(s))]
            texts.append((ws, np.array(ys), np.array(es)))
        vocabulary = sorted({w for ws, _, _ in texts for w in ws})
        index = {w: k for k, w in enumerate(vocabulary)}
        feats = [features(w) for w in vocabulary]
        owner = np.repeat(np.arange(len(vocabulary)), [len(f) for f in feats])
        flat = np.array([x for f in feats for x in f])
        size = max(len(ws) for ws, _, _ in texts)
        n, k = len(texts), len(self.languages)
        at = np.zeros((n, size), int)
        gold = np.zeros((n, size), int)
        starts = np.zeros((n, size), bool)
        mask = np.zeros((n, size), bool)
        for r, (ws, ys, es) in enumerate(texts):
            at[r, : len(ws)], gold[r, : len(ws)], starts[r, : len(ws)], mask[r, : len(ws)] = [index[w] for w in ws], ys, es, True
        square = np.full(self.weights.shape, 1e-6)
        square_t = np.full(self.steps.shape, 1e-6)
        used, place = np.unique(flat, return_inverse=True)
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(len(used)))
        heads = np.searchsorted(owner, np.arange(len(vocabulary)))
        some = np.bincount(owner, minlength=len(vocabulary)) > 0
        for _ in range(rounds):
            emission = np.zeros((len(vocabulary), k))
            emission[some] = np.add.reduceat(self.weights[flat], heads[some])
            prob, pair = self.marginals(emission[at], starts, mask, pairs=True)
            error = np.where(mask[..., None], (np.arange(k) == gold[..., None]) - prob, 0)
            by_word = np.stack([np.bincount(at.ravel(), error[..., c].ravel(), len(vocabulary)) for c in range(k)], 1)
            gradient = np.add.reduceat(by_word[owner][order], bounds) - 0.02 * self.weights[used]
            square[used] += gradient**2
            self.weights[used] += 0.3 * gradient / np.sqrt(square[used])
            for kind in (0, 1):
                here = mask[:, 1:] & (starts[:, 1:] == bool(kind))
                seen = np.zeros((k, k))
                np.add.at(seen, (gold[:, :-1][here], gold[:, 1:][here]), 1)
                g = seen - pair[kind] - 0.02 * self.steps[kind]
                square_t[kind] += g**2
                self.steps[kind] += 0.3 * g / np.sqrt(square_t[kind])

    def _factors(self, emission: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.exp(emission - emission.max(-1, keepdims=True)), np.exp(self.steps - self.steps.max(axis=(1, 2), keepdims=True))

    def marginals(self, emission: np.ndarray, starts: np.ndarray, mask: np.ndarray, pairs: bool = False, edges: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        """Forward-backward over texts padded to one length: (texts, words,
        languages) probabilities, and expected transitions of both kinds.

        ``edges`` are messages for parts of longer texts: whether words come
        before, the forward message of the word before, and the backward
        message of the last word.
        """
        n, size, k = emission.shape
        local, moves = self._factors(emission)
        forward = np.empty((n, size, k), local.dtype)
        state = local[:, 0]
        ending = np.full((n, k), 1.0 / k, local.dtype)
        if edges is not None:
            inner, before, ending = edges
            carried = np.where(starts[:, 0, None], before @ moves[1], before @ moves[0])
            state = np.where(inner[:, None], carried, 1.0) * state
        state = forward[:, 0] = state / state.sum(1, keepdims=True)
        for t in range(1, size):
            crossed = starts[:, t, None]
            new = np.where(crossed, state @ moves[1], state @ moves[0]) * local[:, t]
            new /= new.sum(1, keepdims=True)
            state = forward[:, t] = np.where(mask[:, t, None], new, state)
        state = ending
        backward = np.repeat(ending[:, None], size, 1).astype(local.dtype)
        expected = np.zeros((2, k, k))
        for t in range(size - 2, -1, -1):
            carried = local[:, t + 1] * state
            crossed, live = starts[:, t + 1, None], mask[:, t + 1, None]
            if pairs:
                for kind in (0, 1):
                    joint = forward[:, t, :, None] * moves[kind] * carried[:, None, :]
                    joint /= joint.sum((1, 2), keepdims=True)
                    expected[kind] += joint[(mask[:, t + 1]) & (starts[:, t + 1] == bool(kind))].sum(0)
            new = np.where(crossed, carried @ moves[1].T, carried @ moves[0].T)
            new /= new.sum(1, keepdims=True)
            state = backward[:, t] = np.where(live, new, state)
        prob = forward * backward
        prob /= prob.sum(2, keepdims=True)
        return (prob, expected) if pairs else prob

    def _messages(self, found: list[str], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(forward message into, backward message at the end of) each window of
        a long text. A window acts on messages as a matrix, the product of its
        words' factors; the matrices of all windows are made side by side, and
        then the messages pass through them one after the other."""
        k, n = len(self.languages), len(found)
        count = -(-n // WINDOW)
        through = np.empty((count, k, k))
        for first in range(0, count, 32):
            rows = range(first, min(first + 32, count))
            emission = np.zeros((len(rows), WINDOW, k), np.float32)
            begins, live = np.zeros((len(rows), WINDOW), int), np.zeros((len(rows), WINDOW), bool)
            for r, w in enumerate(rows):
                a, b = w * WINDOW, min(n, (w + 1) * WINDOW)
                emission[r, : b - a], begins[r, : b - a], live[r, : b - a] = self.emissions(found[a:b]), starts[a:b], True
            local, moves = self._factors(emission)
            state = np.repeat(np.eye(k)[None], len(rows), 0)
            for t in range(WINDOW):
                new = (state @ moves[begins[:, t]]) * local[:, t, None, :]
                if first == t == 0:
                    new[0] = state[0] * local[0, 0]  # nothing comes before the first word
                new /= new.sum((1, 2), keepdims=True)
                state = np.where(live[:, t, None, None], new, state)
            through[rows.start : rows.stop] = state
        into, back = np.ones((count, k)), np.ones((count, k))
        for w in range(1, count):
            into[w] = into[w - 1] @ through[w - 1]
            into[w] /= into[w].sum()
        for w in range(count - 2, -1, -1):
            back[w] = through[w + 1] @ back[w + 1]
            back[w] /= back[w].sum()
        return into, back

    def emissions(self, found: list[str]) -> np.ndarray:
        if len(self.index) > 500_000:
            self._forget()
        index = self.index
        try:
            return self.rows[[index[w] for w in found]]
        except KeyError:
            for w in found:
                if w not in index:
                    at = len(index)
                    if at == len(self.rows):
                        self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                    if hashed := list(features(w)):
                        self.rows[at] = self.weights[hashed].sum(0)
                    index[w] = at
            return self.rows[[index[w] for w in found]]

    def guess(self, found: list[str]) -> tuple[int, float]:
        """Language of a short text as a whole, by its emissions alone: (index, probability)."""
        total = self.emissions(found).sum(0)
        p = np.exp(total - total.max())
        p /= p.sum()
        return int(p.argmax()), float(p.max())

    def label(self, texts: list[tuple[list[str], np.ndarray]]) -> list[np.ndarray]:
        """(words, languages) probabilities of each text, whatever its length:
        those of forward-backward over all its words."""
        k = len(self.languages)
        pieces = [(i, a, min(len(found), a + WINDOW)) for i, (found, _) in enumerate(texts) for a in range(0, len(found), WINDOW)]
        long = {i: self._messages(*texts[i]) for i in {i for i, a, _ in pieces if a}}
        result = [np.zeros((len(found), k), np.float32) for found, _ in texts]
        pieces.sort(key=lambda p: p[2] - p[1])
        start = 0
        while start < len(pieces):
            # padded blocks of like lengths, about a quarter of a million words each at most
            end = start + 1
            while end < len(pieces) and end - start < 2048 and (end + 1 - start) * (pieces[end][2] - pieces[end][1]) <= 1 << 18:
                end += 1
            block = pieces[start:end]
            size = max(b - a for _, a, b in block)
            emission = np.zeros((len(block), size, k), np.float32)
            starts, mask = np.zeros((len(block), size), bool), np.zeros((len(block), size), bool)
            inner, before, after = np.zeros(len(block), bool), np.ones((len(block), k)), np.ones((len(block), k))
            for r, (i, a, b) in enumerate(block):
                emission[r, : b - a] = self.emissions(texts[i][0][a:b])
                starts[r, : b - a] = texts[i][1][a:b]
                mask[r, : b - a] = True
                if i in long:
                    inner[r], before[r], after[r] = a > 0, long[i][0][a // WINDOW], long[i][1][a // WINDOW]
            prob = self.marginals(emission, starts, mask, edges=(inner, before, after) if long else None)
            for r, (i, a, b) in enumerate(block):
                result[i][a:b] = prob[r, : b - a]
            start = end
        return result


@lru_cache(maxsize=2)
def language_model(rows: tuple[tuple[str, str], ...]) -> LanguageModel:
    return LanguageModel(list(rows))


def training_rows(samples: DataFrame, per_language: int = 500) -> tuple[tuple[str, str], ...]:
    """The labelled sentences to train on: at most ``per_language`` of each language."""
    return tuple(labelled_sample(samples, per_language))


def trained_field(samples: DataFrame) -> Broadcast:
    """The field, trained once on the driver and broadcast: its size is that of
    its hashed features, whatever the corpus."""
    return samples.sparkSession.sparkContext.broadcast(language_model(training_rows(samples)))


def label_code(label: str | None) -> str | None:
    """Two-letter code of a delivered label, by the rule of ``tokens.lang_key``."""
    m = re.fullmatch(LABEL, (label or "").strip().lower())
    return next((code for code, names in LANGUAGE_NAMES.items() if m and m[1] in names), None)


def segments(found: list[str], prob: np.ndarray, languages: list[str], least: int = 5) -> list[tuple[int, int, str, float]]:
    """(first word, end, language, confidence): runs of one language. A run of
    fewer than ``least`` words is no segment: it joins the run before it, with
    that run's language, and a short first run the one after it."""
    if not len(found):
        return []
    best = prob.argmax(1)
    cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
    runs: list[list[int]] = []
    for a, b in zip(cuts, cuts[1:]):
        lang = int(best[a])
        if runs and (runs[-1][2] == lang or b - a < least):
            runs[-1][1] = b
        elif runs and runs[-1][1] - runs[-1][0] < least:
            runs[-1][1:] = [b, lang]
        else:
            runs.append([a, b, lang])
    return [(a, b, languages[k], float(prob[a:b, k].mean())) for a, b, k in runs]


def mixture(found: list[str], starts: np.ndarray, prob: np.ndarray, languages: list[str], least: int = 20, share: float = 0.2, inner: int = 5) -> list[tuple[str, int, float]]:
    """(language, words, confidence) of the languages that hold ``least`` words
    and ``share`` of the text, else of the one with most words.

    A sentence counts for the language with most of its probability; one in
    which two languages have ``inner`` words each, the likeliest of each word,
    counts by its segments.
    """
    if not len(found):
        return []
    k = len(languages)
    cuts = np.flatnonzero(starts)
    if not len(cuts) or cuts[0]:
        cuts = np.concatenate([[0], cuts])
    own = np.add.reduceat(np.arange(k) == prob.argmax(1)[:, None], cuts, axis=0, dtype=np.int64)
    switched = np.flatnonzero(np.sort(own, axis=1)[:, -2] >= inner)
    if len(switched):
        ends = np.append(cuts, len(found))
        more = [a + x for s in switched for a, b in [(ends[s], ends[s + 1])] for x, *_ in segments(found[a:b], prob[a:b], languages, inner) if x]
        cuts = np.unique(np.concatenate([cuts, np.array(more, cuts.dtype)]))
    sums = np.add.reduceat(prob, cuts, axis=0)
    sizes = np.diff(np.append(cuts, len(found)))
    best = sums.argmax(1)
    n = np.bincount(best, sizes, k)
    sure = np.bincount(best, sums[np.arange(len(best)), best], k) / np.maximum(n, 1)
    full = [x for x in range(k) if n[x] >= least and n[x] >= share * len(found)]
    return [(languages[x], int(n[x]), float(sure[x])) for x in (full if len(full) > 1 else [int(n.argmax())])]


def _prepared(df: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> tuple[DataFrame, str]:
    label = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    return spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), label.alias("label"))).filter("id is not null"), df.schema[id_col].dataType.simpleString()


def document_languages(df: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, label, lang, n_words, confidence): the languages of each text, one
    row each where it mixes several, with the delivered label as a code.

    A text without words (null, empty, marks only) has one row with a null
    language and confidence 0; rows with a null id have none.
    """
    trained = trained_field(samples)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = trained.value
        for frame in slices(frames, "text", 1 << 22):
            texts = [units(t or "") for t in frame["text"]]
            rows = []
            for i, label, (found, starts), prob in zip(frame["id"], frame["label"], texts, field.label(texts)):
                for lang, n, sure in mixture(found, starts, prob, field.languages) or [(None, 0, 0.0)]:
                    rows.append((i, label_code(label), lang, n, sure))
            yield pd.DataFrame(rows, columns=["id", "label", "lang", "n_words", "confidence"])

    slim, kind = _prepared(df, id_col, text_col, lang_col)
    return slim.mapInPandas(run, f"id {kind}, label string, lang string, n_words int, confidence double").withColumnRenamed("id", id_col)


def language_segments(df: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, segment, first_word, n_words, lang, confidence) of the runs of one
    language; texts without words have no row."""
    trained = trained_field(samples)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = trained.value
        for frame in slices(frames, "text", 1 << 22):
            texts = [units(t or "") for t in frame["text"]]
            rows = [
                (i, k, a, b - a, lang, sure)
                for i, (found, _), prob in zip(frame["id"], texts, field.label(texts))
                for k, (a, b, lang, sure) in enumerate(segments(found, prob, field.languages))
            ]
            yield pd.DataFrame(rows, columns=["id", "segment", "first_word", "n_words", "lang", "confidence"])

    slim, kind = _prepared(df, id_col, text_col, None)
    return slim.mapInPandas(run, f"id {kind}, segment int, first_word int, n_words int, lang string, confidence double").withColumnRenamed("id", id_col)


def corrections(df: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = 20) -> DataFrame:
    """(id, lang): running texts of ``least`` words or more whose label is
    missing or wrong, with the right code; of mixed texts each language,
    whatever the label. Lists, tables, junk and wrongly decoded texts are left
    out; null and short ones have no row."""
    trained, clean = trained_field(samples), training_texts(samples)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field, garbled = trained.value, garble_model(clean)
        for frame in slices(frames, "text", 1 << 22):
            frame = frame[frame["text"].notna()]
            texts = [units(t) for t in frame["text"]]
            rows = []
            for i, text, label, (found, starts), prob in zip(frame["id"], frame["text"], frame["label"], texts, field.label(texts)):
                if len(found) < least:
                    continue
                langs = [x[0] for x in mixture(found, starts, prob, field.languages, least)]
                if len(langs) == 1 and label_code(label) == langs[0]:
                    continue
                if not garbled.judge(text)[0]:
                    rows.append((i, text, langs))
            yield pd.DataFrame(rows, columns=["id", "text", "langs"])

    slim, kind = _prepared(df, id_col, text_col, lang_col)
    # the kinds of those texts alone that would have a row
    wrong = with_kinds(slim.mapInPandas(run, f"id {kind}, text string, langs array<string>"))
    # the outer form, as the plain one adds a filter that would compute the kinds again
    out = wrong.select("id", F.explode_outer(F.when(F.col("kind").isNull(), F.col("langs"))).alias("lang"))
    return out.filter("lang is not null").withColumnRenamed("id", id_col)
