"""Text decoded with the wrong character encoding (problem 9).

A multinomial classifier over hashed byte bigrams is trained on words garbled
on purpose: each clean word is run through every chain of (true encoding,
wrong encoding), and through decoders that lose characters. The class of a word
decides: where sound text is the likeliest, the word is left alone; else the
chain is inverted, which must decode strictly and give only characters that
sound text has; where it fails this, chains that are as good as tied with it,
and then those of the text's other words, are inverted. Single-byte chains, which always decode, are classes of whole
lines. Words are judged once per distinct word of a batch.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .common import labelled_sample, slices

#: Number of hashed byte bigrams.
FEATURES = 1 << 14

#: Chains: (steps of (true encoding, wrong encoding), applied in order). Those
#: of multi-byte text prove themselves by strict decoding; those of single-byte
#: text always decode, so they need the classifier's margin over a whole text.
MULTI = [((("utf-8", wrong),)) for wrong in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "koi8-r", "cp866", "iso8859-2", "mac_cyrillic", "iso8859-15", "cp1254", "iso8859-5")]
DOUBLE = [(("utf-8", a), ("utf-8", b)) for a in ("cp1252", "latin-1") for b in ("cp1252", "latin-1")]
SINGLE = [((true, wrong),) for true, wrong in (("koi8-r", "latin-1"), ("koi8-r", "cp1252"), ("cp1251", "latin-1"), ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "latin-1"), ("iso8859-5", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_roman"), ("koi8-r", "mac_roman"), ("cp866", "cp1252"), ("iso8859-5", "latin-1"))]
#: Typographic bytes read as controls: the letters stay, so only those words change.
CONTROLS = [(("cp1252", "latin-1"),)]
#: Decoding that lost characters cannot be inverted: (true encoding, decoder with replacement).
LOST = (("lost", "utf-8"),)
CHAINS = [*MULTI, *DOUBLE, *CONTROLS, LOST, *SINGLE]
WORDWISE = [k for k, chain in enumerate(CHAINS, 1) if chain not in SINGLE]
LINEWISE = [k for k, chain in enumerate(CHAINS, 1) if chain in SINGLE]
#: What lost or misread characters leave behind.
DAMAGE = re.compile("[\ufffd\x80-\x84\x86-\x9f]")

#: Typographic marks and symbols that sound text may hold.
MARKS = "’‘“”„‚«»‹›–—…•·¿¡©®™°±µ€£¥§¶½¼¾ªº№×÷¹²³†‡¢"

#: Typographic training strings: marks as they stand at words in running text.
PHRASES = ("“It’s", "isn’t", "it?”", "–", "—", "café,", "£3", "naïve,", "crème", "l’école", "d’œuf", "€5", "12 °C", "«bien»", "„gut“", "…", "Señor", "¿Qué", "¡Hola", "ça", "À", "Ünder", "Ärzte", "Öl", "Übung", "É", "È", "à", "è", "ù", "ò", "ì", "ñ", "ß", "Ñ", "Ç", "’s", "’s.", "aujourd’hui")

#: The letters of the languages at hand beyond ASCII.
LETTERS = "àáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿßабвгдежзийклмнопрстуфхцчшщъыьэюяё"

#: Log odds against sound text that the words of a text, or of a line, must reach together.
ODDS = 8.0
#: Log odds between chains that are as good as tied: many code pages share most characters.
TIED = 4.0

SPACE = re.compile(r"[ \t\r\n]+")
ASCII_LETTER = re.compile(r"[A-Za-z]")
CYRILLIC = re.compile("[\u0400-\u04ff]")


def doubtful(text: str) -> list[str]:
    """The blank-separated tokens with other than ASCII characters or entities."""
    if text.isascii() and "&" not in text:
        return []
    return [w for w in SPACE.split(text) if not w.isascii() or "&" in w and ";" in w]



def _unescaped(word: str) -> str:
    return html.unescape(word) if "&" in word else word


@lru_cache(maxsize=64)
def _tables(name: str) -> tuple[dict[int, str], dict[str, int]]:
    """Byte to character and back; bytes a code page leaves undefined are the
    control characters of the same number, as decoders in the wild take them."""
    there = {}
    for b in range(256):
        try:
            there[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            there[b] = chr(b)
    return there, {c: b for b, c in there.items()}


def garble(text: str, chain: tuple) -> str | None:
    """``text`` after a chain; None where an encoding lacks one of its characters."""
    for true, wrong in chain:
        try:
            raw = text.encode(true)
        except UnicodeEncodeError:
            return None
        there = _tables(wrong)[0]
        text = "".join(there[b] for b in raw)
    return text


def restore(text: str, chain: tuple) -> str | None:
    """The text before ``chain``; None where it does not decode strictly."""
    for true, wrong in reversed(chain):
        back = _tables(wrong)[1]
        try:
            raw = bytes(back[c] for c in text)
            text = raw.decode(true)
        except (KeyError, UnicodeDecodeError):
            return None
    return text


def _bigrams(text: str) -> np.ndarray:
    raw = np.frombuffer(b" " + text.encode("utf-8", "replace") + b" ", np.uint8).astype(np.int64)
    return ((raw[:-1] << 8 | raw[1:]) * 0x9E3779B1 >> 11) % FEATURES


def _lossy(text: str) -> list[str]:
    """``text`` as decoders leave it that lose characters."""
    found = []
    for true in ("cp1252", "cp1251", "koi8-r", "cp850", "mac_roman"):
        try:
            found.append(text.encode(true).decode("utf-8", "replace"))
        except UnicodeEncodeError:
            continue
    bad = garble(text, MULTI[1]) or ""
    # a control that has lost its neighbours
    found += [bad[max(0, k - 1)] + c for k, c in enumerate(bad) if DAMAGE.match(c)]
    return [f for f in found if f != text and DAMAGE.search(f)]


def _order(word: str) -> int:
    """A seeded order of words."""
    return crc32(f"7|{word}".encode("utf-8", "replace"))


class GarbleModel:
    """Multinomial Bayes over hashed byte bigrams; class 0 is sound text, class
    k the chain ``CHAINS[k - 1]``."""

    def __init__(self, clean: list[str], limit: int = 4000):
        """``clean``: sound texts; at most ``limit`` of their distinct words with
        other than ASCII characters are garbled for training: half of them
        Cyrillic where there are as many, each half the first in a seeded order."""
        own = sorted({w for t in clean for w in doubtful(unicodedata.normalize("NFC", t))}, key=_order)
        cyrillic = [w for w in own if CYRILLIC.search(w)]
        other = [w for w in own if not CYRILLIC.search(w)]
        most = max(limit // 2, limit - len(cyrillic))
        other = other[:most]
        own = other + cyrillic[: limit - len(other)] + list(PHRASES)
        forms = [(f, weight) for w in own for f, weight in ((w, 1.0), (w.capitalize(), 0.3), (w.upper(), 0.05))]
        # every letter and mark at hand, so that none is unseen
        forms += [(f"a{c}e" if c.islower() else c, 0.1) for c in LETTERS + LETTERS.upper() + MARKS]
        self.alphabet = {c for w, _ in forms for c in w if c > "\x7f"}
        counts = np.full((len(CHAINS) + 1, FEATURES), 0.05)
        for w, weight in forms:
            np.add.at(counts[0], _bigrams(w), weight)
            for k, chain in enumerate(CHAINS, 1):
                if chain in SINGLE and not CYRILLIC.search(w):
                    continue
                if chain is LOST:
                    for bad in _lossy(w):
                        np.add.at(counts[k], _bigrams(bad), weight)
                    continue
                bad = garble(w, chain)
                if bad is not None and bad != w:
                    np.add.at(counts[k], _bigrams(bad), weight)
        self.weights = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
        self.known: dict[str, tuple[str | None, int, float]] = {}
        self.alone: dict[str, dict[int, tuple[float, str | None]]] = {}

    def sound(self, text: str) -> bool:
        return all(c <= "\x7f" and (c >= " " or c in "\t\r\n") or c in self.alphabet for c in text)

    def scores(self, word: str) -> np.ndarray:
        odd = "".join(re.findall(r".?[^\x00-\x7f]+.?", word))
        return self.weights[:, _bigrams(odd)].sum(1)

    def word(self, word: str) -> tuple[str | None, int, float]:
        """(restored word or None, class, log odds against sound text) by the
        likeliest class of the word, or one as good as tied with it: 0 for a
        sound one, None where no such chain decodes. A lost word comes back as it is."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[word] = self._word(_unescaped(word))
        return found

    def _word(self, plain: str) -> tuple[str | None, int, float]:
        if plain.isascii():
            return None, 0, 0.0
        scores = self.scores(plain)
        order = sorted((0, *WORDWISE), key=lambda k: -scores[k])
        best = order[0]
        if best:
            for k in order:
                if scores[k] < scores[best] - TIED or scores[k] <= scores[0]:
                    break
                back = self.inverted(plain, k)
                if back is not None:
                    return back, k, float(scores[k] - scores[0])
        # no sound word and no chain, but damage to see: something was lost
        if best and DAMAGE.search(plain):
            return plain, CHAINS.index(LOST) + 1, float(scores[best] - scores[0])
        return None, best, float(scores[best] - scores[0])

    def inverted(self, plain: str, k: int) -> str | None:
        """A word before chain k: strictly decoded, shorter where bytes became
        characters, and sound; of class ``LOST`` the word itself, where it shows the damage."""
        chain = CHAINS[k - 1]
        if chain is LOST:
            return plain if DAMAGE.search(plain) else None
        back = restore(plain, chain)
        if back is None or not self.sound(back) or re.search(r"(?<=\S)[¡¿]", back):
            return None
        return back if len(back) < len(plain) or chain in CONTROLS and DAMAGE.search(plain) else None

    def single(self, word: str) -> dict[int, tuple[float, str | None]]:
        """By single-byte chain: the log odds against the sound reading, and the
        restored word; a word that does not become Cyrillic alone speaks against
        the chain."""
        found = self.alone.get(word)
        if found is None:
            if len(self.alone) > 200_000:
                self.alone.clear()
            found = self.alone[word] = {}
            scores = self.scores(word)
            for k in LINEWISE:
                back = restore(word, CHAINS[k - 1])
                letters = [c for c in back or "" if c.isalpha()]
                shape = "".join(letters)
                if back is None or not self.sound(back) or any(c < "Ѐ" for c in letters) or re.search(r"(.)\1\1", shape) or not (shape.islower() or shape.isupper() or shape.istitle()):
                    found[k] = (-8.0, None)
                elif len(set(letters)) < 2 or sum(a != b for a, b in zip(word, back)) < 0.6 * len(letters):
                    found[k] = (0.0, back)
                else:
                    found[k] = (float(scores[k] - scores[0]), back)
        return found

    def lines(self, text: str) -> tuple[dict[str, str], dict[int, int]]:
        """Restored words of the lines under a single-byte chain, and the
        number of words under each: such a chain always decodes, so its log
        odds over all of a line's words in question must reach ``ODDS``, from
        two words at least."""
        fixed: dict[str, str] = {}
        used: dict[int, int] = {}
        for line in re.split(r"[\r\n]+", text):
            tokens = doubtful(line)
            # a word with Latin letters cannot become Cyrillic alone
            if len(tokens) < 2 or 2 * sum(not ASCII_LETTER.search(w) for w in tokens) < len(tokens):
                continue
            read = [self.single(w) for w in tokens]
            best, total = 0, ODDS
            for k in read[0]:
                odds = sum(r[k][0] for r in read)
                if odds >= total and sum(r[k][0] > 0 for r in read) >= max(2, 0.5 * len(read)):
                    best, total = k, odds
            if best:
                fixed |= {w: r[best][1] for w, r in zip(tokens, read) if r[best][1]}
                used[best] = used.get(best, 0) + len(tokens)
        return fixed, used

    def judge(self, text: str) -> tuple[bool, dict[str, str], int]:
        """(garbled, restored word of each garbled word, number of the commonest chain).

        The words that the classifier gives to a chain, and that decode strictly
        by it, must reach ``ODDS`` together, as one word mostly does alone; so
        must those that have lost characters, which are no restored words. A
        word whose own chain does not decode is then read by the chains found in
        the text. Single-byte chains: see ``lines``.
        """
        fixed: dict[str, str] = {}
        used: dict[int, int] = {}
        open_: list[str] = []
        total = 0.0
        for w in doubtful(text):
            back, k, odds = self.word(w)
            if back is None:
                if k:
                    open_.append(w)
                continue
            total += odds
            used[k] = used.get(k, 0) + 1
            if CHAINS[k - 1] is not LOST:
                fixed[w] = back
        if total < ODDS:
            fixed, used = self.lines(text)
        else:
            chains = sorted(used, key=lambda k: -used[k])
            for w in open_:
                back, k = next(((b, k) for k in chains if (b := self.inverted(_unescaped(w), k)) is not None), (None, 0))
                if k and CHAINS[k - 1] is not LOST:
                    fixed[w] = back
                if k:
                    used[k] += 1
        return bool(used), fixed, max(used, key=lambda k: used[k], default=0)


@lru_cache(maxsize=2)
def model(clean: tuple[str, ...]) -> GarbleModel:
    return GarbleModel(list(clean))


def repair_text(text: str, fixed: dict[str, str]) -> str:
    return re.sub(r"[^ \t\r\n]+", lambda m: fixed.get(m[0], m[0]), text) if fixed else text


def training_texts(samples: DataFrame, per_language: int = 500) -> tuple[str, ...]:
    """Sound texts to train on: those of ``labelled_sample``."""
    return tuple(t for _, t in labelled_sample(samples, per_language))


def repairs(df: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chain, n_words, restored, text): the rows with wrongly decoded text.

    ``samples`` holds sound texts (column ``text``). ``restored`` says whether
    no sign of damage is left. Null and empty texts are sound, rows with a null id have no row; each row of
    ``df`` is judged alone, repeated ones each.
    """
    clean = training_texts(samples)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = model(clean)
        for frame in slices(frames, "text", 1 << 24):
            rows = []
            for i, text in zip(frame["id"], frame["text"]):
                bad, fixed, k = judge.judge(text)
                if bad:
                    new = repair_text(text, fixed)
                    chain = "+".join(f"{a}/{b}" for a, b in CHAINS[k - 1])
                    rows.append((i, chain, len(fixed), not judge.judge(new)[0], new))
            yield pd.DataFrame(rows, columns=["id", "chain", "n_words", "restored", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    suspects = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).filter(F.col("id").isNotNull() & F.col("text").rlike("[^\\x00-\\x7F]|&#?[0-9A-Za-z]"))
    return suspects.mapInPandas(run, f"id {kind}, chain string, n_words int, restored boolean, text string").withColumnRenamed("id", id_col)
