"""Broken prompt and response pairs (problem 6).

Each pair is judged by, in this order: emptiness and placeholders, a grammar of
refusals, greedy string tiling against instruction and input, the scripts and
then the languages of instruction and output, and a pushdown parser of fences,
brackets, quotations, lists and markup for truncation. The first that holds is
the pair's defect.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .common import WORD, slices, words
from .langid import HIDDEN, INVISIBLE, LEXICON, LanguageModel, trained_field

# ------------------------------------------------------------------- empty

#: What stands for an answer that is not there.
PLACEHOLDERS = {"", "nan", "none", "null", "nil", "n/a", "na", "tbd", "todo", "noinput", "nooutput", "no output", "no input", "no answer", "no response", "empty", "undefined", "output", "response", "answer", "placeholder", "blank", "missing", "not available", "insert answer here"}


_LONGEST = max(map(len, PLACEHOLDERS))
_MARKS = "<>[](){}\"'“”`*_-–—.…?!#: \t\r\n "


def is_empty(output: str | None) -> bool:
    if output is None:
        return True
    bare = (output.translate(INVISIBLE) if HIDDEN.search(output) else output).strip().strip(_MARKS)
    # blanks and underscores inside may be several
    return len(bare) <= 4 * _LONGEST and " ".join(bare.lower().replace("_", " ").split()) in PLACEHOLDERS


# ----------------------------------------------------------------- refusal

#: A refusal is: openers, then a declining clause, then at most closing
#: phrases. Each alternative is one of the language's ways to decline.
OPENERS = r"(?:(?:i['’]?m (?:really |very |so )?sorry|i am (?:really |very |so )?sorry|sorry|i apologi[sz]e|my apologies|apologies|unfortunately|regrettably|i['’]?m afraid|i am afraid|i must be honest|thank you for (?:asking|your question)|thanks for asking|as an? (?:ai|assistant|language model|ai language model|ai assistant)[^,.]{0,30})[,.:;]?\s*(?:but|however|that|and)?[,:]?\s*)*"
DECLINE = {
    "en": r"(?:i(?: |(?=['’]))(?:can(?:no|['’])t|can not|could(?:n['’]t| not)|won['’]?t|will not|must decline|have to decline|need to decline|am unable|['’]?m unable|am not able|['’]?m not able|do(?:n['’]t| not) (?:feel comfortable|think i can|have the ability)|['’]d rather not|would rather not|would prefer not|refuse|decline)\b(?! say how)[^.!?]*|(?:it is|it['’]s) not possible for me[^.!?]*|this is (?:something )?(?:i am|i['’]m) (?:unable|not able)[^.!?]*|this is something i (?:can['’]?t|cannot)[^.!?]*|(?:answering|doing|writing) (?:this|that) would (?:go against|violate)[^.!?]*|(?:this|that|your) request (?:goes|is) (?:against|outside)[^.!?]*)",
    "any": r"(?:(?:diese|dieses|cette|ce|esta|este|questa|questo|essa|dit|deze|этот|je|debo|tengo|devo|tenho|ik|ich|должен)\b[^.!?]*\b(?:ablehnen|refuser|décliner|rechazar|declinar|rifiutare|declinare|recusar|afwijzen|weigeren|отклонить|отказать)\b[^.!?]*)",
    "de": r"(?:(?:es )?tut mir leid[^.!?]*|leider (?:kann|darf|bin|ist)[^.!?]*|(?:das|dabei|diese frage)? ?kann ich (?:leider )?(?:nicht|diese)[^.!?]*|ich kann (?:ihnen |dir )?(?:leider |dabei |das |diese frage )*nicht[^.!?]*)",
    "fr": r"(?:(?:je suis |)désolée?[^.!?]*|malheureusement,? je[^.!?]*|je (?:ne peux|ne suis|regrette|crains)[^.!?]*|il m['’]est impossible[^.!?]*)",
    "es": r"(?:lo siento[^.!?]*|(?:lamentablemente|desafortunadamente),? no[^.!?]*|no (?:puedo|me es posible|estoy en)[^.!?]*)",
    "it": r"(?:mi dispiace[^.!?]*|purtroppo,? non[^.!?]*|non (?:posso|sono in grado|mi è possibile)[^.!?]*)",
    "pt": r"(?:(?:desculpe|lamento|sinto muito)[^.!?]*|infelizmente,? não[^.!?]*|não (?:posso|consigo|me é possível)[^.!?]*)",
    "nl": r"(?:(?:het spijt me|sorry)[^.!?]*|helaas (?:kan|ben|is)[^.!?]*|(?:dat|daar|deze vraag) kan ik[^.!?]*(?:niet)[^.!?]*|ik kan (?:u |je |dat |deze vraag |daar |hier )*niet[^.!?]*)",
    "ru": r"(?:(?:извините|простите|к сожалению)[^.!?]*|я не могу[^.!?]*|не могу[^.!?]*)",
}
#: Words that must stand in a Romance or Germanic clause of regret for it to decline.
TASK = re.compile(r"ablehn|refus|déclin|rechaz|declin|rifiut|recus|afwijz|weiger|отклон|отказ|help|answer|assist|provide|do (?:that|this)|fulfil|respond|request|write|unable|able|comfortable|guidelines|possible|decline|rather not|discuss|comply|continue|complete|create|generate|engage|hilf|helfen|helpen|beantwort|antwort|antwoord|bearbeit|möglich|mogelijk|aid|répond|réponse|question|mesure|demande|ayud|respond|pregunta|solicitud|aiut|rispond|domanda|richiesta|ajud|respond|pergunta|pedido|помочь|ответить|вопрос|запрос|выполнить", re.I)
REFUSAL = re.compile("^" + OPENERS + "(?:" + "|".join(DECLINE.values()) + ")", re.I)
CLOSING = re.compile(r"^\s*(?:is there|please (?:ask|try|let|consult)|you (?:may|might|could|can)|i hope|perhaps|maybe|feel free|thank|if you|let me know|instead)", re.I)
LETTER = re.compile(r"\b(?:letter|note|message|apolog|email|e-mail|brief|lettre|carta|lettera|bericht|письмо)", re.I)


OPENING = re.compile("(?:" + OPENERS + ")[.!]?", re.I)
BREAK = re.compile(r"(?<=[.!?])\s+")


def is_refusal(instruction: str, output: str) -> bool:
    """Whether the output declines and does nothing else: each of its sentences
    is read by the grammar, up to the first that is part of no refusal."""
    bare = output.strip().strip("\"“”")
    at = declined = 0
    while at < len(bare):
        end = BREAK.search(bare, at)
        s = bare[at : end.start()] if end else bare[at:]
        if REFUSAL.match(s) and TASK.search(s):
            declined += 1
        elif not CLOSING.match(s) and not OPENING.fullmatch(s):
            return False
        at = end.end() if end else len(bare)
    # an apology that was asked for is an answer
    return declined > 0 and not (LETTER.search(instruction) and re.search(r"\bdear\b|offer|forgive", bare, re.I))


# -------------------------------------------------------------------- copy

#: Labels of prompt templates, which are nobody's answer.
FRAME = re.compile(r"###\s*(?:instruction|input|response)\s*:?|^\s*(?:you asked|question|instruction|input|prompt|user|q|the question is|your request)\s*:|\banswer\s*:\s*$|\bresponse\s*:\s*$", re.I | re.M)
COPYING = re.compile(r"\b(?:repeat|copy|quote|spelling|verbatim|exactly|word for word|as it is|mistake|correct|proofread|wiederhol|zitier|abschreib|répét|recopi|cit|repit|copia|ripet|repet|herhaal|citeer|повтор|цитир|перепиш)", re.I)
OPTIONS = re.compile(r"^\s*\(?[A-Ja-j1-9][).]\s", re.M)


def tiles(a: list[str], b: list[str], least: int = 3) -> list[tuple[int, int, int]]:
    """Greedy string tiling: longest common runs first, each word in one tile;
    (start in a, start in b, length) of the runs of ``least`` words or more.

    The maximal common runs are listed once; one that a longer tile has cut
    into goes back with what is left of it.
    """
    places: dict[tuple[str, ...], list[int]] = {}
    for j in range(len(b) - least + 1):
        places.setdefault(tuple(b[j : j + least]), []).append(j)
    heap: list[tuple[int, int, int]] = []
    for i in range(len(a) - least + 1):
        for j in places.get(tuple(a[i : i + least]), ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue  # inside a run that began before
            k = least
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            heap.append((-k, i, j))
    heapq.heapify(heap)
    free_a, free_b = bytearray(b"\x01") * len(a), bytearray(b"\x01") * len(b)
    found: list[tuple[int, int, int]] = []
    while heap:
        k, i, j = heapq.heappop(heap)
        k = -k
        if all(free_a[i : i + k]) and all(free_b[j : j + k]):
            found.append((i, j, k))
            free_a[i : i + k] = free_b[j : j + k] = bytes(k)
            continue
        start = 0
        for x in range(k + 1):
            if x == k or not (free_a[i + x] and free_b[j + x]):
                if x - start >= least:
                    heapq.heappush(heap, (start - x, i + start, j + start))
                start = x + 1
    return found


def covered(a: list[str], b: list[str]) -> float:
    """Share of ``a`` in tiles with ``b``; short texts must be equal."""
    if not a:
        return 0.0
    if a == b:
        return 1.0
    if len(a) < 3:
        return 0.0
    return sum(n for _, _, n in tiles(a, b)) / len(a)


def is_copy(instruction: str, given: str, output: str) -> bool:
    """Whether the output gives back instruction, input or both and no more."""
    out = words(FRAME.sub(" ", output) if ":" in output or "#" in output else output)
    if not out:
        return bool(FRAME.search(output))
    for k in (2, 3, 4):
        # given back more than once
        if len(out) % k == 0 and out == out[: len(out) // k] * k:
            out = out[: len(out) // k]
    ins, inp = words(instruction), words(given)
    known = {*ins, *inp}
    if sum(w in known for w in out) < 0.85 * len(out):
        return False
    both = ins + inp
    if len(out) >= 3 and covered(out, both) < 0.85:
        return False
    back_ins = len(ins) >= 3 and len(out) >= 0.8 * len(ins) and covered(ins, out) >= 0.8
    back_inp = len(inp) >= 3 and len(out) >= 0.8 * len(inp) and covered(inp, out) >= 0.8
    if back_ins:
        return True
    # the question of a multiple choice without its options
    stem = words(OPTIONS.split(instruction)[0]) if OPTIONS.search(instruction) else []
    if len(stem) >= 4 and len(out) >= 0.8 * len(stem) and covered(stem, out) >= 0.9:
        return True
    return back_inp and not COPYING.search(instruction)


# ---------------------------------------------------------- other language

#: Names of languages as they are asked for, by code.
NAMES = re.compile(r"\b(?:english|german|french|spanish|italian|portuguese|dutch|russian|englisch|deutsch|französisch|spanisch|italienisch|portugiesisch|niederländisch|russisch|anglais|allemand|français|espagnol|italien|portugais|néerlandais|russe|inglés|alemán|francés|español|italiano|portugués|neerlandés|ruso|inglese|tedesco|francese|spagnolo|portoghese|olandese|russo|inglês|alemão|francês|espanhol|português|holandês|engels|duits|frans|spaans|italiaans|portugees|nederlands|russisch|translate|translation|übersetz\w*|tradui\w*|traduc\w*|traduz\w*|tradu[cç]\w*|vertaal\w*|переведи\w*|перевод\w*|английск\w*|немецк\w*|французск\w*|испанск\w*)\b", re.I)
ASKED = re.compile(r"\b(?:in(?:to)?|auf|ins|en|in het|na|in|em|para o|para|al|naar|nach|vers|po)\s+(?:the\s+|das\s+|het\s+)?$", re.I)


def asks_language(instruction: str) -> bool:
    """Whether a language is asked for: a verb of translating, or a language's
    name after a preposition; an adjective elsewhere ("the French map") is none."""
    for m in NAMES.finditer(instruction):
        if re.match(r"trans|übers|tradu|verta|перев", m[0], re.I) or ASKED.search(instruction[: m.start()]) or m.end() >= len(instruction.rstrip(" .:?!")):
            return True
    return False


class _Scores:
    """Scores of words by language: those of the field, and more for a word of
    the lexicon, which weighs in a short request; a last column marks words
    that are no numbers. A word is scored once."""

    def __init__(self, field: LanguageModel):
        self.field = field
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.field.languages) + 1), np.float32)

    def add(self, found: list[str]) -> None:
        new = [w for w in dict.fromkeys(found) if w not in self.index]
        scores = self.field.emissions(new)
        for w, row in zip(new, scores):
            at = len(self.index)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at, :-1] = row
            self.table[at, -1] = not w.isdigit()
            for code in LEXICON.get(w, ()):
                if code in self.field.languages:
                    self.table[at, self.field.languages.index(code)] += 3.0
            self.index[w] = at

    def total(self, found: list[str]) -> list[float]:
        index = self.index
        try:
            at = [index[w] for w in found]
        except KeyError:
            if len(index) > 500_000:
                self.clear()
            self.add(found)
            at = [self.index[w] for w in found]
        return self.table[at].sum(0).tolist()


@lru_cache(maxsize=2)
def _scores(field: LanguageModel) -> _Scores:
    return _Scores(field)


#: Letters by script: (name, class). Others are none.
SCRIPTS = {
    "latin": re.compile("[A-Za-z\u00aa-\u024f\u1e00-\u1eff]"),
    "cyrillic": re.compile("[\u0400-\u052f]"),
    "greek": re.compile("[\u0370-\u03ff\u1f00-\u1fff]"),
    "arabic": re.compile("[\u0600-\u06ff\u0750-\u077f]"),
    "hebrew": re.compile("[\u0590-\u05ff]"),
    "indic": re.compile("[\u0900-\u0dff]"),
    "hangul": re.compile("[\u1100-\u11ff\uac00-\ud7af]"),
    "han": re.compile("[\u3040-\u30ff\u3400-\u9fff]"),
}


def script_of(text: str, share: float = 0.8) -> str | None:
    """The script of ``share`` of a text's letters, four at least; else None."""
    if text.isascii():
        return "latin" if len(SCRIPTS["latin"].findall(text)) >= 4 else None
    counts = {name: len(letters.findall(text)) for name, letters in SCRIPTS.items()}
    total, top = sum(counts.values()), max(counts, key=lambda k: counts[k])
    return top if total >= 4 and counts[top] >= share * total else None


def language_of(field: LanguageModel, text: str, least: int) -> tuple[str | None, float]:
    """(language, probability) of a text of ``least`` words that are no numbers."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text.translate(INVISIBLE) if HIDDEN.search(text) else text)
    found = WORD.findall(text.lower())
    if len(found) < least:
        return None, 0.0
    *scores, n = _scores(field).total(found)
    if n < least:
        return None, 0.0
    top = max(scores)
    return field.languages[scores.index(top)], 1 / sum(math.exp(x - top) for x in scores)


# --------------------------------------------------------------- truncation

PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»"}
TERMINAL = re.compile(r"""[.!?…。:;]["”»’')\]*_`]*$|["”»)\]`*_]$""")
SENTENCE_END = re.compile(r"""[.!?…]["”»’')\]]*(?:\s|$)""")
SIGNED = re.compile(r"^(?:yours|best|kind|regards|sincerely|love|warm|with|mit|cordialement|saludos|atentamente|cordiali|atenciosamente|groet)", re.I)
#: What the parser reads: line ends with the mark of a list item, fences,
#: tags, emphasis, brackets and quotations.
TOKEN = re.compile(r'''(?P<item>(?:^|\n)[ \t]*(?:[-*•–+][ \t]|\(?\w{1,2}[.)][ \t]|\[[ x]?\]))|(?P<line>\n)|(?P<fence>```)|</?(?P<tag>[A-Za-z][A-Za-z0-9]*)[^<>\n]*>|(?P<strong>\*\*(?=\S)|(?<=\S)\*\*)|(?P<mark>["()\[\]{}“”«»])''')
#: Elements of markup that have no end tag.
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source"}
ITEM = "item"
TAGS_AT_END = re.compile(r"(?:\s*</?[A-Za-z][^<>\n]*>)+$")
#: Requests that only sentences answer.
SENTENCES = re.compile(r"\b(?:sentences?|explain|describe|tell me|summari[sz]e|how (?:would|do|does|can)|what do you know|what is the link|shorten|sätzen?|erkläre|beschreibe|phrases|expliquez|décrivez|frases|explica|describe|spiega|descrivi|frasi|explique|descreva|zinnen|leg uit|beschrijf|предложени\w*|объясните|опишите)\b", re.I)


def parse(text: str) -> tuple[list[str], list[str]]:
    """(what is open at the end, list items) by a pushdown parser.

    The stack holds what a fence, bracket, quotation, tag or emphasis still
    waits for, and ``ITEM`` while in a list item, which its line ends. A closing
    mark takes what was opened after its partner with it; one without a partner
    is text, as an apostrophe, the bracket of "a)" and an emoticon are. In a fence only
    its end counts.
    """
    stack: list[str] = []
    items: list[str] = []
    begin = 0

    def leave(at: int) -> None:
        if ITEM in stack:
            items.append(text[begin:at])
            del stack[stack.index(ITEM) :]

    for m in TOKEN.finditer(text):
        kind, c = m.lastgroup, m[0]
        if stack and stack[-1] == "```":
            if kind == "fence":
                stack.pop()
            continue
        if kind in ("item", "line"):
            leave(m.start())
            if kind == "item":
                stack.append(ITEM)
                begin = m.end()
            continue
        if kind == "tag":
            name = m["tag"].lower()
            opens, closes = ("", f"</{name}>") if c[1] == "/" else (f"</{name}>", "")
            if name in VOID or c.endswith("/>"):
                continue
        elif kind == "mark":
            opens, closes = PAIRS.get(c, c if c == '"' else ""), "" if c in PAIRS else c
        else:
            opens = closes = c
        if closes and closes in stack:
            while stack.pop() != closes:
                pass
        elif opens:
            stack.append(opens)
    if ITEM in stack:
        items.append(text[begin:])
    return stack, items


def open_at_end(text: str) -> list[str]:
    """What the parser still waits for when the text ends, list items aside."""
    return [x for x in parse(text)[0] if x != ITEM]


def is_truncated(instruction: str, output: str) -> bool:
    """Whether an answer in sentences breaks off."""
    bare = output.rstrip().rstrip("\u200b\ufeff\u00ad")
    if not bare:
        return False
    lines = [x for x in bare.split("\n") if x.strip()]
    last = lines[-1].strip()
    stack, items = parse(bare)
    waiting = [x for x in stack if x != ITEM]
    if "```" in waiting or any(x.startswith("</") for x in waiting):
        return True
    if not waiting and bare.endswith(">"):
        # closed markup after the last word
        bare = TAGS_AT_END.sub("", bare)
        last = TAGS_AT_END.sub("", last)
    n = len(last.split())
    if TERMINAL.search(bare) and not re.search(r"[:;]$", bare):
        # an open bracket or quotation, unless its closing mark was merely left out in an earlier sentence
        tail = re.split(r"[.!?]\s", bare)[-1]
        return any(x in waiting for x in ")]”»") and bool(open_at_end(tail)) and n > 3
    if ITEM in stack or len(lines) >= 3 and all(len(x.split()) <= 6 for x in lines):
        # a list of short items needs no mark; items in sentences do
        others = items[:-1] if ITEM in stack else items
        if not others or not all(SENTENCE_END.search(x.strip()) and len(x.split()) >= 5 for x in others):
            return False
    if SIGNED.match(last) or len(lines) > 1 and n <= 4 and (LETTER.search(instruction) or SIGNED.match(lines[-2].strip())):
        return False
    body = bare[: -len(last)] if len(lines) > 1 else ""
    sentences = len(SENTENCE_END.findall(body + last))
    if any(x in waiting for x in (")", "]", "”", "»", '"', "**")) and n > 2:
        return True
    if last.endswith((",", ";", "-", "–", "—", ":")) and n >= 3:
        return True
    if sentences:
        return n > 0
    # no sentence has ended: a short answer, a title, or one sentence cut off
    if SENTENCES.search(instruction) and not OPTIONS.search(instruction) and not _titled(last):
        return True
    return n >= 6 and any(w.islower() for w in last.split()[1:]) and not _titled(last)


def _titled(line: str) -> bool:
    long = [w for w in re.findall(r"[^\W\d_]+", line) if len(w) > 3]
    return bool(long) and sum(w[0].isupper() for w in long) >= 0.6 * len(long)


# ---------------------------------------------------------------- operator


def defect(field: LanguageModel, instruction: str | None, given: str | None, output: str | None) -> tuple[str | None, float]:
    """(defect or None, confidence) of one pair."""
    if is_empty(output):
        return "empty", 1.0
    instruction, given = instruction or "", given or ""
    if is_refusal(instruction, output):
        return "refusal", 1.0
    if is_copy(instruction, given, output):
        return "copy", 1.0
    script, asked_script = script_of(output), script_of(instruction)
    if script and asked_script and script != asked_script and not asks_language(instruction) and not (COPYING.search(instruction) and script_of(given) == script):
        return "other_language", 1.0
    got, sure = language_of(field, output, 4)
    asked, sure_asked = _asked(field, instruction) if got else (None, 0.0)
    if asked and got and asked != got and sure > 0.9 and sure_asked > 0.5 and not asks_language(instruction):
        own = language_of(field, given, 4)[0] if given else None
        if not (own == got and (COPYING.search(instruction) or own != asked)):
            return "other_language", sure
    if is_truncated(instruction, output):
        return "truncated", 1.0
    return None, 0.0


def _asked(field: LanguageModel, instruction: str) -> tuple[str | None, float]:
    """``language_of`` an instruction; the same one comes with many rows."""
    known = _ASKED.get((id(field), instruction))
    if known is None:
        if len(_ASKED) > 50_000:
            _ASKED.clear()
        known = _ASKED[id(field), instruction] = language_of(field, instruction, 2)
    return known


_ASKED: dict[tuple[int, str], tuple[str | None, float]] = {}


def defects(df: DataFrame, samples: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(id, defect, confidence) of the defective pairs of ``df`` with columns
    instruction, input and output.

    Null instruction and input count as empty. Each row is judged alone, so a
    pair delivered again counts again; equal pairs of a batch are judged once.
    Rows with a null id have no row.
    """
    trained = trained_field(samples)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field, known = trained.value, {}
        for frame in slices(frames, "output", 1 << 24):
            rows = []
            for i, *pair in zip(frame["id"], frame["instruction"], frame["input"], frame["output"]):
                key = tuple(pair)
                found = known.get(key)
                if found is None:
                    if len(known) > 20_000:
                        known.clear()
                    found = known[key] = defect(field, *pair)
                if found[0]:
                    rows.append((i, *found))
            yield pd.DataFrame(rows, columns=["id", "defect", "confidence"])

    kind = df.schema[id_col].dataType.simpleString()
    slim = spread(df.select(F.col(id_col).alias("id"), "instruction", "input", "output")).filter("id is not null")
    return slim.mapInPandas(run, f"id {kind}, defect string, confidence double").withColumnRenamed("id", id_col)
