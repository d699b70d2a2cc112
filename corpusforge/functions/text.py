"""Column builders for text: white space, cleaning, wiki markup, predicates.

Patterns are written for the JVM's engine. ``WS`` is the white space of
Unicode, which Java's and RE2's ``\\s`` both lack; line ends are newlines only
(flag ``d``) and word classes are Unicode's (flag ``U``).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space of Unicode, as a class both engines read.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Characters, patterns and prefixes that define the cleaning.
JUNK_CHARS = "�﻿​‌‍­￾"
URL = r"https?://\S+|www\.\S+"
HTML = r"<[^>]+>"
FENCED_CODE = r"```[\s\S]*?```"
INDENTED_CODE = r"(?:(?:^|\n)[ \t]{4,}\S[^\n]*){3,}"
HTML_MARKUP = r"(?is)<\s*/?\s*(html|head|body|div|span|script|style|p|a|img|table|tr|td|ul|ol|li|h[1-6]|form|input|button|section|article|br|meta)\b[^>]*>"
CODE_MARKERS = (
    r"(?imdU)(```|</?\s*(script|style|html|body|div|span|p|a|img|table|form|input)\b|"
    r"^\s*(#\s*In\[[^\]]*\]|In\s*\[[0-9 ]*\]:|%%[A-Za-z_]+)|"
    r"^\s*(def\s+\w+\s*\(|class\s+\w+|import\s+\w+|from\s+\w+(?:\.\w+)*\s+import|print\s*\(|for\s+.+:|while\s+.+:|if\s+.+:|@\w+)|"
    r"\b(function\s+\w+\s*\(|console\.log\s*\(|var\s+\w+\s*=|let\s+\w+\s*=|const\s+\w+\s*=|public\s+static\s+void|#include\s*<|SELECT\s+.+\s+FROM|CREATE\s+TABLE|<html\b|<body\b|<script\b|<style\b))"
)
CODE_LINE = (
    r"(?imdU)^\s*(def\s+\w+\s*\(.*|class\s+\w+.*|import\s+\w+.*|from\s+\w+(?:\.\w+)*\s+import.*|print\s*\(.*|for\s+.+:|while\s+.+:|"
    r"if\s+.+:|elif\s+.+:|else:|return\b.*|@\w+.*|function\s+\w+\s*\(.*|console\.log\s*\(.*|"
    r"var\s+\w+\s*=.*|let\s+\w+\s*=.*|const\s+\w+\s*=.*|public\s+static\s+void.*|#include\s*<.*)\s*$"
)
INLINE_CODE = r"(?iU)\b(def\s+\w+\s*\([^)]*\):?|class\s+\w+\s*:|print\s*\([^)]*\)|console\.log\s*\([^)]*\)|return\s+[-+\w'\"()\[\].]+)"
CODE_TOPIC = (
    r"(?iU)\b(python|javascript|java|c\+\+|c#|typescript|html|css|sql|bash|shell|programming|programmer|source\s+code|code\s+snippet|write\s+code|"
    r"debug|syntax\s+error|compiler|interpreter|software\s+library|api\s+endpoint|"
    r"(?:write|generate|create|implement|fix|modify|refactor)\s+(?:a\s+)?(?:program|function|class|script|algorithm))\b"
)
LATEX = r"(?s)(\$\$.*?\$\$|\$[^$\n]{1,120}\$|\\\(|\\\)|\\\[|\\\]|\\begin\{(?:equation|align|math|matrix|cases)\}|\\(?:frac|sum|int|sqrt|lim|alpha|beta|gamma|theta|pi)\b)"
MATH = r"(?mdU)(^|\s)([A-Za-z]\s*=\s*[-+*/^(). A-Za-z0-9]+|\d+(?:\.\d+)?\s*[-+*/^=<>]\s*\d+(?:\.\d+)?|[A-Za-z0-9)\]]\s*[\^*/]\s*[A-Za-z0-9(\[])"
MATH_TOPIC = (
    r"(?iU)\b(math|mathematics|arithmetic|algebra|calculus|geometry|trigonometry|equation|formula|solve for|derivative|integral|matrix|polynomial|"
    r"probability|statistics|theorem|proof|calculate|compute|factorial|fibonacci)\b"
)
ENGLISH_STOPWORDS = (
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all would there "
    "their what so up out if about who get which go me when make can like time no just him know take people into year your good some could them see "
    "other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most us"
).split()
BOILERPLATE_PREFIXES = (
    "Media playback is unsupported on your device",
    "Media playback is not supported on this device",
    "These are external links and will open in a new window",
    "Image copyright",
    "Image caption",
    "Share this with",
    "Copy this link",
    "These are external links",
    "Close share panel",
    "Sign up for our newsletter",
)
WIKI = (
    r"={2,6}\s*[^=]+\s*={2,6}",
    r"\[\d+\]|\[citation needed\]|\[edit\]",
    r"\{\{[^}]*\}\}",
    r"(?i)\[\[Category:[^\]]*\]\]",
    r"(?i)\[\[(?:File|Image):[^\]]*\]\]",
)


def unretreating(pattern: str) -> str:
    """``pattern`` with the white space at a line's begin taken for good: what
    follows it never begins with any, so the matches are the same, and a long run of blank lines
    is not gone back through from each of them."""
    return pattern.replace(r"^\s*(", r"^\s*+(")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c: Column | str) -> Column:
    """The column, null as the empty text."""
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space of Unicode at both ends."""
    # at the end only where a run begins, or a long run inside would be tried from each of its characters
    return F.regexp_replace(col(c), f"^{WS}++|(?<!{WS}){WS}++$", "")


def split_words(c: Column | str) -> Column:
    """Lower-cased runs between white space; none for an empty text."""
    return F.filter(F.split(F.lower(text_of(c)), WS + "+"), lambda w: w != "")


def squeeze(c: Column | str) -> Column:
    """Lower case, one blank between words."""
    return F.array_join(split_words(c), " ")


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfc(c: Column | str) -> Column:
    """Composed form. ASCII texts give the UDF a null and skip its work."""
    odd = col(c).rlike(r"[^\x00-\x7F]")
    return F.coalesce(_nfc(F.when(odd, col(c))), col(c))


def nfkc(c: Column | str) -> Column:
    odd = col(c).rlike(r"[^\x00-\x7F]")
    return F.coalesce(_nfkc(F.when(odd, col(c))), col(c))


def drop_junk(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"[{JUNK_CHARS}]+", "")


def drop_prefix(c: Column | str) -> Column:
    """Without the first boilerplate prefix that begins the text, and the
    white space after it; at most one prefix goes."""
    return F.regexp_replace(col(c), f"^(?:{'|'.join(BOILERPLATE_PREFIXES)}){WS}*", "")


def collapse(c: Column | str, spaces: bool = True) -> Column:
    c = F.regexp_replace(col(c), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"[ \t]{2,}", " ") if spaces else c


def clean_text(c: Column | str, strip_code_and_math: bool = True, normalise: bool = True) -> Column:
    """Cleaning in its fixed order; null gives the empty text.

    ``normalise`` False leaves the composed form out (it is the one step
    outside code generation).
    """
    c = text_of(c)
    if normalise:
        c = nfc(c)
    c = F.regexp_replace(drop_junk(c), "(?U)" + URL, "")
    if strip_code_and_math:
        for pattern in (HTML, FENCED_CODE, "(?U)" + INDENTED_CODE, unretreating(CODE_LINE), INLINE_CODE, LATEX):
            c = F.regexp_replace(c, pattern, "")
        c = F.regexp_replace(c, MATH, " ")
    return strip(collapse(drop_prefix(c), spaces=strip_code_and_math))


def clean_wikipedia(c: Column | str) -> Column:
    c = text_of(c)
    for pattern in WIKI:
        c = F.regexp_replace(c, pattern, "")
    return c


def ascii_ratio(c: Column | str) -> Column:
    c = text_of(c)
    return F.length(F.regexp_replace(c, r"[^\x00-\x7F]", "")) / F.greatest(F.length(c), F.lit(1))


def is_english(c: Column | str) -> Column:
    """The dependency-free rule: of the first 800 characters, at least five
    words, ASCII above 0.85, and stop words at least 0.12 of the words."""
    sample = F.regexp_replace(F.substring(text_of(c), 1, 800), "\n", " ")
    found = F.regexp_extract_all(F.lower(sample), F.lit("[a-z']+"), F.lit(0))
    hits = F.size(F.filter(found, lambda w: w.isin(ENGLISH_STOPWORDS)))
    return (F.size(found) >= 5) & (ascii_ratio(sample) > 0.85) & (hits / F.greatest(F.size(found), F.lit(1)) >= 0.12)


def has_code_or_markup(c: Column | str) -> Column:
    return text_of(c).rlike(HTML_MARKUP) | text_of(c).rlike(unretreating(CODE_MARKERS))


def has_math_content(c: Column | str) -> Column:
    return text_of(c).rlike(LATEX) | text_of(c).rlike(MATH)


def is_code_or_math_task(c: Column | str) -> Column:
    c = text_of(c)
    return c.rlike(CODE_TOPIC) | c.rlike(MATH_TOPIC) | has_code_or_markup(c) | has_math_content(c)


def is_clean_instruction(instruction: Column, given: Column, output: Column, filter_code_and_math: bool = True) -> Column:
    """Instruction and output not blank, English, and free of code and mathematics."""
    joined = F.concat_ws("\n", *[F.when(strip(text_of(x)) != "", text_of(x)) for x in (instruction, given, output)])
    good = (strip(text_of(instruction)) != "") & (strip(text_of(output)) != "")
    if filter_code_and_math:
        for part in (instruction, given, output):
            good &= ~is_code_or_math_task(part)
        good &= ~is_code_or_math_task(joined)
    else:
        joined = clean_text(joined)
    return good & is_english(joined)


def decontam_normalise(c: Column | str) -> Column:
    """Compatibility form, lower case, ASCII punctuation as blanks, squeezed."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(nfkc(text_of(c))), r"[!-/:-@\[-`{-~]", " "), WS + "+", " "))


def answer_key(c: Column | str) -> Column:
    """An answer cut to what is compared: cleaned, lower case, without quotes
    at its ends and marks at its end."""
    c = F.regexp_replace(F.lower(clean_text(c)), "^[\"'`]+|[\"'`]+$", "")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[.!,;:]+$", ""), WS + "+", " "))


def preview(c: Column | str, n: int = 80) -> Column:
    c = strip(F.regexp_replace(text_of(c), WS + "+", " "))
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("..."))).otherwise(c)


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def strip_seed(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"_s\d+$", "")


def strip_footer(c: Column | str) -> Column:
    """Without trailing ``tokens/s:`` lines and blank lines."""
    return F.regexp_replace(text_of(c), r"(?i)(?:\s*(?:^|\n)[ \t]*tokens/s:[^\n]*)*\s*$", "")


def word_count(c: Column | str) -> Column:
    return F.regexp_count(text_of(c), F.lit(r"(?U)\b\w+\b"))


def model_name(path: Column | str) -> Column:
    """Name of a checkpoint: its path below the nearest ``checkpoints`` folder
    without suffix, slashes as underscores; else the file's stem."""
    p = text_of(path)
    below = F.regexp_extract(p, r"^(?:.*/)?checkpoints/(.+?)(?:\.[^./]*)?$", 1)
    stem = F.regexp_extract(p, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.when(below != "", F.replace(below, F.lit("/"), F.lit("_"))).otherwise(stem)


def simple_sentences(c: Column | str) -> Column:
    """Pieces between a final mark and a capital, stripped; no abbreviations."""
    pieces = F.split(text_of(c), f"(?<=[.!?]){WS}+(?=[A-Z])")
    return F.filter(F.transform(pieces, strip), lambda x: x != "")
