"""Statistics of text quality and the kinds of text that are not prose (problem 3).

``statistics`` computes the published heuristics as Column expressions in one
pass; ``rule_failures`` applies fixed thresholds and names each rule that
fails. ``kinds`` tells lists, tables and junk from prose by fixed thresholds over
the same statistics and, for texts that are no prose by them, over those of
their lines (``signals``); each case comes with the rule that named it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .common import slices
from .mojibake import model, training_texts

#: The commonest function words of the languages at hand.
COMMON = {
    "en": "the be to of and a in that have it for not on with as at this by from they we or an will is was were are had has but which who so than he she",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch weil",
    "fr": "le la les de des du et un une est que dans qui ce il pas pour sur par plus avec au aux se ne en à mais ou son sa ses elle nous vous ils cette parce",
    "es": "el la los las de del y un una es que en no se por con para su al lo como más o pero sus le ha este entre porque esta ya muy",
    "it": "il lo la i gli le di del della e un una è che in non si per con a da al come più ma sono ha anche nel alla perché ci o questo su",
    "pt": "o a os as de do da e um uma é que em não se por com para ao no na dos das como mais mas seu sua ou porque já ser foi são",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als door maar bij uit nog naar dan of over omdat wordt deze",
    "ru": "и в не на что с он как это по но из у за к а от для же так о то все ещё только потому мы его она они был",
}
COMMON_WORDS = sorted({w for words in COMMON.values() for w in words.split()})

# ---------------------------------------------------------------- statistics


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, n_words, mean_word_length, symbol_ratio, n_lines,
    punctuated_lines, bullet_lines, common_words, distinct_words).

    Words are runs of non-blank characters; ratios are of words, of characters
    or of non-blank lines, and 0 where there are none. A null text counts as
    empty. All are Column expressions, so the scan is the only stage.
    """
    return _measured(df.select(F.col(id_col), F.col(text_col).alias("_text")), "_text").select(id_col, *STATISTICS)


STATISTICS = ("n_chars", "n_words", "mean_word_length", "symbol_ratio", "n_lines", "punctuated_lines", "bullet_lines", "common_words", "distinct_words")


def _measured(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with the statistics."""
    base = df.withColumn("_s", F.coalesce(F.col(text_col), F.lit(""))).withColumns(
        {"_v": F.filter(F.split(F.lower("_s"), "[ \\t\\r\\n]+"), lambda w: w != ""), "n_lines": F.regexp_count("_s", F.lit("(?:^|\\n)[ \\t]*[^ \\t\\r\\n]")).cast("long")}
    )
    n, lines = F.size("_v"), F.col("n_lines")
    return base.withColumns(
        {
            "n_chars": F.length("_s").cast("long"),
            "n_words": n.cast("long"),
            "mean_word_length": _share(F.length(F.array_join("_v", "")), n),
            "symbol_ratio": _share(F.regexp_count("_s", F.lit("#|\\.\\.\\.|…")), n),
            "punctuated_lines": _share(F.regexp_count("_s", F.lit("[.!?…][\"”»')]*[ \\t\\r]*(?:\\n|\\z)")), lines),
            "bullet_lines": _share(F.regexp_count("_s", F.lit("(?:^|\\n)[ \\t]*[-•*–]")), lines),
            "common_words": _share(F.size(F.filter("_v", lambda x: x.isin(COMMON_WORDS))), n),
            "distinct_words": _share(F.size(F.array_distinct("_v")), n),
        }
    ).drop("_s", "_v")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


#: Published fixed thresholds: (rule, least, most) of each statistic.
RULES = (
    ("n_words", 50, 100_000),
    ("mean_word_length", 3, 10),
    ("symbol_ratio", 0, 0.1),
    ("bullet_lines", 0, 0.9),
    ("punctuated_lines", 0.12, 1.0),
    ("common_words", 0.06, 1.0),
    ("distinct_words", 0.15, 1.0),
)


def rule_failures(stats: DataFrame) -> DataFrame:
    """``stats`` with ``reasons``: the names of the rules a text fails, in order."""
    failed = [F.when((F.col(name) < least) | (F.col(name) > most), F.lit(name)) for name, least, most in RULES]
    return stats.withColumn("reasons", F.filter(F.array(*failed), lambda x: x.isNotNull()))


# --------------------------------------------------------------------- kinds

#: Marks that stand at the edges of a word, and those that stand inside one.
_EDGE = r"(\[{<\"'“”„«»‹›‘’¡¿–—…*_#.,;:!?)\]}>\-"
_JOIN = r"'’·/\-.,:%°£€$–—×"
#: A word or number in its marks, up to three marks alone, or a lone sign. The
#: quantifiers are possessive, so a long token costs one pass.
PLAIN = (
    rf"(?<![^ \t\n])(?:[{_EDGE}]*+(?:(?=[{_JOIN}]*+[\p{{L}}\p{{M}}])[\p{{L}}\p{{M}}{_JOIN}]++|[\p{{Nd}}{_JOIN}]++[\p{{L}}{_JOIN}]{{0,2}}+|[|&+=©±§•½])[{_EDGE}]*+|[{_EDGE}{_JOIN}]{{1,3}}+)(?![^ \t\n])"
)
STOP = r"[.!?…][\"”»’')\]]*+(?=[ \t\n]|\z)"
BULLET = r"^[ \t]*(?:[-*•–—·▪◦+][ \t]+|\[[ xX]?\][ \t]*|\(?(?:\p{Nd}{1,3}|[A-Za-z])[.)][ \t]+)"
#: What cuts a line into cells, the first that holds: (name, the line has it, its places, seven words without it).
CELLS = (
    ("bar", r"\|[^|]*\||[^ \t] \| [^ \t]", r"\|", r"(?<![^ \t|])[^ \t|]++(?:[ \t]++[^ \t|]++){6}"),
    ("tab", r"[^ \t] *\t[ \t]*[^ \t]", r"\t", r"(?<![^ \t])[^ \t]++(?: ++[^ \t]++){6}"),
    ("semicolon", r";[^ \t]", r";", r"(?<![^ \t;])[^ \t;]++(?:[ \t]++[^ \t;]++){6}"),
    ("comma", r"(?U)[\"\w%)],(?=[\"\w(-])(?!(?<=\d,)\d{3}\b[^,]*$)", r",", r"(?<![^ \t,])[^ \t,]++(?:[ \t]++[^ \t,]++){6}"),
    ("gap", r"[^ \t] {2,}[^ \t]", r" {2,}", r"(?<![^ \t])[^ \t]++(?: [^ \t]++){6}"),
)
SEPARATORS = r"[ \t]*(?:\||>>|»|;|,|/|·|•|\n|\t)[ \t\n]*"

#: Fixed thresholds: a text that keeps both is running prose and is not looked at by lines.
PROSE = "common_words >= 0.2 and punctuated_lines >= 0.6"
#: Fixed thresholds: the first rule that holds names kind and reason. Statistics are those of ``signals``.
KIND_RULES = (
    ("junk", "blank", "n_words = 0"),
    ("junk", "code", "code_lines >= 0.5"),
    ("table", "cells", "n_lines >= 3 and n_words <= 30 * n_lines and cell_lines >= 0.6 and even_rows >= 0.6 and short_rows >= 0.8"),
    ("junk", "symbols", "odd_characters > 0.45"),
    ("junk", "runs", "long_runs > 0.5"),
    ("junk", "repetition", "n_words >= 12 and n_distinct <= least(12, 0.3 * n_words)"),
    ("junk", "repetition", "n_words >= 12 and 30 * stops <= n_words and n_phrases >= 8 and distinct_phrases <= 0.5 and n_words <= 6 * n_phrases"),
    ("junk", "repetition", "n_words >= 12 and 60 * stops <= n_words and n_lines < 3 and n_distinct <= 0.4 * n_words"),
    ("list", "items", "n_lines >= 3 and n_words <= 12 * n_lines and item_characters > 0.6"),
)


def plain_text(text: Column) -> Column:
    """``text`` without invisible characters, with entities read, blanks of any
    kind as the blank and line ends of any kind as one newline."""
    c = F.regexp_replace(text, "[\\u00ad\\u200b-\\u200f\\u202a-\\u202e\\u2060\\ufeff]", "")
    c = F.regexp_replace(c, "&nbsp;|&#160;|[\\x0b\\x0c\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000]", " ")
    for name, mark in (("quot|#34|apos|#39", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        c = F.regexp_replace(c, f"&(?:{name});", mark)
    # any other entity stands for a letter or a mark inside a word
    c = F.regexp_replace(c, "&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});", "e")
    return F.regexp_replace(c, "[\\r\\n\\u2028\\u2029]+", "\n")


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: as a lambda variable, as the
    optimizer may else put its expression into a lambda, once an element."""
    return F.transform(F.array(value), use)[0]


def _n_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit("[^ \\t]+"))


def signals(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the statistics of ``KIND_RULES``: of length, symbols,
    punctuation, bullets, cells and repetition, all Column expressions.

    n_words, n_distinct, n_lines, stops (marks that end a sentence), n_phrases
    (between separators); shares of lines: code_lines, cell_lines; of the lines
    cut by the commonest separator: even_rows (as many cells as most of them),
    short_rows (no cell of seven words); of characters: odd_characters (in
    neither words nor numbers), long_runs (of 25 characters without a blank),
    item_characters (in short items, one a line); and distinct_phrases.
    """
    c = F.col
    base = df.withColumn("_t", plain_text(c(text_col)))
    base = base.withColumns(
        {
            "_w": F.filter(F.split("_t", "[ \\t\\n]+"), lambda w: w != ""),
            "_l": F.filter(F.transform(F.split("_t", "\\n"), lambda x: F.trim(F.regexp_replace(x, "^[ \\t]+|[ \\t]+$", ""))), lambda x: x != ""),
            "_p": F.filter(F.split("_t", SEPARATORS), lambda x: x.rlike("[^ \\t\\n]")),
        }
    )
    kind_of_line = None
    for name, has, _, _ in reversed(CELLS):
        kind_of_line = (lambda rest, name, has: lambda x: F.when(x.rlike(has), name).otherwise(rest(x) if rest else F.lit("")))(kind_of_line, name, has)
    base = base.withColumns({"n_words": F.size("_w"), "n_lines": F.size("_l"), "n_distinct": F.size(F.array_distinct("_w")), "_c": F.transform("_l", kind_of_line)})
    # a separator that cuts 0.6 of the lines is the commonest
    sep = F.lit(None).cast("string")
    for name, _, _, _ in CELLS:
        sep = F.when(F.size(F.filter("_c", lambda x: x == name)) >= 0.6 * c("n_lines"), name).otherwise(sep)
    base = base.withColumn("_sep", sep)
    rows = _bound(F.struct("_c", "_sep"), lambda b: F.filter("_l", lambda x, i: b["_c"][i] == b["_sep"]))
    bars = F.transform(c("_r"), lambda x: F.regexp_replace(x, "^\\|+|\\|+$", ""))
    width = short = None
    for name, _, place, wordy in CELLS:
        w = F.transform(bars, lambda x: F.least(F.regexp_count(x, F.lit(place)) + 1, F.lit(64)))
        s = F.size(F.filter(bars, lambda x: ~x.rlike(wordy)))
        width = F.when(c("_sep") == name, w) if width is None else width.when(c("_sep") == name, w)
        short = F.when(c("_sep") == name, s) if short is None else short.when(c("_sep") == name, s)
    base = base.withColumn("_r", rows).withColumns({"_width": width, "_short": short})
    # (rows, cells) of the commonest number of cells, at most 64 numbers
    most = _bound(c("_width"), lambda w: F.array_max(F.transform(F.array_distinct(w), lambda v: F.struct(F.size(F.filter(w, lambda y: y == v)).alias("n"), v.alias("cells")))))
    base = base.withColumns({"_most": most, "_headed": (c("n_lines") > 4) & ((_n_words(F.get("_l", F.lit(0))) <= 8) | (F.regexp_count(F.get("_l", F.lit(0)), F.lit(STOP)) <= 1))})
    base = base.withColumn("_i", F.when(c("_headed"), F.slice("_l", F.lit(2), F.greatest(c("n_lines"), F.lit(1)))).otherwise(c("_l")))
    base = base.withColumn("_marked", F.size(F.filter("_i", lambda x: x.rlike(BULLET))) >= 0.5 * F.size("_i"))

    def item(x: Column, marked: Column) -> Column:
        n = _n_words(x)
        # part of a wrapped sentence: ended, or broken off after a comma, or long
        runs_on = (x.rlike("[.!?…][\"”»’')\\]]*$") & (n >= 5)) | (x.endswith(",") & (n >= 4)) | ((F.length(x) >= 32) & (n >= 5))
        return F.when(marked, x.rlike(BULLET) & ((n <= 9) | ~x.rlike(STOP))).otherwise((n <= 6) & ~x.rlike("[.!?…][ \\t]+[^ \\t]") & ~runs_on)

    size = F.length(F.regexp_replace("_t", "[ \\t\\n]+", ""))
    left = lambda pattern: F.length(F.regexp_replace(F.regexp_replace("_t", pattern, ""), "[ \\t\\n]+", ""))
    return base.withColumns(
        {
            "stops": F.regexp_count("_t", F.lit(STOP)),
            "code_lines": _share(F.size(F.filter("_l", lambda x: x.contains("{") & x.contains("}"))), c("n_lines")),
            "cell_lines": F.when(c("_sep").isNotNull(), _share(F.size("_r"), c("n_lines"))).otherwise(0.0),
            "even_rows": F.when(c("_most.cells") >= 2, _share(c("_most.n"), F.size("_r"))).otherwise(0.0),
            "short_rows": F.when(c("_sep").isNotNull(), _share(c("_short"), F.size("_r"))).otherwise(0.0),
            "odd_characters": _share(left(PLAIN), size),
            "long_runs": F.lit(1.0) - _share(left("(?<![^ \\t\\n])[^ \\t\\n]{25,}+"), size),
            "n_phrases": F.size("_p"),
            "distinct_phrases": _share(F.size(F.array_distinct("_p")), F.size("_p")),
            "item_characters": _share(_sum(F.transform(_bound(c("_marked"), lambda m: F.filter("_i", lambda x: item(x, m))), lambda x: F.length(x))), _sum(F.transform("_i", lambda x: F.length(x)))),
        }
    ).drop("_t", "_w", "_l", "_p", "_c", "_sep", "_r", "_width", "_short", "_most", "_headed", "_i", "_marked")


def with_kinds(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``kind`` ('list', 'table', 'junk', null for prose) and
    ``reason`` (what the rule that held looks at). Null texts and texts of
    fewer than 60 characters are null in both. One pass, no shuffle."""
    measured = _measured(df.select("*", F.when(F.length(text_col) >= 60, F.col(text_col)).alias("_text")), "_text").drop(*[n for n in STATISTICS if n not in ("common_words", "punctuated_lines")])
    open_ = measured.withColumn("_open", F.when(~F.expr(PROSE), F.col("_text")))
    looked = signals(open_.drop("common_words", "punctuated_lines", "_text"), "_open")
    found = F.lit(None).cast("struct<kind:string,reason:string>")
    for kind, reason, rule in reversed(KIND_RULES):
        found = F.when(F.expr(rule), F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))).otherwise(found)
    decided = looked.withColumn("_k", F.when(F.col("_open").isNotNull(), found))
    return decided.select(*df.columns, F.col("_k.kind").alias("kind"), F.col("_k.reason").alias("reason"))


def kinds(df: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, reason) of the texts of 60 characters or more that are mostly
    not running prose; texts that look odd for being wrongly decoded are none.
    Null and shorter texts and null ids have no row; each row of ``df`` is judged alone.

    Only the texts with odd characters go to a kernel, which asks the
    classifier of wrong encodings whether that is why.
    """
    clean = training_texts(samples)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        garbled = model(clean)
        for frame in slices(frames, "text", 1 << 24):
            kept = [k is not None and not (t is not None and garbled.judge(t)[0]) for k, t in zip(frame["kind"], frame["text"])]
            yield frame.loc[kept, ["id", "kind", "reason"]]

    kind = df.schema[id_col].dataType.simpleString()
    slim = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null"))
    decided = with_kinds(slim).select("id", "kind", "reason", F.when(F.col("reason") == "symbols", F.col("text")).alias("text"))
    return decided.mapInPandas(run, f"id {kind}, kind string, reason string").withColumnRenamed("id", id_col)
