"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word: a lower-cased run of letters and digits.
WORD = re.compile(r"[^\W_]+")

#: Where the public vocabularies lie unless a caller gives another folder.
TOKENIZER_DIR = os.environ.get("CORPUSFORGE_TOKENIZERS", "/opt/tokenizers")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def source_key(column: Column | str) -> Column:
    """Spelling-independent key of a source name: case, separators and outer
    space make no difference; null stays null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.lower(column), "[^\\p{L}\\p{N}]", "")


def slices(frames: Iterator[pd.DataFrame], column: str, limit: int) -> Iterator[pd.DataFrame]:
    """Cut frames into runs of rows whose ``column`` holds about ``limit``
    characters at most; a single longer row stays whole."""
    for frame in frames:
        if frame.empty:
            continue
        size = frame[column].str.len().fillna(0).cumsum()
        for _, part in frame.groupby((size // limit).astype("int64"), sort=False):
            yield part


def labelled_sample(samples: DataFrame, per_language: int = 500, seed: int = 7) -> list[tuple[str, str]]:
    """(lang, text): at most ``per_language`` distinct labelled texts of each
    language, the first in the order of a seeded hash."""
    language = F.col("lang") if "lang" in samples.columns else F.lit("")
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "text"), "text")
    rows = samples.select(language.alias("lang"), "text").filter("lang is not null and text is not null").distinct()
    kept = rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language).select("lang", "text").collect()
    return sorted((r["lang"], r["text"]) for r in kept)
