"""The queries of this subpackage over the project's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import langid, leakage, mixing, mojibake, neardup, pairs, quality, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# ------------------------------------------------------- 1: token budgets


def _counted(documents: DataFrame) -> DataFrame:
    """Tokens of each document, with the key of its source."""
    return tokens.token_counts(documents.withColumn("key", tokens.source_key("source")), keep=("key",))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    plans = table(spark, d, "source_plans")
    totals = tokens.source_totals(_counted(_documents(spark, d)), plans)
    return totals.join(plans.select(F.col("name").alias("source"), "target_tokens"), "source").filter("tokens < target_tokens").select("source").distinct()


def p1_document_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(_documents(spark, d))


def p1_budget(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each slice: source as named in the plans, language code, site."""
    documents, plans = _documents(spark, d), table(spark, d, "source_plans")
    named = plans.select(F.col("name").alias("plan"), tokens.source_key("name").alias("key"), "target_tokens")
    slices = documents.withColumns({"key": tokens.source_key("source"), "lang": tokens.lang_key("lang"), "domain": tokens.domain_key("domain")})
    return (
        tokens.token_counts(slices, keep=("key", "lang", "domain"))
        .groupBy("key", "lang", "domain")
        .agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("tokens"))
        .join(named, "key", "left")
        .select(F.coalesce("plan", "key").alias("source"), "lang", "domain", "n_documents", "tokens", "target_tokens")
    )


# ---------------------------------------------------------- 2: leakage


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_documents(spark, d), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_documents(spark, d), table(spark, d, "eval_items"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    documents = _documents(spark, d)
    return leakage.without_leaks(documents, leakage.leaks(documents, table(spark, d, "eval_items"))).select("doc_id", "source", "n_chars")


# ---------------------------------------------------------- 3: quality


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.kinds(_documents(spark, d), table(spark, d, "lang_samples")).select("doc_id", "kind").distinct()


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(_documents(spark, d))


def p3_failures(spark: SparkSession, d: str) -> DataFrame:
    """Rows that fail a rule, one row a rule. The outer form of explode, as the
    plain one adds a filter that would compute the statistics again."""
    failed = quality.rule_failures(quality.statistics(_documents(spark, d)))
    return failed.select("doc_id", F.explode_outer("reasons").alias("reason")).filter("reason is not null")


# -------------------------------------------------- 4: near duplicates


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Three words and 0.6, as the problem's statement has it."""
    pairs_, members = neardup.similar_pairs(_documents(spark, d), similarity=0.6, size=3)
    return neardup.all_pairs(pairs_, members).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a document: its group, under five words and 0.8."""
    return neardup.document_groups(_documents(spark, d)).withColumnsRenamed({"id": "doc_id", "group": "group_id"})


# -------------------------------------------------------- 5: languages


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.corrections(_documents(spark, d), table(spark, d, "lang_samples")).distinct()


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    return langid.document_languages(_documents(spark, d), table(spark, d, "lang_samples"))


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.language_segments(_documents(spark, d), table(spark, d, "lang_samples"))


# ------------------------------------------------------- 6: broken pairs


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "sft_rows"), table(spark, d, "lang_samples")).select("row_id", "defect").distinct()


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    """Defective rows by source and defect."""
    rows = table(spark, d, "sft_rows")
    bad = pairs.defects(rows, table(spark, d, "lang_samples"))
    return rows.select("row_id", "source").join(bad, "row_id").groupBy("source", "defect").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ 7: encoding


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_documents(spark, d))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, same): whether decoding the ids gives the text again."""
    documents = _documents(spark, d)
    back = tokens.decode(tokens.encode(documents)).withColumnRenamed("text", "decoded")
    return documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("a")).join(back.select("doc_id", F.sha2("decoded", 256).alias("b")), "doc_id").select("doc_id", (F.col("a") == F.col("b")).alias("same"))


# -------------------------------------------------------------- 8: mixing


def _rated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    configs = table(spark, d, "source_configs")
    counts = _counted(_documents(spark, d))
    return counts, mixing.rates(counts, configs, table(spark, d, "source_plans")), configs


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d)[1].filter("not reachable").select("source").distinct()


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    counts, rated, _ = _rated(spark, d)
    return mixing.mix(mixing.copies(counts, rated))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    counts, rated, configs = _rated(spark, d)
    return mixing.shares(mixing.copies(counts, rated), rated, configs)


# ------------------------------------------------------ 9: wrong encoding


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repairs(_documents(spark, d), table(spark, d, "lang_samples")).select("doc_id").distinct()


def p9_repairs(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repairs(_documents(spark, d), table(spark, d, "lang_samples"))


QUERIES: dict[str, Query] = {name: f for name, f in list(globals().items()) if name[:1] == "p" and name[1:2].isdigit() and callable(f)}

_COMMON = "[" + ",".join("'" + w.replace("'", "''") + "'" for w in quality.COMMON_WORDS) + "]"
_STATISTICS = (
    "SELECT doc_id, length(t) AS n_chars, len(w) AS n_words, CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w) ELSE 0.0 END AS mean_word_length, "
    "CASE WHEN len(w) > 0 THEN len(regexp_extract_all(t, '#|[.][.][.]|…')) / len(w) ELSE 0.0 END AS symbol_ratio, n_lines, "
    "CASE WHEN n_lines > 0 THEN len(regexp_extract_all(t, '[.!?…][\"”»'')]*[ \t\r]*(?:\n|\\z)')) / n_lines ELSE 0.0 END AS punctuated_lines, "
    "CASE WHEN n_lines > 0 THEN len(regexp_extract_all(t, '(?:^|\n)[ \t]*[-•*–]')) / n_lines ELSE 0.0 END AS bullet_lines, "
    "CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains(" + _COMMON + ", x))) / len(w) ELSE 0.0 END AS common_words, "
    "CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.0 END AS distinct_words "
    "FROM (SELECT doc_id, t, list_filter(regexp_split_to_array(lower(t), '[ \t\r\n]+'), lambda x: x <> '') AS w, len(regexp_extract_all(t, '(?:^|\n)[ \t]*[^ \t\r\n]')) AS n_lines FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"
)
SQL: dict[str, str] = {
    "p3_statistics": _STATISTICS,
    "p3_failures": " UNION ALL ".join(f"SELECT doc_id, '{name}' AS reason FROM s WHERE {name} < {least} OR {name} > {most}" for name, least, most in quality.RULES).join([f"WITH s AS ({_STATISTICS}) ", ""]),
    "p7_round_trip": "SELECT doc_id, true AS same FROM documents",
}
_SHINGLES = "SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 20"
SQL["p4_found"] = f"WITH s AS ({_SHINGLES}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2) SELECT a AS doc_id_a, b AS doc_id_b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.6 * (x.n + y.n - c)"
