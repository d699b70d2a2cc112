"""Queries over the mix of instruction pairs: tasks, benchmarks, risks, targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..sources.tables import spread
from .documents import _NS, _S, re2
from .instructions import _TOK, sft, strip_sql, tokenised

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# --------------------------------------------------- classification in SQL


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _hit(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {_quoted(pattern)})"


def _any(c: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, {_quoted(p)})" for p in phrases) + ")"


def _among(names: tuple[str, ...]) -> str:
    return "s IN (" + ", ".join(map(_quoted, names)) + ")"


#: Unicode word characters for RE2.
_W = r"[\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}]"
_LABELS = f"regexp_extract_all(p, {_quoted(C.OPTION_LINE)}, 1)"
_FIELDS = f"SELECT row_id, source, i, x, o, s, p, lower(p) AS l, lower(x) AS xl FROM (SELECT *, {strip_sql('i || chr(10)||chr(10) || x')} AS p FROM (SELECT row_id, source, {strip_sql('instruction')} AS i, {strip_sql('input')} AS x, {strip_sql('output')} AS o, lower({strip_sql('source')}) AS s FROM sft_rows))"
_FIRST = (
    f"SELECT *, {_among(C.CHOICE_SOURCES)} OR contains(l, 'multiple choice') OR len(list_distinct(list_filter({_LABELS}, lambda z: z IN ('A','B','C','D')))) >= 2 OR len(list_distinct(list_filter({_LABELS}, lambda z: z IN ('1','2','3','4')))) >= 2 OR (o <> '' AND length(o) <= 120 AND {_hit('o', C.LETTER_ANSWER)}) AS multiple_choice, "
    f"contains(p, '?') OR {_hit('i', C.QUESTION_START)} AS qa, contains(xl, 'previous conversation:') OR (contains(xl, 'user:') AND contains(xl, 'assistant:')) OR {_among(C.CHAT_SOURCES)} AS chat, "
    + ", ".join(f"{_any('l', C.PHRASES[k])} AS {k}" for k in ("summarization", "reasoning_math", "extraction", "classification", "creative_writing"))
    + rf", {_hit('l', r'\btranslat\w+\b')} OR {_any('l', C.PHRASES['translation'])} AS translation, {_hit('p', C.CODE_FENCE)} OR {_hit('p', C.CODE_HINTS)} AS coding, {_among(C.CLOZE_SOURCES)} OR {_any('l', C.PHRASES['cloze_next_word'])} OR contains(p, '___') OR contains(p, ' _ ') AS cloze_next_word FROM ({_FIELDS})"
)
_SECOND = (
    f"SELECT *, s = 'hellaswag' OR (multiple_choice AND {_any('l', C.PHRASES['hellaswag'])}) AS bench_hellaswag_like, s = 'winogrande' OR (multiple_choice AND (contains(l, 'refers to') OR ((contains(p, '___') OR contains(l, 'blank')) AND {_hit('p', C.PRONOUN)}))) AS bench_winogrande_like, "
    f"cloze_next_word OR contains(l, 'next word') OR (len(regexp_extract_all(x, '{_W}+')) >= 60 AND len(regexp_extract_all(o, '{_W}+')) <= 2 AND NOT multiple_choice) AS bench_lambada_like FROM ({_FIRST})"
)
_THIRD = f"SELECT *, {_among(('arc', 'openbookqa', 'sciq'))} OR (multiple_choice AND (qa OR {_hit('p', C.SCIENCE)}) AND NOT bench_hellaswag_like AND NOT bench_winogrande_like) AS bench_openbookqa_like FROM ({_SECOND})"
_PLAIN = ("multiple_choice", "qa", "chat", "summarization", "translation", "reasoning_math", "coding", "extraction", "classification", "creative_writing", "cloze_next_word")
_FOURTH = f"SELECT *, i <> '' AND NOT ({' OR '.join(_PLAIN)}) AS general_instruction FROM ({_THIRD})"
_CLASSED = f"SELECT *, CASE {' '.join(f'WHEN {flag} THEN {_quoted(name)}' for flag, name in C.LADDER)} ELSE 'unknown' END AS primary_task FROM ({_FOURTH})"


def classified(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return C.classify(spread(sft(spark, d).select("row_id", "source", "instruction", "input", "output", *more)))


@query("classify_tasks", f"SELECT row_id, primary_task, {', '.join(C.FLAGS)} FROM ({_CLASSED})")
def classify_tasks(spark, d):
    return classified(spark, d).select("row_id", "primary_task", *C.FLAGS)


@query("task_mix", f"SELECT primary_task, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM ({_CLASSED}) GROUP BY primary_task")
def task_mix(spark, d):
    by = classified(spark, d).groupBy("primary_task").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a task


@query("source_task_crosstab", f"SELECT source, primary_task, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY source) AS pct FROM ({_CLASSED}) GROUP BY source, primary_task")
def source_task_crosstab(spark, d):
    by = classified(spark, d).groupBy("source", "primary_task").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("source")))


def _flags_sql(flags: tuple[str, ...]) -> str:
    return f"WITH c AS ({_CLASSED}) " + " UNION ALL ".join(f"SELECT '{f}' AS flag, count(*) FILTER ({f}) AS n, 100.0 * count(*) FILTER ({f}) / count(*) AS pct FROM c" for f in flags)


def _flag_counts(spark, d, flags: tuple[str, ...]) -> DataFrame:
    one = classified(spark, d).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(f).alias(f) for f in flags])
    return one.selectExpr("total", "stack(%d, %s) as (flag, n)" % (len(flags), ", ".join(f"'{f}', {f}" for f in flags))).select("flag", "n", F.try_divide(F.lit(100.0) * F.col("n"), F.col("total")).alias("pct"))


@query("flag_mix", _flags_sql(C.FLAGS))
def flag_mix(spark, d):
    return _flag_counts(spark, d, C.FLAGS)


BENCH = ("bench_hellaswag_like", "bench_winogrande_like", "bench_openbookqa_like", "bench_lambada_like")


@query("bench_by_source", f"SELECT source, {', '.join(f'100.0 * count(*) FILTER ({b}) / count(*) AS {b}' for b in BENCH)} FROM ({_CLASSED}) GROUP BY source")
def bench_by_source(spark, d):
    return classified(spark, d).groupBy("source").agg(*[(F.lit(100.0) * F.count_if(b) / F.count(F.lit(1))).alias(b) for b in BENCH])


# Least and most percent of each area of the mix.
TARGETS = (("general_instruction", 25, 45), ("qa", 15, 35), ("multiple_choice", 10, 25), ("bench_hellaswag_like", 8, 18), ("bench_winogrande_like", 4, 10), ("bench_openbookqa_like", 6, 15), ("bench_lambada_like", 8, 20), ("chat", 8, 25))


def target_status(current: DataFrame, targets: DataFrame) -> DataFrame:
    """(area, current_pct, target_mid_pct, delta_to_mid, status) of ``targets``
    (area, low, high) by ``current`` (area, pct); an area without a share has 0.
    Percents have two digits; the delta is what is lacking to the middle."""
    pct, mid = F.round(F.coalesce("pct", F.lit(0.0)), 2), (F.col("low") + F.col("high")) / 2
    status = F.when(F.col("current_pct") < F.col("low"), "low").when(F.col("current_pct") > F.col("high"), "high").otherwise("ok")
    return targets.join(current, "area", "left").withColumn("current_pct", pct).select("area", "current_pct", mid.alias("target_mid_pct"), F.round(mid - F.col("current_pct"), 2).alias("delta_to_mid"), status.alias("status"))


_GOAL = ", ".join(f"('{a}', {lo}, {hi})" for a, lo, hi in TARGETS)
_AREAS = f"WITH f AS ({_flags_sql(tuple(a for a, _, _ in TARGETS))}), t AS (SELECT v.area, v.low, v.high, round(coalesce(f.pct, 0.0), 2) AS current_pct FROM (VALUES {_GOAL}) v(area, low, high) LEFT JOIN f ON f.flag = v.area)"


@query("target_mix_status", f"{_AREAS} SELECT area, current_pct, (low + high) / 2.0 AS target_mid_pct, round((low + high) / 2.0 - current_pct, 2) AS delta_to_mid, CASE WHEN current_pct < low THEN 'low' WHEN current_pct > high THEN 'high' ELSE 'ok' END AS status FROM t")
def target_mix_status(spark, d):
    """Each area's flag share; an area that is no flag would be a task's share."""
    targets = spark.createDataFrame([(a, float(lo), float(hi)) for a, lo, hi in TARGETS], "area string, low double, high double")
    flags = _flag_counts(spark, d, tuple(a for a, _, _ in TARGETS if a in C.FLAGS)).select(F.col("flag").alias("area"), "pct")
    tasks = [a for a, _, _ in TARGETS if a not in C.FLAGS]
    if tasks:
        flags = flags.unionByName(task_mix(spark, d).filter(F.col("primary_task").isin(tasks)).select(F.col("primary_task").alias("area"), "pct"))
    return target_status(flags, targets)


# An answer that is a letter, with at most one short word behind its mark.
LETTER_ONLY = rf"(?i)^{T.WS}*[\(\[]?{T.WS}*[A-D](?:[\)\].:\-]{T.WS}*{_NS}*)?{T.WS}*$"
# An answer that is a letter and one mark at most.
SINGLE_LETTER = rf"(?i)^{T.WS}*[A-D](?:[\).:\-])?{T.WS}*$"
BUCKETS = ("multiple_choice", "bench_hellaswag_like", "bench_winogrande_like", "bench_openbookqa_like")


@query("mc_compliance", f"WITH c AS (SELECT *, {_hit('o', LETTER_ONLY)} AS clean FROM ({_CLASSED})) " + " UNION ALL ".join(f"SELECT '{b}' AS bucket, count(*) FILTER ({b}) AS samples, count(*) FILTER ({b} AND clean) AS letter_only_outputs, round(100.0 * count(*) FILTER ({b} AND clean) / greatest(count(*) FILTER ({b}), 1), 2) AS compliance_pct FROM c" for b in BUCKETS))
def mc_compliance(spark, d):
    """How many answers of each multiple-choice bucket are one letter."""
    c = classified(spark, d).withColumn("clean", T.strip(T.text_of("output")).rlike(LETTER_ONLY))
    one = c.agg(*[x for b in BUCKETS for x in (F.count_if(b).alias(f"{b}_n"), F.count_if(F.col(b) & F.col("clean")).alias(f"{b}_clean"))])
    stacked = ", ".join(f"'{b}', {b}_n, {b}_clean" for b in BUCKETS)
    return one.selectExpr(f"stack({len(BUCKETS)}, {stacked}) as (bucket, samples, letter_only_outputs)").withColumn("compliance_pct", F.round(F.lit(100.0) * F.col("letter_only_outputs") / F.greatest("samples", F.lit(1)), 2))


@query("mc_compliance_by_source", f"SELECT source, count(*) AS n, count(*) FILTER (a) AS letter_only_count, round(100.0 * count(*) FILTER (a) / count(*), 2) AS letter_only_pct FROM (SELECT source, o <> '' AND length(o) <= 120 AND {_hit('o', C.LETTER_ANSWER)} AS a FROM ({_CLASSED}) WHERE multiple_choice OR {_among(C.CHOICE_SOURCES)}) GROUP BY source")
def mc_compliance_by_source(spark, d):
    o = T.strip(T.text_of("output"))
    rows = classified(spark, d).filter(F.col("multiple_choice") | F.coalesce(F.col("source").isin(*C.CHOICE_SOURCES), F.lit(False)))
    letter = (o != "") & (F.length(o) <= 120) & o.rlike(C.LETTER_ANSWER)
    by = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(letter).alias("letter_only_count"))
    return by.withColumn("letter_only_pct", F.round(F.lit(100.0) * F.col("letter_only_count") / F.col("n"), 2))


# ------------------------------------------------------ overview and risks


def whole_text(df: DataFrame) -> DataFrame:
    """``df`` with ``full_text``: the stripped fields joined by a blank line,
    and stripped, so empty ones leave nothing."""
    i, x, o = (T.strip(T.text_of(c)) for c in ("instruction", "input", "output"))
    gap = F.lit("\n\n")
    return df.withColumn("full_text", T.strip(F.concat(T.strip(F.concat(i, gap, x)), gap, o)))


_GAP = "chr(10)||chr(10)"
_WHOLE = f"SELECT c.*, {strip_sql(f'c.p || {_GAP} || o')} AS full_text, len(regexp_extract_all(o, '{_W}+')) AS output_words, t.truncated FROM ({_CLASSED}) c JOIN ({_TOK}) t USING (row_id)"


def measured(spark, d) -> DataFrame:
    """Classified rows with the digest of the whole text, words of the output
    and whether tokenising cut it."""
    rows = whole_text(classified(spark, d)).withColumns({"h": F.md5("full_text"), "output_words": T.word_count(T.strip(T.text_of("output")))})
    return rows.join(tokenised(spark, d).select("row_id", "truncated"), "row_id")


@query("mix_overview", f"WITH w AS ({_WHOLE}) SELECT count(*) AS n, count(DISTINCT source) AS n_sources, 100.0 * count(*) FILTER (x <> '') / count(*) AS has_input_pct, count(*) FILTER (i = '') AS empty_instruction, count(*) FILTER (o = '') AS empty_output, 100.0 * (count(*) - count(DISTINCT full_text)) / count(*) AS duplicate_pct, 100.0 * count(*) FILTER (truncated) / count(*) AS truncated_pct, 100.0 * count(*) FILTER (primary_task = 'unknown') / count(*) AS unknown_task_pct FROM w")
def mix_overview(spark, d):
    blank = lambda c: T.strip(T.text_of(c)) == ""
    # duplicates by digest, partially aggregated before the shuffle
    by = measured(spark, d).groupBy("h", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~blank("input")).alias("given"), F.count_if(blank("instruction")).alias("no_i"), F.count_if(blank("output")).alias("no_o"),
        F.count_if("truncated").alias("cut"), F.count_if(F.col("primary_task") == "unknown").alias("odd"),
    )
    one = by.groupBy("h").agg(*[F.sum(x).alias(x) for x in ("n", "given", "no_i", "no_o", "cut", "odd")], F.collect_set("source").alias("s"))
    total = F.sum("n")
    pct = lambda c: F.lit(100.0) * c / total
    return one.agg(
        total.alias("n"), F.size(F.array_distinct(F.flatten(F.collect_set("s")))).cast("long").alias("n_sources"), pct(F.sum("given")).alias("has_input_pct"), F.sum("no_i").alias("empty_instruction"),
        F.sum("no_o").alias("empty_output"), pct(total - F.count(F.lit(1))).alias("duplicate_pct"), pct(F.sum("cut")).alias("truncated_pct"), pct(F.sum("odd")).alias("unknown_task_pct"),
    )


RISKS = {
    "empty_output": "o = ''", "very_short_output": "output_words <= 1", "very_long_output_p95_plus": "output_words >= p95", "duplicate_full_text": "k > 1",
    "truncated": "truncated", "mc_output_not_single_letter": f"multiple_choice AND NOT {_hit('o', SINGLE_LETTER)}",
}


@query("risk_table", f"WITH w AS ({_WHOLE}), r AS (SELECT w.*, count(*) OVER (PARTITION BY full_text) AS k, (SELECT quantile_cont(output_words, 0.95) FROM w) AS p95 FROM w) " + " UNION ALL ".join(f"SELECT '{name}' AS risk, count(*) FILTER ({cond}) AS n, round(100.0 * count(*) FILTER ({cond}) / count(*), 2) AS pct FROM r" for name, cond in RISKS.items()))
def risk_table(spark, d):
    rows = measured(spark, d)
    o = T.strip(T.text_of("output"))
    p = rows.agg(F.percentile("output_words", F.lit(0.95)).alias("p"))
    copies = rows.groupBy("h").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("duplicate_full_text"))
    conditions = {
        "empty_output": o == "", "very_short_output": F.col("output_words") <= 1, "very_long_output_p95_plus": F.col("output_words") >= F.col("p"),
        "truncated": F.col("truncated"), "mc_output_not_single_letter": F.col("multiple_choice") & ~o.rlike(SINGLE_LETTER),
    }
    flags = rows.crossJoin(F.broadcast(p)).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in conditions.items()])  # one row
    one = flags.crossJoin(F.broadcast(copies))  # one row each
    stacked = ", ".join(f"'{k}', {k}" for k in RISKS)
    return one.selectExpr("total", f"stack({len(RISKS)}, {stacked}) as (risk, n)").select("risk", "n", F.round(F.try_divide(F.lit(100.0) * F.col("n"), F.col("total")), 2).alias("pct"))


# --------------------------------------------------------- samples of tasks

SHOWN_TASKS, SHOWN_ROWS = 8, 5
_ORDER = "md5('42|' || row_id), row_id"


@query("task_samples", f"WITH c AS ({_CLASSED}), top AS (SELECT primary_task FROM c GROUP BY 1 ORDER BY count(*) DESC, primary_task LIMIT {SHOWN_TASKS}) SELECT primary_task, row_id FROM c JOIN top USING (primary_task) QUALIFY row_number() OVER (PARTITION BY primary_task ORDER BY {_ORDER}) <= {SHOWN_ROWS}")
def task_samples(spark, d):
    """Some rows of each of the eight commonest tasks, in the seeded order."""
    from ..operators.sampling import order_key

    c = classified(spark, d).select("row_id", "primary_task")
    top = c.groupBy("primary_task").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "primary_task").limit(SHOWN_TASKS).select("primary_task")
    k = F.row_number().over(Window.partitionBy("primary_task").orderBy(order_key("row_id"), "row_id"))
    return c.join(F.broadcast(top), "primary_task").withColumn("k", k).filter(F.col("k") <= SHOWN_ROWS).select("primary_task", "row_id")  # eight rows
