"""Queries over datasets as instruction rows, corpora as one, and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import loaders as L
from ..functions import prompts as R
from ..functions import text as T
from ..operators import sampling
from ..sources.files import Source
from ..sources.tables import table
from .evaluation import _GOLD, gold_choices
from .instructions import _OPTS, items, sft, strip_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_BREAK = "chr(10)||chr(10)"


def _digest(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.md5("instruction").alias("instruction_md5"), F.md5("input").alias("input_md5"), "output")


# ---------------------------------------------------------- multiple choice

_LETTERED = f"SELECT e.item_id, e.eval_set, text, choices, substr('ABCDEFGHIJ', (g.gold + 1)::INT, 1) AS letter FROM eval_items e JOIN ({_GOLD}) g USING (item_id)"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Items with choices as the datasets deliver them: letters, numbers, structs of texts and labels."""
    gold = gold_choices(spark, d).select("item_id", "gold")
    rows = items(spark, d).filter("choices is not null").join(gold, "item_id")
    letters = F.slice(F.array(*[F.lit(x) for x in R.LETTERS]), F.lit(1), F.size("choices"))
    return rows.select("item_id", "eval_set", "text", "answer", "gold", F.struct(F.col("choices").alias("text"), letters.alias("label")).alias("choices"))


def _mc_sql(where: str, tail: str = "") -> str:
    return f"SELECT item_id, md5({strip_sql('text')} || {_BREAK} || {_OPTS}) AS instruction_md5, letter AS output FROM ({_LETTERED}) WHERE {where}{tail}"


@query("load_openbookqa", _mc_sql("eval_set = 'openbookqa' AND len(choices) = 4"))
def load_openbookqa(spark, d):
    rows = labelled(spark, d).filter("eval_set = 'openbookqa'").withColumnsRenamed({"text": "question_stem", "answer": "answerKey"})
    return L.openbookqa(rows, ("item_id",)).select("item_id", F.md5("instruction").alias("instruction_md5"), "output")


@query("load_arc", _mc_sql("len(choices) = 4"))
def load_arc(spark, d):
    """All items of four choices, keyed by number from 1 as some of that dataset are."""
    rows = labelled(spark, d).withColumnRenamed("text", "question").withColumn("answerKey", (F.col("gold") + 1).cast("string"))
    return L.arc(rows, ("item_id",)).select("item_id", F.md5("instruction").alias("instruction_md5"), "output")


@query("load_winogrande", f"SELECT item_id, md5({strip_sql('text')} || {_BREAK} || {_OPTS}) AS instruction_md5, md5('Context: ' || {strip_sql('text')} || chr(10) || {_OPTS} || chr(10) || 'Respond with only \"A\" or \"B\".' || chr(10) || 'Answer:') AS prompt_md5, letter AS output FROM ({_LETTERED}) WHERE eval_set = 'winogrande'")
def load_winogrande(spark, d):
    o = F.col("choices")
    rows = items(spark, d).filter("eval_set = 'winogrande'").select("item_id", F.col("text").alias("sentence"), o[0].alias("option1"), o[1].alias("option2"), "answer")
    return L.winogrande(rows, ("item_id",)).select("item_id", F.md5("instruction").alias("instruction_md5"), F.md5("raw_prompt").alias("prompt_md5"), "output")


@query("load_hellaswag", _mc_sql("eval_set = 'hellaswag' AND len(choices) = 4"))
def load_hellaswag(spark, d):
    """The context in its two parts: cut behind the first sentence, or whole and nothing."""
    cut = F.split("text", "(?<=[.!?]) ", 2)
    rows = items(spark, d).filter("eval_set = 'hellaswag'").select("item_id", cut[0].alias("ctx_a"), F.try_element_at(cut, F.lit(2)).alias("ctx_b"), F.col("choices").alias("endings"), F.col("answer").alias("label"))
    return L.hellaswag(rows, ("item_id",)).select("item_id", F.md5("instruction").alias("instruction_md5"), "output")


_SCI = "list_sort(list_transform([0, 1, 2, 3], lambda i: md5('42|sciq|' || item_id || '|' || coalesce(text, '') || '|' || i) || i))"


@query("load_sciq", f"SELECT item_id, substr('ABCD', list_position(list_transform({_SCI}, lambda z: substr(z, 33)), '0')::INT, 1) AS output FROM eval_items WHERE choices IS NOT NULL AND len(choices) = 4 AND len(list_filter(choices, lambda x: {strip_sql('x')} = '')) = 0")
def load_sciq(spark, d):
    """Items of four choices, the first as the correct answer and the others as distractors."""
    o = F.col("choices")
    rows = items(spark, d).filter("choices is not null and size(choices) = 4").select("item_id", F.col("text").alias("question"), o[0].alias("correct_answer"), *[o[k].alias(f"distractor{k}") for k in (1, 2, 3)])
    return L.sciq(rows, ("item_id",), "item_id").select("item_id", "output")


# --------------------------------------------------------------- instructions


@query("load_alpaca", "SELECT row_id, md5(coalesce(instruction, '')) AS instruction_md5, md5(coalesce(input, '')) AS input_md5, coalesce(output, '') AS output FROM sft_rows WHERE source = 'alpaca'")
def load_alpaca(spark, d):
    return _digest(L.alpaca(sft(spark, d).filter("source = 'alpaca'"), ("row_id",)), "row_id")


@query("load_dolly", f"SELECT row_id, md5({strip_sql('instruction')}) AS instruction_md5, md5({strip_sql('input')}) AS input_md5, {strip_sql('output')} AS output FROM sft_rows WHERE source = 'dolly' AND {strip_sql('instruction')} <> '' AND {strip_sql('output')} <> ''")
def load_dolly(spark, d):
    rows = sft(spark, d).filter("source = 'dolly'").select("row_id", "instruction", F.col("input").alias("context"), F.col("output").alias("response"))
    return _digest(L.dolly(rows, ("row_id",)), "row_id")


def tree_messages(spark, d) -> DataFrame:
    """The pairs of one source as message trees: a prompt answers the reply of
    the pair before it in its thousand of ids; for the fields that the table lacks and the filter reads, others stand in."""
    rows = sft(spark, d).filter("source = 'oasst1'")
    before = F.lag("row_id").over(Window.partitionBy(F.floor(F.col("row_id") / 1000)).orderBy("row_id"))
    rows = rows.withColumns({"p": before, "lang": F.when(F.col("input").isNull(), "xx").otherwise("en"), "deleted": F.col("worker_id").isNull(), "synthetic": F.when(F.length("instruction") > 300, True), "tree_state": F.when(F.col("created_date").isNull(), "growing").otherwise("ready_for_export")})
    shared = ["lang", "deleted", "synthetic", "tree_state", "review_result", "created_date"]
    counts = [F.when(F.length("output") % 4 > 0, F.length("output") % 4).alias("rank"), F.lit(None).cast("int").alias("review_count")]
    asked = rows.select(F.concat(F.lit("u"), "row_id").alias("message_id"), F.coalesce(F.concat(F.lit("a"), "p"), F.lit("")).alias("parent_id"), F.lit("prompter").alias("role"), F.col("instruction").alias("text"), *shared, *counts)
    said = rows.select(F.concat(F.lit("a"), "row_id").alias("message_id"), F.concat(F.lit("u"), "row_id").alias("parent_id"), F.lit("assistant").alias("role"), F.col("output").alias("text"), *shared, *counts)
    return asked.unionByName(said)


_TREE_ROWS = f"SELECT row_id, lag(row_id) OVER (PARTITION BY row_id // 1000 ORDER BY row_id) AS p, {strip_sql('instruction')} AS i, {strip_sql('output')} AS o, (input IS NOT NULL AND worker_id IS NOT NULL AND created_date IS NOT NULL AND length(coalesce(instruction,'')) <= 300 AND coalesce(review_result, false)) AS fine FROM sft_rows WHERE source = 'oasst1'"
_MESSAGES = f"SELECT 'u' || row_id AS id, 'a' || p AS parent, 'prompter' AS role, i AS text FROM ({_TREE_ROWS}) WHERE fine AND i <> '' UNION ALL SELECT 'a' || row_id, 'u' || row_id, 'assistant', o FROM ({_TREE_ROWS}) WHERE fine AND o <> ''"


@query("oasst_usable", f"SELECT id AS message_id, role FROM ({_MESSAGES})")
def oasst_usable(spark, d):
    return L.usable(tree_messages(spark, d)).select("message_id", "role")


@query("oasst_replies", f"WITH m AS ({_MESSAGES}) SELECT a.id AS message_id FROM m a JOIN m u ON a.parent = u.id WHERE a.role = 'assistant' AND u.role = 'prompter'")
def oasst_replies(spark, d):
    return L.replies(L.usable(tree_messages(spark, d))).select("message_id")


@query(
    "load_oasst1",
    f"WITH RECURSIVE m AS ({_MESSAGES}), t AS (SELECT id, role, text, 1 AS depth, NULL::VARCHAR AS asked, '' AS before FROM m WHERE parent IS NULL AND role = 'prompter' UNION ALL "
    "SELECT m.id, m.role, m.text, t.depth + 1, t.text, CASE WHEN t.depth = 1 THEN '' ELSE t.before || chr(10)||chr(10) || CASE WHEN t.role = 'prompter' THEN 'Assistant' ELSE 'User' END || ':' || chr(10) || t.asked END FROM m JOIN t ON m.parent = t.id AND m.role <> t.role) "
    "SELECT id AS message_id, md5(asked) AS instruction_md5, md5(CASE WHEN before = '' THEN '' ELSE 'Previous conversation:' || before END) AS input_md5, text AS output FROM t WHERE role = 'assistant'",
)
def load_oasst1(spark, d):
    return _digest(L.oasst1(tree_messages(spark, d)), "message_id")


@query("load_hh_pairs", f"SELECT row_id, {strip_sql('instruction')} AS prompt, md5({strip_sql('output')}) AS chosen_md5, md5({strip_sql('left(output, 30)')}) AS rejected_md5 FROM sft_rows WHERE source = 'hh' AND {strip_sql('instruction')} <> '' AND {strip_sql('output')} <> '' AND {strip_sql('left(output, 30)')} <> ''")
def load_hh_pairs(spark, d):
    """Transcripts of two turns; the rejected one ends early."""
    head = F.concat(F.lit("\n\nHuman: hello\n\nAssistant: yes\n\nHuman: "), T.text_of("instruction"), F.lit("\n\nAssistant: "))
    rows = sft(spark, d).filter("source = 'hh'").select("row_id", F.concat(head, T.text_of("output")).alias("chosen"), F.concat(head, F.substring(T.text_of("output"), 1, 30)).alias("rejected"))
    return L.hh_pairs(rows, ("row_id",)).select("row_id", "prompt", F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))


@query("load_orca_pairs", f"SELECT row_id, {strip_sql('instruction')} AS prompt FROM sft_rows WHERE source = 'orca' AND review_result AND {strip_sql('instruction')} <> '' AND {strip_sql('output')} <> '' AND {strip_sql('left(output, 30)')} <> ''")
def load_orca_pairs(spark, d):
    rows = sft(spark, d).filter("source = 'orca'").select("row_id", F.when(F.col("review_result"), "winner").otherwise("TIE ").alias("status"), F.col("instruction").alias("input"), F.col("output").alias("chosen"), F.substring("output", 1, 30).alias("rejected"))
    return L.orca_pairs(rows, ("row_id",)).select("row_id", "prompt")


# -------------------------------------------------------- splits and lengths

_LEN = "length(coalesce(instruction,'')) AS p, length(coalesce(output,'')) AS c, length(coalesce(output,'')) // 2 AS r"


@query("dpo_split", "SELECT row_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || row_id), row_id) <= greatest(1, floor(count(*) OVER () * 0.05)) THEN 'val' ELSE 'train' END AS split FROM sft_rows")
def dpo_split(spark, d):
    return sampling.split_pooled(sft(spark, d).select("row_id")).select("row_id", "split")


@query("dpo_pair_lengths", f"SELECT avg(p) AS prompt_mean, median(p) AS prompt_median, avg(c) AS chosen_mean, median(c) AS chosen_median, avg(r) AS rejected_mean, median(r) AS rejected_median, avg(c - r) AS difference_mean FROM (SELECT {_LEN} FROM sft_rows) WHERE c > 0")
def dpo_pair_lengths(spark, d):
    """Lengths of prompts, chosen and rejected answers (half of each stands in), and how much longer the chosen are."""
    c = F.length(T.text_of("output"))
    rows = sft(spark, d).select(F.length(T.text_of("instruction")).alias("p"), c.alias("c"), F.floor(c / 2).alias("r")).filter("c > 0")
    each = [x for n, k in (("prompt", "p"), ("chosen", "c"), ("rejected", "r")) for x in (F.avg(k).alias(f"{n}_mean"), F.median(k).alias(f"{n}_median"))]
    return rows.agg(*each, F.avg(F.col("c") - F.col("r")).alias("difference_mean"))


_MIX = "100.0 * count(*) FILTER (source IN ('arc','openbookqa','sciq','winogrande','hellaswag')) / count(*) AS mc_pct, 100.0 * count(*) FILTER (source = 'oasst1') / count(*) AS chat_pct, 100.0 * count(*) FILTER (source = 'lambada_like') / count(*) AS cloze_pct"


@query("source_counts", "SELECT source, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM sft_rows GROUP BY source")
def source_counts(spark, d):
    by = sft(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a source


@query("source_shares", f"SELECT {_MIX} FROM sft_rows")
def source_shares(spark, d):
    """Shares of multiple choice, chat and cloze by the rows' sources."""
    from ..functions.classify import CHOICE_SOURCES, CLOZE_SOURCES

    s = F.col("source")
    pct = lambda c: F.try_divide(F.lit(100.0) * F.count_if(c), F.count(F.lit(1)))
    return sft(spark, d).agg(pct(s.isin(*CHOICE_SOURCES)).alias("mc_pct"), pct(s == "oasst1").alias("chat_pct"), pct(s.isin(*CLOZE_SOURCES)).alias("cloze_pct"))


# ------------------------------------------------------------------ corpora

_BUDGETS = "SELECT name, greatest(1, floor(floor(ratio * 200000) * 4.0 * 1.10 / CASE name WHEN 'wikipedia' THEN 8000 WHEN 'bookcorpus' THEN 5000 WHEN 'fineweb' THEN 2500 WHEN 'fineweb_edu' THEN 2500 ELSE 2000 END)) AS n_docs FROM source_configs"


@query("multi_source_ingest", f"SELECT doc_id, source, md5(text) AS text_md5 FROM (SELECT doc_id, source, text, n_docs FROM documents JOIN ({_BUDGETS}) b ON source = name QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) <= n_docs) WHERE text IS NOT NULL AND text <> ''")
def multi_source_ingest(spark, d):
    """Every configured source as a corpus of its own, with a text column of its own name."""
    configs = [Source(r["name"], r["hf_dataset_id"], r["hf_subset"], r["hf_split"], r["text_column"], r["ratio"]) for r in table(spark, d, "source_configs").collect()]  # a row a source
    docs = table(spark, d, "documents")
    if not configs:
        return docs.limit(0).select("doc_id", "source", F.md5("text").alias("text_md5"))
    return L.ingest(configs, lambda s: docs.filter(F.col("source") == s.name).select("doc_id", F.col("text").alias(s.text_column)), 200_000).select("doc_id", "source", F.md5("text").alias("text_md5"))


# --------------------------------------------------------------------- chat

_U, _A = strip_sql("instruction"), strip_sql("output")
_HEAD = f"'{R.OPENING}' || {_BREAK}"


def _turns(spark, d) -> DataFrame:
    """Rows with their own pair as history and their input as the message."""
    past = F.array(F.struct(T.strip(T.text_of("instruction")).alias("user"), T.strip(T.text_of("output")).alias("assistant")))
    return sft(spark, d).select("row_id", F.coalesce(F.nullif("input", F.lit("")), F.lit("go on")).alias("m"), past.alias("h"))


_M = strip_sql("coalesce(nullif(input,''), 'go on')")


@query("chat_prompt", f"SELECT row_id, md5({_M}) AS raw_md5, md5({_HEAD} || '### Instruction:' || chr(10) || {_U} || {_BREAK} || '### Response:' || chr(10) || {_A} || {_BREAK} || '### Instruction:' || chr(10) || {_M} || {_BREAK} || '### Response:' || chr(10)) AS alpaca_md5, md5('User: ' || {_U} || CASE WHEN {_A} <> '' THEN chr(10) || 'Assistant: ' || {_A} ELSE '' END || chr(10) || 'User: ' || {_M} || chr(10) || 'Assistant:') AS simple_md5 FROM sft_rows")
def chat_prompt(spark, d):
    rows = _turns(spark, d)
    return rows.select("row_id", *[F.md5(L.chat_prompt("m", "h", t)).alias(f"{t}_md5") for t in ("raw", "alpaca", "simple")])


# ------------------------------------------------------------ small scalars


@query("word_counts", "SELECT row_id, len(regexp_extract_all(coalesce(instruction,''), '[\\p{L}\\p{Nl}\\p{M}\\p{Nd}\\p{Pc}\\x{200c}\\x{200d}]+'))::INT AS n_words FROM sft_rows")
def word_counts(spark, d):
    return sft(spark, d).select("row_id", T.word_count("instruction").alias("n_words"))


_FLAT = strip_sql("regexp_replace(coalesce(text,''), '[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')")


@query("previews", f"SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 79) || '...' ELSE t END AS preview FROM (SELECT doc_id, {_FLAT} AS t FROM documents)")
def previews(spark, d):
    return table(spark, d, "documents").select("doc_id", T.preview("text").alias("preview"))


@query("model_names", "SELECT DISTINCT run_name, split_part(run_name, '_', 1) || '_' || run_name || '_best' AS nested, run_name AS plain FROM train_metrics")
def model_names(spark, d):
    runs = table(spark, d, "train_metrics").select("run_name").distinct()
    phase = F.split("run_name", "_")[0]
    return runs.select("run_name", T.model_name(F.concat(F.lit("/x/checkpoints/"), phase, F.lit("/"), "run_name", F.lit("/best.pt"))).alias("nested"), T.model_name(F.concat(F.lit("/other/"), "run_name", F.lit(".bin"))).alias("plain"))


_NOTED = "coalesce(output,'x') || chr(10) || chr(10) || 'tokens/s: 12.50' || chr(10)"


@query("stats_footers", f"SELECT row_id, md5(regexp_replace({_NOTED}, '(?i)(?:[ \\t-\\r]*(?:^|\\n)[ \\t]*tokens/s:[^\\n]*)*[ \\t-\\r]*$', '')) AS body_md5 FROM sft_rows")
def stats_footers(spark, d):
    """Answers with a footer put on, and taken off again."""
    noted = F.concat(F.coalesce("output", F.lit("x")), F.lit("\n\ntokens/s: 12.50\n"))
    return sft(spark, d).select("row_id", F.md5(T.strip_footer(noted)).alias("body_md5"))
