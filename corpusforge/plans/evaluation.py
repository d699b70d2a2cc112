"""Queries of evaluation: scores, perplexity, preference; vectors of the
``embeddings`` table stand in for logits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scoring as S
from ..sources.tables import table
from .documents import _S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_L = "SELECT vec_id, i AS item, (embedding[i + 1] * 10)::DOUBLE AS logit, label FROM (SELECT vec_id, embedding, label, unnest(range(0, len(embedding))) AS i FROM embeddings)"


def logits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("item", "x"))
    return e.select("vec_id", F.col("item").cast("long").alias("item"), (F.col("x") * F.lit(10).cast("float")).cast("double").alias("logit"), "label")


@query("nucleus_filter", f"SELECT vec_id, count(*) AS n, sum(prob) AS mass FROM (SELECT *, coalesce(sum(prob) OVER (PARTITION BY vec_id ORDER BY logit DESC, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS prob FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM ({_L})))) WHERE b <= 0.9 GROUP BY vec_id")
def nucleus_filter(spark, d):
    return S.nucleus(logits(spark, d), "vec_id", "item", "logit", 0.9).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.sum("prob").alias("mass"))


@query("topk_logits", f"SELECT vec_id, item, logit FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) AS r FROM ({_L})) WHERE r <= 5")
def topk_logits(spark, d):
    return S.top_k(logits(spark, d), "vec_id", "logit", 5).select("vec_id", "item", "logit")


@query("argmax_accuracy", f"SELECT label, count(*) AS n, avg((item % 10 = label % 10)::INT) AS accuracy FROM (SELECT vec_id, label, max_by(item, (logit, -item)) AS item FROM ({_L}) GROUP BY vec_id, label) GROUP BY label")
def argmax_accuracy(spark, d):
    lg = logits(spark, d)
    best = S.choose(lg, "vec_id", "item", "logit").join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    return best.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("item") % 10 == F.col("label") % 10).cast("int")).alias("accuracy"))


@query("choice_scores", f"SELECT vec_id, item // 16 AS choice, avg(logit) AS score FROM ({_L}) GROUP BY 1, 2")
def choice_scores(spark, d):
    return S.mean_score(logits(spark, d).withColumn("choice", F.floor(F.col("item") / 16)), ["vec_id", "choice"], "logit")


@query("constrained_argmax", f"SELECT vec_id, max_by(item, (logit, -item)) AS item FROM ({_L}) WHERE item IN (3, 7, 11, 19) GROUP BY vec_id")
def constrained_argmax(spark, d):
    allowed = logits(spark, d).withColumn("logit", F.when(F.col("item").isin(3, 7, 11, 19), F.col("logit")))
    return S.choose(allowed, "vec_id", "item", "logit")


@query("constrained_fallback", f"SELECT vec_id, max_by(item, (ok, score, -item)) AS item FROM (SELECT *, item IN (3, 7, 11, 19) AND label % 2 <> 0 AS ok, CASE WHEN item IN (3, 7, 11, 19) AND label % 2 = 0 THEN '-infinity'::DOUBLE ELSE logit END AS score FROM ({_L})) GROUP BY vec_id")
def constrained_fallback(spark, d):
    """The same where vectors of even labels have minus infinity at all that is allowed."""
    dead = F.col("item").isin(3, 7, 11, 19) & (F.col("label") % 2 == 0)
    lg = logits(spark, d).withColumn("score", F.when(dead, float("-inf")).otherwise(F.col("logit")))
    return S.choose_allowed(lg, "vec_id", "item", "score", (3, 7, 11, 19))


@query("repetition_penalty", f"SELECT vec_id, sum(CASE WHEN item % 3 = 0 AND logit < 0 THEN logit * 1.3 WHEN item % 3 = 0 THEN logit / 1.3 ELSE logit END) AS total FROM ({_L}) GROUP BY vec_id")
def repetition_penalty(spark, d):
    return logits(spark, d).groupBy("vec_id").agg(F.sum(S.penalise(F.col("logit"), F.col("item") % 3 == 0, 1.3)).alias("total"))


_N = f"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text,''), '{_S}+'), lambda x: x <> '')) AS n FROM documents"


@query("perplexity_windows", f"SELECT doc_id, s AS start, e AS \"end\", f AS score_from, greatest(0, e - f) AS n_scored FROM (SELECT doc_id, s, least(s + 256, n - 1) AS e, CASE WHEN s = 0 THEN 0 ELSE s + 128 END AS f FROM (SELECT doc_id, n, unnest(range(0, n - 1, 128)) AS s FROM ({_N}) WHERE n > 1))")
def perplexity_windows(spark, d):
    n = table(spark, d, "documents").select("doc_id", F.size(T.split_words("text")).cast("long").alias("n"))
    return S.windows(n, "doc_id", "n", 256, 128)


@query("perplexity", f"SELECT label, exp(sum(-least(logit, 0)) / count(*)) AS ppl, sum(-least(logit, 0)) / greatest(count(*) FILTER (item % 5 <> 0), 1) AS ce FROM ({_L}) GROUP BY label")
def perplexity(spark, d):
    nll = -F.least(F.col("logit"), F.lit(0.0))
    return logits(spark, d).groupBy("label").agg(F.exp(F.sum(nll) / F.count(F.lit(1))).alias("ppl"), (F.sum(nll) / F.greatest(F.count_if(F.col("item") % 5 != 0), F.lit(1))).alias("ce"))


_JOINED = f"SELECT string_agg(text, chr(10)||chr(10) ORDER BY item_id) AS t FROM eval_items WHERE eval_set = 'wikitext' AND regexp_replace(coalesce(text,''), '{_S}+', '', 'g') <> ''"


@query("perplexity_text", f"SELECT n, windows, scored FROM (SELECT least(len(list_filter(regexp_split_to_array(t, '{_S}+'), lambda x: x <> '')), 1000) AS n FROM ({_JOINED})), LATERAL (SELECT count(*) AS windows, sum(greatest(0, least(s + 256, n - 1) - CASE WHEN s = 0 THEN 0 ELSE s + 128 END))::BIGINT AS scored FROM (SELECT unnest(range(0, n - 1, 128)) AS s))")
def perplexity_text(spark, d):
    """One evaluation text of a set's rows that are not blank, joined by blank
    lines and cut to 1,000 words, in windows: a set of some hundred items is one text."""
    rows = table(spark, d, "eval_items").filter("eval_set = 'wikitext'").filter(T.strip(T.text_of("text")) != "")
    text = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]), "\n\n").alias("t"))
    n = text.select(F.lit(1).alias("id"), F.least(F.size(T.split_words("t")), F.lit(1000)).cast("long").alias("n"))
    return S.windows(n, "id", "n", 256, 128).agg(F.count(F.lit(1)).alias("windows"), F.sum("n_scored").alias("scored")).crossJoin(F.broadcast(n)).select("n", "windows", "scored")  # one row each


_D = "SELECT vec_id, embedding[1]::DOUBLE * 10 AS pi_c, embedding[2]::DOUBLE * 10 AS pi_r, embedding[3]::DOUBLE * 10 AS ref_c, embedding[4]::DOUBLE * 10 AS ref_r FROM embeddings"


def preferences(spark, d):
    return table(spark, d, "embeddings").select("vec_id", *[(F.col("embedding")[i].cast("double") * 10).alias(x) for i, x in enumerate(("pi_c", "pi_r", "ref_c", "ref_r"))])


@query("dpo_metrics", f"SELECT vec_id, a AS advantage, 0.1 * (pi_c - ref_c) - 0.1 * (pi_r - ref_r) AS margin, ln(1 + exp(-0.1 * a)) AS loss FROM (SELECT *, (pi_c - pi_r) - (ref_c - ref_r) AS a FROM ({_D}))")
def dpo_metrics(spark, d):
    return S.preference(preferences(spark, d)).select("vec_id", "advantage", "margin", "loss")


@query("dpo_summary", f"SELECT avg((0.1 * (pi_c - ref_c) > 0.1 * (pi_r - ref_r))::INT) AS accuracy, avg(0.1 * (pi_c - ref_c) - 0.1 * (pi_r - ref_r)) AS margin, avg(power((pi_c - pi_r) - (ref_c - ref_r) - 5, 2)) AS ipo_loss FROM ({_D})")
def dpo_summary(spark, d):
    p = S.preference(preferences(spark, d), kind="ipo")
    return p.agg(F.avg((F.col("reward_c") > F.col("reward_r")).cast("int")).alias("accuracy"), F.avg("margin").alias("margin"), F.avg("loss").alias("ipo_loss"))


@query("sequence_logprob", "SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN i % 4 = 0 THEN 0.0 ELSE embedding[i]::DOUBLE END)) AS total FROM embeddings")
def sequence_logprob(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double")).alias("p"), F.transform(F.sequence(F.lit(0), F.lit(32)), lambda i: F.when(i % 4 == 0, -100).otherwise(i)).alias("l"))
    return e.select("vec_id", S.sequence_logprob("p", "l").alias("total"))


@query("lambada_split", "SELECT item_id, regexp_extract(text, '(?s)^(.*) (.*)$', 2) AS target, length(regexp_extract(text, '(?s)^(.*) (.*)$', 1)) AS n_context FROM eval_items WHERE eval_set = 'lambada'")
def lambada_split(spark, d):
    i = table(spark, d, "eval_items").filter("eval_set = 'lambada'")
    return i.select("item_id", F.regexp_extract("text", "(?s)^(.*) (.*)$", 2).alias("target"), F.length(F.regexp_extract("text", "(?s)^(.*) (.*)$", 1)).cast("long").alias("n_context"))


@query("winogrande_split", "SELECT item_id, left(text, strpos(text, '_') - 1) AS head, substr(text, strpos(text, '_') + 1) AS tail, replace(text, '_', choices[1]) AS filled FROM eval_items WHERE eval_set = 'winogrande'")
def winogrande_split(spark, d):
    i = table(spark, d, "eval_items").filter("eval_set = 'winogrande'")
    at = F.instr("text", "_")
    return i.select("item_id", F.substring("text", F.lit(1), at - 1).alias("head"), F.substring("text", at + 1, F.length("text")).alias("tail"), F.replace("text", F.lit("_"), F.col("choices")[0]).alias("filled"))


# What guessing scores.
BASELINES = (("hellaswag", 0.25), ("winogrande", 0.5), ("openbookqa", 0.25), ("lambada", 0.0))
_V = ", ".join(f"('{k}', {v})" for k, v in BASELINES)
_GOLD = "SELECT item_id, eval_set, len(choices) AS k, CASE WHEN eval_set = 'hellaswag' THEN try_cast(answer AS INT) WHEN regexp_matches(answer, '^[1-9]$') THEN answer::INT - 1 WHEN regexp_matches(answer, '^[A-J]$') THEN strpos('ABCDEFGHIJ', answer) - 1 END AS gold FROM eval_items WHERE choices IS NOT NULL"


def gold_choices(spark, d):
    """(item_id, eval_set, k, gold): items with choices, and the number of the right one."""
    a = F.col("answer")
    gold = F.when(F.col("eval_set") == "hellaswag", a.try_cast("int")).when(a.rlike("^[1-9]$"), a.try_cast("int") - 1).when(a.rlike("^[A-J]$"), F.instr(F.lit("ABCDEFGHIJ"), a) - 1)
    return table(spark, d, "eval_items").filter("choices is not null").select("item_id", "eval_set", F.size("choices").alias("k"), gold.alias("gold"))


@query("benchmark_rollup", f"SELECT g.eval_set, count(*) AS n, avg((g.gold = c.choice)::INT) AS score, max(b) AS baseline FROM ({_GOLD}) g JOIN (SELECT item_id, max_by(choice, (score, -choice)) AS choice FROM (SELECT g.item_id, l.item // 16 AS choice, avg(l.logit) AS score FROM ({_GOLD}) g JOIN ({_L}) l ON l.vec_id = g.item_id % (SELECT count(*) FROM embeddings) WHERE l.item // 16 < g.k GROUP BY 1, 2) GROUP BY item_id) c USING (item_id) LEFT JOIN (VALUES {_V}) v(eval_set, b) ON v.eval_set = g.eval_set GROUP BY g.eval_set")
def benchmark_rollup(spark, d):
    """Accuracy of each set against guessing: the choice of greatest mean score
    is compared with the answer; sixteen values of a vector score each choice."""
    base = spark.createDataFrame(BASELINES, "eval_set string, baseline double")
    gold = gold_choices(spark, d)
    n = table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n_vec"))
    keyed = gold.crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("item_id") % F.col("n_vec"))  # one row
    scored = keyed.select("item_id", "k", "vec_id").join(logits(spark, d), "vec_id").withColumn("choice", F.floor(F.col("item") / 16)).filter("choice < k")
    best = S.choose(S.mean_score(scored, ["item_id", "choice"], "logit"), "item_id", "choice", "score")
    by = gold.join(best, "item_id").groupBy("eval_set").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gold") == F.col("choice")).cast("int")).alias("score"))
    return by.join(F.broadcast(base), "eval_set", "left")


@query("lambada_accuracy", f"SELECT count(*) AS n, avg((lower(trim(guess)) = lower(trim(target)))::INT) AS accuracy FROM (SELECT regexp_extract(text, '(?s)^(.*) (.*)$', 2) AS target, answer AS guess FROM eval_items WHERE eval_set = 'lambada' AND answer IS NOT NULL)")
def lambada_accuracy(spark, d):
    """How many last words are the guessed one, but for case and outer blanks; the answer stands in for the guess."""
    i = lambada_split(spark, d).join(table(spark, d, "eval_items").select("item_id", F.col("answer").alias("guess")), "item_id").filter("guess is not null")
    return i.agg(F.count(F.lit(1)).alias("n"), F.avg((F.lower(F.trim("guess")) == F.lower(F.trim("target"))).cast("int")).alias("accuracy"))


@query("val_by_source", f"SELECT source, sum(-least(logit, 0)) / count(*) AS loss, exp(least(sum(-least(logit, 0)) / count(*), 20)) AS perplexity FROM ({_L}) l JOIN (SELECT row_id % (SELECT count(*) FROM embeddings) AS vec_id, source FROM sft_rows) s USING (vec_id) GROUP BY source")
def val_by_source(spark, d):
    """Mean loss and capped perplexity of each source; vectors stand in for the tokens' scores."""
    n = table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n_vec"))
    nll = -F.least(F.col("logit"), F.lit(0.0))
    per = logits(spark, d).groupBy("vec_id").agg(F.sum(nll).alias("s"), F.count(F.lit(1)).alias("c"))
    rows = table(spark, d, "sft_rows").select("source", "row_id").crossJoin(F.broadcast(n)).groupBy("source", (F.col("row_id") % F.col("n_vec")).alias("vec_id")).agg(F.count(F.lit(1)).alias("w"))  # one row
    by = rows.join(per, "vec_id").groupBy("source").agg((F.sum(F.col("s") * F.col("w")) / F.sum(F.col("c") * F.col("w"))).alias("loss"))
    return by.withColumn("perplexity", F.exp(F.least("loss", F.lit(20.0))))


@query("response_lengths", f"SELECT source, count(*) AS n, avg(w) AS mean, stddev_pop(w) AS std, min(w) AS least, max(w) AS most FROM (SELECT source, len(list_filter(regexp_split_to_array(coalesce(output,''), '{_S}+'), lambda x: x <> '')) AS w FROM sft_rows) GROUP BY source")
def response_lengths(spark, d):
    w = table(spark, d, "sft_rows").select("source", F.size(T.split_words("output")).cast("long").alias("w"))
    return w.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"), F.min("w").alias("least"), F.max("w").alias("most"))
