"""Queries over instruction pairs and evaluation items: prompts, multiple
choice, conversations, cleaning, tasks, and the mix of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import prompts as R
from ..functions import text as T
from ..operators import decontam, packing, sampling
from ..session import checkpoint_dir
from ..sources.tables import spread, table
from .documents import _ENGLISH_SQL, _S, _chain, clean_sql, hashed_ids, re2

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def sft(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sft_rows")


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items")


def strip_sql(x: str) -> str:
    return f"regexp_replace(coalesce({x},''), '^{_S}+|{_S}+$', '', 'g')"


# ------------------------------------------------------------------ prompts

_ALPACA = f"CASE WHEN {strip_sql('input')} <> '' THEN '{R.OPENING_WITH_INPUT}' || chr(10)||chr(10)||'### Instruction:'||chr(10)||{strip_sql('instruction')}||chr(10)||chr(10)||'### Input:'||chr(10)||{strip_sql('input')}||chr(10)||chr(10)||'### Response:'||chr(10) ELSE '{R.OPENING}' || chr(10)||chr(10)||'### Instruction:'||chr(10)||{strip_sql('instruction')}||chr(10)||chr(10)||'### Response:'||chr(10) END"


@query("alpaca_prompt", f"SELECT row_id, md5({_ALPACA}) AS prompt_md5 FROM sft_rows")
def alpaca_prompt(spark, d):
    return sft(spark, d).select("row_id", F.md5(R.alpaca("instruction", "input")).alias("prompt_md5"))


_PARSED = r"(?s)### Instruction:\n(.*?)\n\n(?:### Input:\n(.*?)\n\n)?### Response:\n"


@query("alpaca_parse", f"SELECT row_id, regexp_extract(p, '{_PARSED}', 1) AS instruction, regexp_extract(p, '{_PARSED}', 2) AS input FROM (SELECT row_id, {_ALPACA} AS p FROM sft_rows)")
def alpaca_parse(spark, d):
    return sft(spark, d).select("row_id", R.alpaca("instruction", "input").alias("p")).select("row_id", *[c.alias(k) for k, c in R.alpaca_parts("p").items()])


_OPTS = f"array_to_string(list_transform(choices, lambda x, i: substr('ABCDEFGHIJ', i::INT, 1) || ') ' || {strip_sql('x')}), chr(10))"


@query("mc_instruction", f"SELECT item_id, md5({strip_sql('text')} || chr(10)||chr(10) || {_OPTS}) AS prompt_md5 FROM eval_items WHERE choices IS NOT NULL")
def mc_instruction(spark, d):
    return items(spark, d).filter("choices is not null").select("item_id", F.md5(R.choice_instruction("text", "choices")).alias("prompt_md5"))


@query("mc_prompt", f"SELECT item_id, md5('Context: ' || {strip_sql('text')} || chr(10) || {_OPTS} || chr(10) || 'Answer:') AS prompt_md5 FROM eval_items WHERE choices IS NOT NULL")
def mc_prompt(spark, d):
    return items(spark, d).filter("choices is not null").select("item_id", F.md5(R.choice_prompt("text", "choices")).alias("prompt_md5"))


@query("choice_letter", "SELECT item_id, CASE WHEN len(choices) <> 4 THEN NULL WHEN regexp_matches(trim(answer), '^[ABCDabcd]$') THEN upper(trim(answer)) WHEN regexp_matches(trim(answer), '^[1-4]$') THEN substr('ABCD', trim(answer)::INT, 1) END AS letter FROM eval_items WHERE choices IS NOT NULL")
def choice_letter(spark, d):
    labels = F.slice(F.array(*[F.lit(x) for x in R.LETTERS]), F.lit(1), F.size("choices"))
    return items(spark, d).filter("choices is not null").select("item_id", R.choice_letter("answer", labels).alias("letter"))


@query("mc_shuffled_options", "SELECT item_id, list_position(list_transform(list_sort(list_transform(choices, lambda x: md5('7|' || item_id || '|' || x) || x)), lambda x: substr(x, 33)), choices[1])::BIGINT AS place FROM eval_items WHERE choices IS NOT NULL AND len(choices) = 4")
def mc_shuffled_options(spark, d):
    """Options in a seeded order; where the first one now stands."""
    keyed = F.transform("choices", lambda x: F.concat(F.md5(F.concat(F.lit("7|"), F.col("item_id").cast("string"), F.lit("|"), x)), x))
    order = F.transform(F.array_sort(keyed), lambda x: F.substring(x, 33, 1_000_000))
    return items(spark, d).filter("choices is not null and size(choices) = 4").select("item_id", F.array_position(order, F.col("choices")[0]).alias("place"))


_MARKED = "regexp_replace(translate(coalesce(instruction,''), chr(1)||chr(2), ''), '" + re2(P.LABEL) + "', chr(1)||'\\1\\2'||chr(2), 'g')"


@query("mc_options", f"SELECT row_id, letter, option FROM (SELECT row_id, k, upper(x[1]) AS letter, {strip_sql('x[3:]')} AS option FROM (SELECT row_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS k FROM (SELECT row_id, string_split({_MARKED}, chr(1))[2:] AS xs FROM sft_rows))) WHERE option <> '' QUALIFY row_number() OVER (PARTITION BY row_id, letter ORDER BY k) = 1")
def mc_options(spark, d):
    found = sft(spark, d).select("row_id", P.options("instruction").alias("m"))
    return found.filter(F.size("m") > 0).select("row_id", F.explode("m").alias("letter", "option"))


def _key_sql(c: str) -> str:
    """``answer_key_plain`` in SQL."""
    plain = _chain(f"translate(coalesce({c},''), chr(65533)||chr(65279)||chr(8203)||chr(8204)||chr(8205)||chr(173)||chr(65534), '')")
    unquoted = f"regexp_replace(regexp_replace(lower({plain}), '^[\"''`]+|[\"''`]+$', '', 'g'), '[.!,;:]+$', '')"
    return f"trim(regexp_replace({unquoted}, '{_S}+', ' ', 'g'))"


def _decoded_sql(rows: str) -> str:
    """(row_id, p, o, letters, letter) of rows with prompt ``p`` and cleaned answer ``o``."""
    marked = "regexp_replace(translate(coalesce(p,''), chr(1)||chr(2), ''), '" + re2(P.LABEL) + "', chr(1)||'\\1\\2'||chr(2), 'g')"
    options = f"SELECT row_id, k, upper(x[1]) AS letter, {strip_sql('x[3:]')} AS option FROM (SELECT row_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS k FROM (SELECT row_id, string_split({marked}, chr(1))[2:] AS xs FROM r))"
    firsts = f"SELECT row_id, letter, {_key_sql('option')} AS v FROM ({options}) WHERE option <> '' QUALIFY row_number() OVER (PARTITION BY row_id, letter ORDER BY k) = 1"
    lettered = f"SELECT r.*, CASE WHEN len(ls) >= 2 THEN ls WHEN regexp_matches(p, '{re2(P.EXPLICIT_CHOICE)}') THEN ['A','B','C','D'] ELSE []::VARCHAR[] END AS letters, CASE WHEN len(ls) >= 2 THEN ls ELSE ['A','B','C','D'] END AS allowed, {_key_sql('o')} AS answer FROM r LEFT JOIN (SELECT row_id, list(letter) AS ls FROM f GROUP BY row_id) USING (row_id)"
    texts = "SELECT l.row_id, min_by(letter, (-length(v), letter)) AS by_text FROM l JOIN f ON f.row_id = l.row_id AND list_contains(l.allowed, f.letter) AND v <> '' AND (answer = v OR starts_with(answer, v || ' ')) GROUP BY l.row_id"

    def allowed(pattern: str) -> str:
        found = f"upper(regexp_extract(o, '{re2(pattern)}', 1))"
        return f"CASE WHEN list_contains(allowed, {found}) THEN {found} END"

    leading = f"CASE WHEN regexp_matches(o, '{re2(P.LEADING_LETTER)}') THEN coalesce({allowed(P.LEADING_LETTER)}, '') ELSE by_text END"
    named = ", ".join(allowed(x) for x in P.NAMED_LETTER)
    letter = f"nullif(CASE WHEN regexp_matches(o, '{re2(P.ONLY_LETTER)}') THEN {allowed(P.ONLY_LETTER)} ELSE coalesce({named}, {leading}) END, '')"
    return f"WITH r AS ({rows}), f AS ({firsts}), l AS ({lettered}), t AS ({texts}) SELECT l.row_id, p, o, letters, {letter} AS letter FROM l LEFT JOIN t USING (row_id)"


@query("mc_answer_decode", "SELECT row_id, letter FROM (" + _decoded_sql(f"SELECT row_id, coalesce(instruction,'') || chr(10) || coalesce(input,'') AS p, {clean_sql('output')} AS o FROM sft_rows") + ") WHERE len(letters) > 0")
def mc_answer_decode(spark, d):
    rows = sft(spark, d).select("row_id", F.concat_ws("\n", T.text_of("instruction"), T.text_of("input")).alias("p"), T.clean_text("output").alias("o"))
    read = rows.withColumn("m", P.options("p")).withColumn("letters", P.valid_letters(F.col("p"), F.col("m"))).filter(F.size("letters") > 0)
    return read.select("row_id", P.decode_answer(F.col("o"), F.col("letters"), F.col("m")).alias("letter"))


# ------------------------------------------------------------ conversations

_TURNS = "SELECT row_id // 500 AS conv_id, row_id * 2 AS turn, 'user' AS role, coalesce(instruction,'') AS text FROM sft_rows UNION ALL SELECT row_id // 500, row_id * 2 + 1, 'assistant', output FROM sft_rows WHERE output IS NOT NULL"


def turns(spark, d) -> DataFrame:
    """The pairs as conversations: those whose ids share their thousand's half."""
    rows = sft(spark, d).select(F.floor(F.col("row_id") / 500).alias("conv_id"), "row_id", "instruction", "output")
    asked = rows.select("conv_id", (F.col("row_id") * 2).alias("turn"), F.lit("user").alias("role"), T.text_of("instruction").alias("text"))
    said = rows.filter("output is not null").select("conv_id", (F.col("row_id") * 2 + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("output").alias("text"))
    return asked.unionByName(said)


@query("chat_pairs", f"SELECT conv_id, turn, md5(prompt) AS prompt_md5, md5(text) AS reply_md5 FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS prompt FROM ({_TURNS}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND r = 'user' AND text <> '(no output)'")
def chat_pairs(spark, d):
    return R.chat_pairs(turns(spark, d)).select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"), F.md5("reply").alias("reply_md5"))


@query("last_turn", f"SELECT conv_id, md5(max_by(text, turn) FILTER (role = 'user')) AS prompt_md5, md5(max_by(text, turn) FILTER (role = 'assistant')) AS reply_md5 FROM ({_TURNS}) GROUP BY conv_id")
def last_turn(spark, d):
    return R.last_turn(turns(spark, d)).select("conv_id", F.md5("prompt").alias("prompt_md5"), F.md5("reply").alias("reply_md5"))


@query("chat_history", f"SELECT conv_id, md5('Previous conversation:' || chr(10)||chr(10) || string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text, chr(10)||chr(10) ORDER BY turn)) AS history_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM ({_TURNS})) WHERE back > 2 GROUP BY conv_id")
def chat_history(spark, d):
    return R.history(turns(spark, d)).select("conv_id", F.md5("history").alias("history_md5"))


@query("role_alternation", f"SELECT conv_id, bool_and(coalesce(role <> r, true)) AS alternates FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM ({_TURNS})) GROUP BY conv_id")
def role_alternation(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns(spark, d).select("conv_id", "role", F.lag("role").over(w).alias("r"))
    return t.groupBy("conv_id").agg(F.bool_and(F.coalesce(F.col("role") != F.col("r"), F.lit(True))).alias("alternates"))


_MESSAGES = "SELECT 'u' || row_id AS message_id, CASE WHEN row_id // 100 = p // 100 THEN 'a' || p END AS parent_id, 'prompter' AS role, row_id, created_date FROM (SELECT *, lag(row_id) OVER (ORDER BY row_id) AS p FROM sft_rows) UNION ALL SELECT 'a' || row_id, 'u' || row_id, 'assistant', row_id, created_date FROM sft_rows"


def messages(spark, d) -> DataFrame:
    """The pairs as a tree: a prompt answers the reply before it in its hundred of ids."""
    w = Window.partitionBy(F.floor(F.col("row_id") / 100)).orderBy("row_id")
    rows = sft(spark, d).select("row_id", "instruction", "output", "created_date", F.lag("row_id").over(w).alias("p"))
    asked = rows.select(F.concat(F.lit("u"), "row_id").alias("message_id"), F.concat(F.lit("a"), "p").alias("parent_id"), F.lit("prompter").alias("role"), T.text_of("instruction").alias("text"), "created_date", "row_id")
    said = rows.select(F.concat(F.lit("a"), "row_id").alias("message_id"), F.concat(F.lit("u"), "row_id").alias("parent_id"), F.lit("assistant").alias("role"), T.text_of("output").alias("text"), "created_date", "row_id")
    return asked.unionByName(said)


@query("ancestor_chain", f"WITH RECURSIVE m AS ({_MESSAGES}), t AS (SELECT message_id, 1 AS depth FROM m WHERE parent_id IS NULL UNION ALL SELECT m.message_id, t.depth + 1 FROM m JOIN t ON m.parent_id = t.message_id) SELECT message_id, depth FROM t WHERE message_id LIKE 'a%'")
def ancestor_chain(spark, d):
    return R.ancestor_paths(messages(spark, d), ids=False)


@query("best_reply", "SELECT parent_id, min_by(message_id, (coalesce(r, 1000000), -coalesce(c, 0), created_date, message_id)) AS message_id FROM (SELECT 'a' || row_id AS message_id, source || '/' || (row_id // 1000) AS parent_id, CASE WHEN length(output) % 4 > 0 THEN length(output) % 4 END AS r, CASE WHEN length(instruction) % 3 > 0 THEN length(instruction) % 3 END AS c, coalesce(created_date, '') AS created_date FROM sft_rows) GROUP BY parent_id")
def best_reply(spark, d):
    """Of the replies of one source in a thousand of ids, the best; lengths stand in for rank and reviews."""
    some = lambda c, k: F.when(F.length(c) % k > 0, F.length(c) % k)
    said = sft(spark, d).select(
        F.concat(F.lit("a"), "row_id").alias("message_id"), F.concat(F.col("source"), F.lit("/"), F.floor(F.col("row_id") / 1000)).alias("parent_id"), F.lit("assistant").alias("role"), some("output", 4).alias("rank"), some("instruction", 3).alias("review_count"), "created_date"
    )
    return R.best_reply(said)


# ---------------------------------------------------------- cleaning, cloze


def cleaned_rows(spark, d) -> DataFrame:
    """Pairs after cleaning; answers of multiple choice become their letter.

    The cleaned fields are written once to the shared folder, or the filters
    after them would pull the chains of patterns into every condition.
    """
    checkpoint_dir(spark)
    rows = spread(sft(spark, d)).select("row_id", "source", *[T.clean_text(c).alias(c) for c in ("instruction", "input", "output")])
    prompt = F.concat_ws("\n", "instruction", "input")
    read = rows.withColumn("_m", P.options(prompt)).withColumn("_l", P.valid_letters(prompt, F.col("_m")))
    decoded = F.when(F.size("_l") > 0, F.coalesce(P.decode_answer(F.col("output"), F.col("_l"), F.col("_m")), F.lit(""))).otherwise(F.col("output"))
    return read.withColumn("output", decoded).drop("_m", "_l").checkpoint()


_CLEAN_ROWS = f"SELECT row_id, source, {clean_sql('instruction')} AS instruction, {clean_sql('input')} AS input, {clean_sql('output')} AS o FROM sft_rows"
_NORM = f"regexp_replace(regexp_replace(regexp_replace(lower(%s), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '{_S}+', ' ', 'g'), '^{_S}+|{_S}+$', '', 'g')"
def _tasked(c: str) -> str:
    return "(" + " OR ".join(f"regexp_matches(coalesce({c},''), '{re2(x)}')" for x in (T.CODE_TOPIC, T.MATH_TOPIC, T.HTML_MARKUP, T.CODE_MARKERS, T.LATEX, T.MATH)) + ")"


_KEPT = (
    f"WITH c AS ({_CLEAN_ROWS}), d AS (" + _decoded_sql("SELECT row_id, instruction || chr(10) || input AS p, o FROM c") + "), "
    f"n AS (SELECT c.row_id, source, instruction, input, CASE WHEN len(letters) > 0 THEN coalesce(letter, '') ELSE c.o END AS output FROM c JOIN d USING (row_id)), "
    f"j AS (SELECT *, row_id AS doc_id, NULL AS lang, concat_ws(chr(10), " + ", ".join(f"CASE WHEN {strip_sql(x)} <> '' THEN {x} END" for x in ("instruction", "input", "output")) + ") AS text FROM n), "
    f"e AS (SELECT doc_id FROM ({_ENGLISH_SQL.replace('FROM documents', 'FROM j')}) WHERE english), "
    f"g AS (SELECT * FROM j WHERE {strip_sql('instruction')} <> '' AND {strip_sql('output')} <> '' AND NOT {_tasked('instruction')} AND NOT {_tasked('input')} AND NOT {_tasked('output')} AND NOT {_tasked('text')} AND row_id IN (SELECT doc_id FROM e)), "
    f"q AS (SELECT row_id, unnest([instruction, CASE WHEN {strip_sql('input')} <> '' THEN instruction || chr(10)||chr(10) || input END, string_split(instruction, chr(10)||chr(10))[1]]) AS f FROM g), "
    f"b AS (SELECT row_id FROM q WHERE f IS NOT NULL AND {_NORM % 'f'} <> '' AND {_NORM % 'f'} IN (SELECT {_NORM % 'text'} FROM eval_items WHERE text IS NOT NULL)) "
    "SELECT row_id, source, length(output) AS n_output FROM g WHERE row_id NOT IN (SELECT row_id FROM b)"
)


@query("sft_clean_filter", _KEPT)
def sft_clean_filter(spark, d):
    good = cleaned_rows(spark, d).filter(T.is_clean_instruction(F.col("instruction"), F.col("input"), F.col("output")))
    bad = decontam.matching_sets(good, decontam.eval_hashes(items(spark, d))).select("row_id").distinct()
    return good.join(bad, "row_id", "left_anti").select("row_id", "source", F.length("output").cast("long").alias("n_output"))


_KEYED = f"regexp_replace(lower({clean_sql('output')}), '^[\"''`]+|[\"''`]+$', '', 'g')"


@query("answer_keys", f"SELECT row_id, {strip_sql('regexp_replace(regexp_replace(a, ' + chr(39) + '[.!,;:]+$' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + _S + '+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS answer FROM (SELECT row_id, {_KEYED} AS a FROM sft_rows)")
def answer_keys(spark, d):
    return spread(sft(spark, d)).select("row_id", T.answer_key("output").alias("answer"))


@query("cloze_examples")
def cloze_examples(spark, d):
    made = table(spark, d, "documents").select("doc_id", P.cloze(F.col("doc_id"), F.col("text")).alias("c"))
    return made.filter("c.output is not null").select("doc_id", "c.input", "c.output")


@query("cloze_drops")
def cloze_drops(spark, d):
    made = table(spark, d, "documents").select(P.cloze(F.col("doc_id"), F.col("text")).alias("c"))
    return made.agg(*[F.sum(f"c.{x}").alias(x) for x in ("too_short", "stopword", "no_content_word")])




def prompts(spark, d) -> DataFrame:
    """The pairs, and the items themselves in capitals and other marks, as
    prompts: (prompt_id, instruction, input)."""
    pairs = sft(spark, d).select(F.concat(F.lit("r"), "row_id").alias("prompt_id"), "instruction", "input")
    own = items(spark, d).select(F.concat(F.lit("i"), "item_id").alias("prompt_id"), F.concat(F.upper(T.text_of("text")), F.lit(" ?!\n\nMore.")).alias("instruction"), F.lit("").alias("input"))
    return pairs.unionByName(own)


_FORMS = f"SELECT prompt_id, unnest([i, CASE WHEN {strip_sql('x')} <> '' THEN i || chr(10)||chr(10) || x END, string_split(i, chr(10)||chr(10))[1]]) AS f FROM (SELECT 'r' || row_id AS prompt_id, coalesce(instruction,'') AS i, coalesce(input,'') AS x FROM sft_rows UNION ALL SELECT 'i' || item_id, upper(coalesce(text,'')) || ' ?!' || chr(10)||chr(10) || 'More.', '' FROM eval_items)"
_MATCHED = f"SELECT DISTINCT prompt_id, eval_set FROM (SELECT prompt_id, {_NORM % 'f'} AS t FROM ({_FORMS}) WHERE f IS NOT NULL) JOIN (SELECT {_NORM % 'text'} AS t, eval_set FROM eval_items WHERE text IS NOT NULL) USING (t) WHERE t <> ''"


@query("prompt_hash_counts", f"SELECT prompt_id, count(DISTINCT nullif({_NORM % 'f'}, ''))::INT AS n FROM ({_FORMS}) GROUP BY prompt_id")
def prompt_hash_counts(spark, d):
    """How many different hashes stand for a prompt."""
    return prompts(spark, d).select("prompt_id", F.size(decontam.prompt_hashes("instruction", "input")).alias("n"))


@query("eval_hash_match", _MATCHED)
def eval_hash_match(spark, d):
    """The sets whose items a prompt equals but for marks and case, as a whole,
    with its input, or by its first paragraph."""
    return decontam.matching_sets(prompts(spark, d), decontam.eval_hashes(items(spark, d)), "prompt_id")


@query("contamination_counters", f"SELECT eval_set, count(DISTINCT prompt_id) AS n FROM ({_MATCHED}) GROUP BY eval_set")
def contamination_counters(spark, d):
    return eval_hash_match(spark, d).groupBy("eval_set").agg(F.countDistinct("prompt_id").alias("n"))


@query("eval_hash_sets", f"SELECT sha256(t) AS h, array_to_string(list_sort(list_distinct(list(eval_set))), ',') AS eval_sets FROM (SELECT {_NORM % 'text'} AS t, eval_set FROM eval_items WHERE text IS NOT NULL) WHERE t <> '' GROUP BY t")
def eval_hash_sets(spark, d):
    return decontam.eval_hashes(items(spark, d)).select("h", F.array_join("eval_sets", ",").alias("eval_sets"))


# --------------------------------------------------------------- tokenising


def tokenised(spark, d, most: int = 64) -> DataFrame:
    rows = sft(spark, d).select("row_id", "source", hashed_ids(F.concat_ws("\n", "instruction", "input")).alias("p"), hashed_ids("output").alias("b"))
    return rows.select("row_id", "source", *[c.alias(k) for k, c in packing.pair_tokens("p", "b", most).items()])


def _w(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{_S}+'), lambda x: x <> ''))"


_TOK = f"SELECT row_id, source, p, b, (b = 0 OR p >= 64) AS dropped, NOT (b = 0 OR p >= 64) AND b + 1 > 64 - p AS truncated FROM (SELECT row_id, source, {_w('concat_ws(chr(10), instruction, input)')} AS p, {_w('coalesce(output, chr(32))')} AS b FROM sft_rows)"


@query("tokenise_pair", f"SELECT row_id, p AS prompt_len, dropped, truncated, CASE WHEN NOT dropped THEN p + least(b, 64 - p - 1) + 1 END AS n FROM ({_TOK})")
def tokenise_pair(spark, d):
    return tokenised(spark, d).select("row_id", F.col("prompt_len").cast("long").alias("prompt_len"), "dropped", "truncated", F.when(F.col("input_ids").isNotNull(), F.size("input_ids")).cast("long").alias("n"))


@query("training_size", f"SELECT floor(count(*) / 16.0 / 4 * 3)::BIGINT AS optimizer_steps, round(avg(len) * 64, 2) AS mean_tokens_per_step, (sum(len) * 3)::BIGINT AS token_passes FROM (SELECT row_number() OVER (PARTITION BY source ORDER BY md5('42|' || row_id), row_id) AS rn, count(*) OVER (PARTITION BY source) AS n, p + b AS len FROM ({_TOK})) WHERE rn > CASE WHEN n > 1 THEN least(greatest(1, floor(n * 0.05)), n - 1) ELSE 1 END")
def training_size(spark, d):
    """Steps, tokens a step and tokens passed of three epochs over the training
    rows, in batches of 16 pairs, four to a step."""
    size = F.size(hashed_ids(F.concat_ws("\n", "instruction", "input"))) + F.size(hashed_ids("output"))
    rows = sampling.split_groups(sft(spark, d).select("row_id", "source", size.cast("long").alias("len"))).filter("split = 'train'")
    return rows.agg(F.floor(F.count(F.lit(1)) / 16 / 4 * 3).alias("optimizer_steps"), F.round(F.avg("len") * 64, 2).alias("mean_tokens_per_step"), (F.sum("len") * 3).cast("long").alias("token_passes"))


@query("source_quality", f"SELECT source, count(*) AS n, avg(dropped::INT) AS dropped_rate, avg(truncated::INT) AS truncated_rate FROM ({_TOK}) GROUP BY source")
def source_quality(spark, d):
    return tokenised(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("dropped").cast("int")).alias("dropped_rate"), F.avg(F.col("truncated").cast("int")).alias("truncated_rate"))


@query("collate_mask", f"SELECT b AS batch_id, row_id, most AS n_x, least(p - 1, n - 1) + (most - (n - 1)) AS n_ignored FROM (SELECT *, max(n - 1) OVER (PARTITION BY b) AS most FROM (SELECT row_id, p, p + least(b, 64 - p - 1) + 1 AS n, (row_number() OVER (ORDER BY md5('42|' || row_id), row_id) - 1) // 16 AS b FROM ({_TOK}) WHERE NOT dropped))")
def collate_mask(spark, d):
    kept = sampling.ranked(tokenised(spark, d).filter("not dropped"), None, "row_id")
    out = packing.collate(kept, 16)
    return out.select("batch_id", "row_id", F.size("x").cast("long").alias("n_x"), F.size(F.filter("y", lambda t: t == packing.IGNORED)).cast("long").alias("n_ignored"))


@query("dpo_collate", f"SELECT row_id, greatest(c, r) AS n, c AS n_chosen, r AS n_rejected FROM (SELECT row_id, p + least(b, 64 - p - 1) + 1 AS c, p + least(b // 2, 64 - p - 1) + 1 AS r FROM ({_TOK}) WHERE NOT dropped AND b // 2 > 0)")
def dpo_collate(spark, d):
    """Chosen: the answer; rejected: its first half. Both padded to one length, masks boolean."""
    rows = sft(spark, d).select("row_id", hashed_ids(F.concat_ws("\n", "instruction", "input")).alias("p"), hashed_ids("output").alias("b"))
    half = rows.withColumn("h", F.slice("b", F.lit(1), F.floor(F.size("b") / 2).cast("int"))).filter(F.size("h") > 0)
    c, r = packing.pair_tokens("p", "b", 64), packing.pair_tokens("p", "h", 64)
    both = half.select("row_id", c["input_ids"].alias("chosen"), r["input_ids"].alias("rejected")).filter("chosen is not null and rejected is not null")
    most = F.greatest(F.size("chosen"), F.size("rejected"))
    padded = both.select("row_id", *[F.concat(x, F.array_repeat(F.lit(packing.EOS), most - F.size(x))).alias(x) for x in ("chosen", "rejected")], *[F.concat(F.array_repeat(F.lit(True), F.size(x)), F.array_repeat(F.lit(False), most - F.size(x))).alias(f"{x}_mask") for x in ("chosen", "rejected")])
    return padded.select("row_id", F.size("chosen").cast("long").alias("n"), *[F.size(F.filter(f"{x}_mask", lambda m: m)).cast("long").alias(f"n_{x}") for x in ("chosen", "rejected")])


# -------------------------------------------------------------------- sizes

_SPLIT = f"SELECT s.*, CASE WHEN rn <= CASE WHEN n > 1 THEN least(greatest(1, floor(n * 0.05)), n - 1) ELSE 1 END THEN 'val' ELSE 'train' END AS part, length(coalesce(instruction,'')) + length(coalesce(input,'')) + length(coalesce(output,'')) AS chars, length(coalesce(output,'')) AS out_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || row_id), row_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM sft_rows) s"


def sized(spark, d) -> DataFrame:
    rows = sft(spark, d).select("row_id", "source", "instruction", "input", "output")
    parts = sampling.split_groups(rows.select("row_id", "source"))
    n = F.length(T.text_of("instruction")) + F.length(T.text_of("input")) + F.length(T.text_of("output"))
    return rows.join(parts.select("row_id", F.col("split").alias("part")), "row_id").select("row_id", "source", "part", n.cast("long").alias("chars"), F.length(T.text_of("output")).cast("long").alias("out_chars"))


@query("size_summary", f"SELECT count(*) AS n, count(*) FILTER (part='val') AS n_val, sum(chars)::BIGINT AS total, avg(chars) AS mean, quantile_cont(chars, 0.5) AS p50, quantile_cont(chars, 0.9) AS p90, quantile_cont(chars, 0.95) AS p95, quantile_cont(chars, 0.99) AS p99, max(chars) AS most, 100.0 * sum(out_chars) / sum(chars) AS response_pct FROM ({_SPLIT})")
def size_summary(spark, d):
    return sized(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("part") == "val").alias("n_val"), F.sum("chars").alias("total"), F.avg("chars").alias("mean"),
        *[F.percentile("chars", F.lit(p / 100)).alias(f"p{p}") for p in (50, 90, 95, 99)], F.max("chars").alias("most"), (F.lit(100.0) * F.sum("out_chars") / F.sum("chars")).alias("response_pct"),
    )


@query("split_stats", f"SELECT source, part, count(*) AS n, sum(chars)::BIGINT AS total, avg(chars) AS mean, quantile_cont(chars, 0.5) AS median, quantile_cont(chars, 0.95) AS p95, 100.0 * sum(chars) / sum(sum(chars)) OVER () AS pct FROM ({_SPLIT}) GROUP BY source, part")
def split_stats(spark, d):
    by = sized(spark, d).groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("total"), F.avg("chars").alias("mean"), F.median("chars").alias("median"), F.percentile("chars", F.lit(0.95)).alias("p95"))
    return by.withColumn("pct", F.lit(100.0) * F.col("total") / F.sum("total").over(Window.partitionBy()))  # one row a group


@query("crosstab_margins", f"SELECT coalesce(source, 'All') AS source, count(*) FILTER (part='train') AS train, count(*) FILTER (part='val') AS val, count(*) AS \"All\" FROM ({_SPLIT}) GROUP BY ROLLUP(source)")
def crosstab_margins(spark, d):
    parts = sampling.split_groups(sft(spark, d).select("row_id", "source"))
    by = parts.cube("source", "split").count()
    wide = by.withColumns({"source": F.coalesce("source", F.lit("All")), "split": F.coalesce("split", F.lit("All"))}).groupBy("source").pivot("split", ["train", "val", "All"]).agg(F.sum("count"))
    return wide.na.fill(0)


@query("describe_lengths", "SELECT source, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS least, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99, max(x) AS most FROM (SELECT source, length(coalesce(output,'')) AS x FROM sft_rows) GROUP BY source")
def describe_lengths(spark, d):
    x = sft(spark, d).select("source", F.length(T.text_of("output")).cast("long").alias("x"))
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("least"), *[F.percentile("x", F.lit(p / 100)).alias(f"p{p}") for p in (50, 75, 90, 95, 99)], F.max("x").alias("most"))


@query("record_normalise", "SELECT row_id, coalesce(nullif(instruction,''), nullif(input,''), '') AS instruction, coalesce(nullif(input,''), '') AS input, coalesce(nullif(output,''), '') AS output FROM sft_rows")
def record_normalise(spark, d):
    from ..sources.files import normalise_records

    raw = sft(spark, d).select("row_id", "instruction", F.col("input").alias("prompt"), F.col("input").alias("context"), F.col("output").alias("response"))
    return normalise_records(raw).select("row_id", "instruction", "input", "output")


# ------------------------------------------------------------- preferences

_HH = "chr(10)||chr(10)||'Human: '||coalesce(instruction,'')||chr(10)||chr(10)||'Assistant: sure.'||chr(10)||chr(10)||'Human: '||coalesce(nullif(input,''),'go on')||chr(10)||chr(10)||'Assistant: '||coalesce(output,'')"
_LAST = f"list_extract(string_split({_HH}, chr(10)||chr(10)||'Human: '), -1)"
_CUT = "string_split(l, chr(10)||chr(10)||'Assistant: ')"


@query("transcript_turn", f"SELECT row_id, {strip_sql(_CUT + '[1]')} AS prompt, {strip_sql('array_to_string(' + _CUT + '[2:], chr(10)||chr(10)||' + chr(39) + 'Assistant: ' + chr(39) + ')')} AS reply FROM (SELECT row_id, {_LAST} AS l FROM sft_rows)")
def transcript_turn(spark, d):
    text = F.concat(F.lit("\n\nHuman: "), T.text_of("instruction"), F.lit("\n\nAssistant: sure.\n\nHuman: "), F.coalesce(F.nullif("input", F.lit("")), F.lit("go on")), F.lit("\n\nAssistant: "), T.text_of("output"))
    return sft(spark, d).select("row_id", text.alias("t")).select("row_id", *[c.alias(k) for k, c in R.transcript_turn("t").items()])


@query("preference_pairs", f"SELECT row_id FROM sft_rows WHERE review_result AND {strip_sql('instruction')} <> '' AND {strip_sql('output')} <> '' AND {strip_sql('left(output, 20)')} <> ''")
def preference_pairs(spark, d):
    rows = sft(spark, d).select("row_id", F.when(F.col("review_result"), "win").otherwise(" TIE ").alias("status"), F.col("instruction").alias("input"), F.col("output").alias("chosen"), F.substring("output", 1, 20).alias("rejected"))
    return R.usable_pairs(rows).select("row_id")


@query("batch_plan", "SELECT row_id, b::BIGINT AS batch_id FROM (SELECT row_id, (row_number() OVER (ORDER BY md5('42|' || row_id), row_id) - 1) // 64 AS b, count(*) OVER () AS n FROM sft_rows) WHERE (b + 1) * 64 <= n")
def batch_plan(spark, d):
    return sampling.batches(sft(spark, d).select("row_id"), 64, "row_id").select("row_id", "batch_id")


@query("simple_sentences", f"SELECT doc_id, len(list_filter(string_split(regexp_replace(coalesce(text,''), '([.!?]){_S}+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {strip_sql('x')} <> ''))::INT AS n FROM documents")
def simple_sentences(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.simple_sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("n"))
