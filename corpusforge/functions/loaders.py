"""Public datasets as instruction rows, and raw corpora as one.

Each loader takes the rows of a dataset as delivered and gives (*keep,
instruction, input, output), those of multiple choice also ``raw_prompt``;
rows that make no pair are left out. Null fields are empty ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import sampling
from ..sources.files import Registry, Source
from .prompts import ancestor_chains, best_reply, choice_instruction, choice_letter, choice_prompt, transcript_turn, usable_pairs
from .text import strip, text_of

LOADERS = Registry()
#: Fixed value: how many rows of this dataset are read unless more are asked for.
CAPS = {"hellaswag": 6000}


def _triple(df: DataFrame, keep: Sequence[str], instruction: Column, given: Column, output: Column, **more: Column) -> DataFrame:
    return df.select(*keep, instruction.alias("instruction"), given.alias("input"), output.alias("output"), *[c.alias(k) for k, c in more.items()])


def _choices(df: DataFrame, keep: Sequence[str], question: Column, options: Column, letter: Column, prefix: str, line: str = "") -> DataFrame:
    rows = df.select(*keep, text_of(question).alias("_q"), options.alias("_o"), letter.alias("_a")).filter("_a is not null")
    return _triple(rows, keep, choice_instruction("_q", "_o"), F.lit(""), F.col("_a"), raw_prompt=choice_prompt("_q", "_o", prefix, line))


def _stripped(options: Column | str) -> Column:
    return F.transform(F.col(options) if isinstance(options, str) else options, lambda x: strip(F.coalesce(x, F.lit(""))))


@LOADERS.register("alpaca")
def alpaca(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return _triple(df, keep, text_of("instruction"), text_of("input"), text_of("output"))


@LOADERS.register("dolly")
def dolly(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(instruction, context, response), without blank questions and answers."""
    rows = _triple(df, keep, strip(text_of("instruction")), strip(text_of("context")), strip(text_of("response")))
    return rows.filter("instruction <> '' and output <> ''")


@LOADERS.register("arc")
def arc(df: DataFrame, keep: Sequence[str] = (), question: str = "question") -> DataFrame:
    """(question, choices struct<text, label>, answerKey): of four choices, with an answer among them.
    Easy and challenge rows are one frame."""
    texts = _stripped("choices.text")
    four = df.filter(F.size(texts) == 4)
    return _choices(four, keep, F.col(question), texts, choice_letter("answerKey", "choices.label"), "Question:")


@LOADERS.register("openbookqa")
def openbookqa(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """As ``arc``, of ``question_stem``; the fact behind the answer is not shown."""
    return arc(df, keep, "question_stem")


@LOADERS.register("sciq")
def sciq(df: DataFrame, keep: Sequence[str] = (), id_col: str = "id", seed: int = 42) -> DataFrame:
    """(question, correct_answer, distractor1..3): four options in an order
    seeded by row and question; none may be blank."""
    parts = F.array(*[strip(text_of(c)) for c in ("correct_answer", "distractor1", "distractor2", "distractor3")])
    rows = df.withColumn("_p", parts).filter(~F.array_contains("_p", ""))
    key = lambda x, i: F.struct(F.md5(F.concat(F.lit(f"{seed}|sciq|"), F.col(id_col).cast("string"), F.lit("|"), text_of("question"), F.lit("|"), i.cast("string"))).alias("k"), i.alias("i"), x.alias("x"))
    order = rows.withColumn("_s", F.array_sort(F.transform("_p", key)))
    place = F.array_position(F.transform("_s", lambda x: x["i"]), 0)
    letter = F.substring(F.lit("ABCD"), place, F.lit(1))
    return _choices(order, keep, F.col("question"), F.transform("_s", lambda x: x["x"]), letter, "Question:")


@LOADERS.register("winogrande")
def winogrande(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(sentence, option1, option2, answer '1' or '2')."""
    a = strip(text_of("answer"))
    letter = F.when(a == "1", "A").when(a == "2", "B")
    return _choices(df, keep, F.col("sentence"), F.array(text_of("option1"), text_of("option2")), letter, "Context:", 'Respond with only "A" or "B".')


@LOADERS.register("hellaswag")
def hellaswag(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(ctx_a, ctx_b, endings, label '0' to '3'): four endings, none blank."""
    ends = _stripped("endings")
    rows = df.filter((F.size(ends) == 4) & ~F.array_contains(ends, ""))
    context = F.array_join(F.filter(F.array(strip(text_of("ctx_a")), strip(text_of("ctx_b"))), lambda x: x != ""), " ")
    label = strip(text_of("label"))
    letter = F.when(label.rlike("^[0-3]$"), F.substring(F.lit("ABCD"), label.try_cast("int") + 1, F.lit(1)))
    return _choices(rows, keep, context, ends, letter, "Context:")


def usable(messages: DataFrame, lang: str = "en") -> DataFrame:
    """Messages of a conversation tree that may be used: with a text, of one
    language, by a prompter or assistant, reviewed well, neither deleted nor
    made up, of a finished tree. Texts are stripped, null parents empty."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    good = (strip(text_of("text")) != "") & (F.col("lang") == lang) & F.col("role").isin("prompter", "assistant") & F.coalesce(F.col("review_result"), F.lit(False))
    rows = messages.filter(good & no("deleted") & no("synthetic") & (F.col("tree_state") == "ready_for_export"))
    return rows.withColumns({"text": strip("text"), "parent_id": F.nullif("parent_id", F.lit(""))})


def replies(messages: DataFrame) -> DataFrame:
    """The assistant messages whose parent is there and is a prompter's."""
    asked = messages.filter("role = 'prompter'").select(F.col("message_id").alias("_parent")).distinct()
    return messages.filter("role = 'assistant' and parent_id is not null").join(asked, F.col("parent_id") == F.col("_parent"), "left_semi")


@LOADERS.register("oasst1")
def oasst1(messages: DataFrame, keep: Sequence[str] = ("message_id",)) -> DataFrame:
    """The best reply to each prompt with the prompt before it; the turns before
    them are the input, as blocks under a heading."""
    rows = usable(messages)
    best = best_reply(replies(rows)).select("message_id")
    chains = ancestor_chains(rows, best).filter("depth >= 2")
    early = F.slice("chain", F.lit(1), F.col("depth") - 2)
    block = lambda x: F.concat(F.when(x["role"] == "prompter", "User").otherwise("Assistant"), F.lit(":\n"), x["text"])
    history = F.when(F.size(early) > 0, F.array_join(F.concat(F.array(F.lit("Previous conversation:")), F.transform(early, block)), "\n\n")).otherwise("")
    return _triple(chains, keep, F.element_at("chain", -2)["text"], history, F.element_at("chain", -1)["text"])


def orca_pairs(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(prompt, chosen, rejected) of preference rows that are no tie and have nothing blank."""
    return usable_pairs(df).select(*keep, strip("input").alias("prompt"), strip("chosen").alias("chosen"), strip("rejected").alias("rejected"))


def hh_pairs(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(prompt, chosen, rejected): the last turn of the chosen transcript and the
    last reply of the rejected one, with nothing blank. A transcript that has but
    its first turn is left out, as its stripped text has no further one."""
    turn = "\n\nHuman: "
    both = df.select(*keep, strip(text_of("chosen")).alias("_c"), strip(text_of("rejected")).alias("_r")).filter(F.contains("_c", F.lit(turn)) & F.contains("_r", F.lit(turn)))
    a, b = transcript_turn("_c"), transcript_turn("_r")
    rows = both.select(*keep, a["prompt"].alias("prompt"), a["reply"].alias("chosen"), b["reply"].alias("rejected"))
    return rows.filter("prompt <> '' and chosen <> '' and rejected <> ''")


def load(name: str, df: DataFrame, id_col: str, most: int | None = None, seed: int = 42, **options) -> DataFrame:
    """Rows of a registered loader, after a seeded cap on the rows it reads."""
    limits = [x for x in (most, CAPS.get(name)) if x]
    rows = sampling.take(df, min(limits), id_col, seed) if limits else df
    return LOADERS.load(name, rows, **options)


# ------------------------------------------------------------------ corpora


def ingest(sources: Sequence[Source], read: Callable[[Source], DataFrame], total_tokens: int, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """(id, source, text) of several corpora in one plan: of each the text
    column under one name, as many rows in the seeded order as its share of
    ``total_tokens`` needs, and then without empty texts, in that order."""
    spark = None
    rows = None
    for s in sources:
        df = read(s)
        spark = spark or df.sparkSession
        one = df.select(F.col(id_col), F.lit(s.name).alias("source"), F.col(s.text_column).cast("string").alias("text"))
        rows = one if rows is None else rows.unionAll(one)
    if rows is None:
        raise ValueError("no sources")
    shares = spark.createDataFrame([(s.name, float(s.ratio)) for s in sources], "source string, ratio double")
    budgets = sampling.document_estimate(sampling.allocate(shares, total_tokens), "source")
    return sampling.take_each(rows, budgets, "source", id_col, seed).filter("text is not null and text <> ''")


# --------------------------------------------------------------------- chat


def chat_prompt(message: Column | str, history: Column | str, template: str = "alpaca") -> Column:
    """The prompt of a chat: ``history`` is a list of structs of user and
    assistant. ``raw`` is the message alone; ``alpaca`` repeats the template's
    blocks; any other names the speakers."""
    from .prompts import OPENING

    m = strip(text_of(message))
    turns = F.col(history) if isinstance(history, str) else history
    if template == "raw":
        return m
    if template == "alpaca":
        block = lambda t: F.concat(F.lit("### Instruction:\n"), text_of(t["user"]), F.lit("\n\n### Response:\n"), text_of(t["assistant"]), F.lit("\n\n"))
        return F.concat(F.lit(OPENING + "\n\n"), F.array_join(F.transform(F.coalesce(turns, F.array()), block), ""), F.lit("### Instruction:\n"), m, F.lit("\n\n### Response:\n"))
    said = lambda t: F.concat(F.lit("User: "), text_of(t["user"]), F.when(text_of(t["assistant"]) != "", F.concat(F.lit("\nAssistant: "), t["assistant"])).otherwise(""), F.lit("\n"))
    return F.concat(F.array_join(F.transform(F.coalesce(turns, F.array()), said), ""), F.lit("User: "), m, F.lit("\nAssistant:"))
