"""Prompts, options and conversations as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .text import col, strip, text_of

# The two openings of the instruction template.
OPENING = "Below is an instruction that describes a task. Write a response that appropriately completes the request."
OPENING_WITH_INPUT = "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request."
LETTERS = "ABCDEFGHIJ"


def alpaca(instruction: Column | str, given: Column | str) -> Column:
    """The prompt up to where the response begins; null counts as empty."""
    i, x = strip(text_of(instruction)), strip(text_of(given))
    head = F.concat(F.lit("\n\n### Instruction:\n"), i)
    end = F.lit("\n\n### Response:\n")
    return F.when(x != "", F.concat(F.lit(OPENING_WITH_INPUT), head, F.lit("\n\n### Input:\n"), x, end)).otherwise(F.concat(F.lit(OPENING), head, end))


def alpaca_parts(prompt: Column | str) -> dict[str, Column]:
    """instruction and input of a prompt of the template; empty where it is none."""
    pattern = r"(?s)### Instruction:\n(.*?)\n\n(?:### Input:\n(.*?)\n\n)?### Response:\n"
    return {"instruction": F.regexp_extract(col(prompt), pattern, 1), "input": F.regexp_extract(col(prompt), pattern, 2)}


def labelled(options: Column | str) -> Column:
    """One line an option: its letter, a bracket, its text."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return F.array_join(F.transform(col(options), lambda x, i: F.concat(letters[i], F.lit(") "), strip(F.coalesce(x, F.lit(""))))), "\n")


def choice_instruction(question: Column | str, options: Column | str) -> Column:
    return F.concat(strip(text_of(question)), F.lit("\n\n"), labelled(options))


def choice_prompt(context: Column | str, options: Column | str, prefix: str = "Context:", line: str = "") -> Column:
    middle = F.lit(f"\n{line}\nAnswer:" if line else "\nAnswer:")
    return F.concat(F.lit(prefix + " "), strip(text_of(context)), F.lit("\n"), labelled(options), middle)


def choice_letter(key: Column | str, labels: Column | str, count: int = 4) -> Column:
    """The letter of an answer key: a label as it is, in another case, its
    number from 1, or a letter itself; null unless there are ``count`` labels."""
    k, ls = strip(text_of(key)), F.transform(col(labels), lambda x: strip(F.coalesce(x, F.lit(""))))
    letters = F.array(*[F.lit(x) for x in LETTERS[:count]])
    same, loose = F.array_position(ls, k), F.array_position(F.transform(ls, F.upper), F.upper(k))
    number = F.when(k.rlike(r"^\d{1,3}$"), k.try_cast("int"))
    place = F.when(same > 0, same).when(loose > 0, loose).when(number.between(1, count), number).when(F.array_contains(letters, F.upper(k)), F.array_position(letters, F.upper(k)))
    return F.when(F.size(ls) == count, F.try_element_at(letters, place.cast("int")))


# ----------------------------------------------------------- conversations


def chat_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, prompt, reply): each assistant turn with the user turn just
    before it; of user turns in a row the last counts. A reply that says there
    is no output closes its prompt without a pair."""
    w = Window.partitionBy(conv).orderBy(turn)
    before = turns.withColumns({"_role": F.lag("role").over(w), "prompt": F.lag("text").over(w)})
    return before.filter((F.col("role") == "assistant") & (F.col("_role") == "user") & (F.col("text") != "(no output)")).select(conv, turn, "prompt", F.col("text").alias("reply"))


def last_turn(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, prompt, reply): the last user and the last assistant turn, by
    partial aggregation; null where there is none."""
    at = F.struct(turn, "text")
    return turns.groupBy(conv).agg(
        F.max(F.when(F.col("role") == "user", at))["text"].alias("prompt"), F.max(F.when(F.col("role") == "assistant", at))["text"].alias("reply")
    )


def history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, history): the turns before the last two as blocks under a heading."""
    w = Window.partitionBy(conv).orderBy(F.desc(turn))
    early = turns.withColumn("_back", F.row_number().over(w)).filter("_back > 2")
    who = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    block = F.struct(F.col(turn), F.concat(who, F.lit(": "), text_of("text")).alias("b"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n\n")
    return early.groupBy(conv).agg(F.concat(F.lit("Previous conversation:\n\n"), body).alias("history"))


def ancestor_paths(messages: DataFrame, ids: bool = True) -> DataFrame:
    """(message_id, depth, ids) of the assistant messages whose ancestors lead to
    a root, prompter and assistant in turn; ``ids`` from the root on, if asked for.

    ``messages`` has message_id, parent_id, role. Paths are doubled: each
    message reaches up to some ancestor, and takes on that ancestor's own
    path in each round, so a chain of any depth takes as many rounds as its
    depth has binary digits. A path that meets itself, a missing parent, or one that
    breaks the turns, is dropped, and with it whatever hangs on it.
    """
    # of repeated ids one row counts
    rows = messages.filter("message_id is not null").groupBy("message_id").agg(F.min(F.struct("parent_id", "role")).alias("m"))
    start = rows.select("message_id", F.col("m.parent_id").alias("next"), "m.role", F.col("m.role").alias("top_role"), F.lit(1).cast("long").alias("depth"))
    open_ = stored(start.withColumn("ids", F.array("message_id")) if ids else start)
    total = open_.count()
    rooted = "next is null and top_role = 'prompter'"
    done, open_ = open_.filter(rooted), open_.filter("next is not null")
    # a path longer than there are messages is a circle
    while (least := open_.agg(F.min("depth")).first()[0]) is not None and least <= total:
        every = done.unionByName(open_)
        upper = every.select(*[F.col(c).alias(f"u_{c}") for c in every.columns])
        grown = open_.join(upper, F.col("next") == F.col("u_message_id")).filter(F.col("u_role") != F.col("top_role"))
        if ids:
            grown = grown.filter(~F.arrays_overlap("ids", "u_ids"))
        joined = {"ids": F.concat("u_ids", "ids")} if ids else {}
        new = {"next": F.col("u_next"), "top_role": F.col("u_top_role"), "depth": F.col("depth") + F.col("u_depth"), **joined}
        grown = stored(grown.select("message_id", "role", *[c.alias(k) for k, c in new.items()]))
        done, open_ = done.unionByName(grown.filter(rooted)), grown.filter("next is not null")
    return done.filter("role = 'assistant'").select("message_id", F.col("depth").cast("int").alias("depth"), *["ids"] * ids)


def ancestor_chains(messages: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(message_id, chain, depth) as ``ancestor_paths`` has them, or of those of
    ``wanted`` (message_id) alone; ``chain`` holds structs of role and text from
    the root on. Texts are joined once, to the paths that are asked for."""
    paths = ancestor_paths(messages)
    if wanted is not None:
        paths = paths.join(wanted, "message_id", "left_semi")
    steps = paths.select("message_id", "depth", F.posexplode("ids").alias("pos", "_id"))
    said = messages.groupBy(F.col("message_id").alias("_id")).agg(F.min(F.struct("role", "text")).alias("m")).select("_id", "m.role", "m.text")
    turn = F.struct("pos", F.struct("role", "text").alias("turn"))
    chain = F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["turn"])
    return steps.join(said, "_id").groupBy("message_id", "depth").agg(chain.alias("chain")).select("message_id", "chain", "depth")


def best_reply(messages: DataFrame) -> DataFrame:
    """(parent_id, message_id): of the replies to a message the one of least
    rank (null last), most reviews, earliest date, least id."""
    order = F.struct(F.coalesce("rank", F.lit(1_000_000)), -F.coalesce("review_count", F.lit(0)), F.coalesce("created_date", F.lit("")), "message_id")
    return messages.filter("role = 'assistant' and parent_id is not null").groupBy("parent_id").agg(F.min(order)["message_id"].alias("message_id"))


# ------------------------------------------------------------- preferences


def transcript_turn(transcript: Column | str) -> dict[str, Column]:
    """prompt and reply of a transcript's last turn; null where it has none."""
    last = F.element_at(F.split(text_of(transcript), "\n\nHuman: "), -1)
    parts = F.split(last, "\n\nAssistant: ", 2)
    return {"prompt": strip(parts[0]), "reply": F.when(F.size(parts) > 1, strip(F.try_element_at(parts, F.lit(2))))}


def usable_pairs(df: DataFrame, status: str = "status", prompt: str = "input", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Preference rows that are no tie and have nothing blank."""
    tie = F.lower(strip(text_of(status))) == "tie"
    return df.filter(~tie & (strip(text_of(prompt)) != "") & (strip(text_of(chosen)) != "") & (strip(text_of(rejected)) != ""))


def unique_labels(df: DataFrame, label: str, order: str) -> DataFrame:
    """``df`` with ``unique_label``: a label that comes again has its number in brackets."""
    k = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return df.withColumn("unique_label", F.when(k > 1, F.concat(F.col(label), F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(F.col(label)))
