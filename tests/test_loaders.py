import pytest
from pyspark.sql import functions as F

from corpusforge.functions import loaders as L
from corpusforge.operators import sampling
from corpusforge.sources.files import Source

CHOICES = "id long, question string, choices struct<text:array<string>,label:array<string>>, answerKey string, output string"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_arc_and_openbookqa(spark):
    four = ["w", " x ", None, "z"]
    data = [
        (1, " Q? ", (four, ["A", "B", "C", "D"]), "b", "old"),
        (2, "Q", (four, ["1", "2", "3", "4"]), "4", None),
        (3, "Q", (four, ["A", "B", "C", "D"]), "E", None),
        (4, "Q", (["a", "b", "c"], ["A", "B", "C"]), "A", None),
        (5, None, (four, ["A", "B", "C", "D"]), "1", None),
        (6, "Q", None, "A", None),
        (7, "Q", (four, ["A", "B", "C", "D"]), None, None),
    ]
    df = spark.createDataFrame(data, CHOICES)
    got = L.arc(df, ("id",))
    assert rows(got, "id", "output") == [(1, "B"), (2, "D"), (5, "A")]
    first = got.filter("id = 1").first()
    assert first.instruction == "Q?\n\nA) w\nB) x\nC) \nD) z" and first.raw_prompt == "Question: Q?\nA) w\nB) x\nC) \nD) z\nAnswer:"
    assert rows(L.openbookqa(df.withColumnRenamed("question", "question_stem"), ("id",)), "id", "output") == [(1, "B"), (2, "D"), (5, "A")]
    assert L.arc(df.limit(0), ("id",)).count() == 0


def test_sciq_places_the_right_answer(spark):
    data = [(k, f"q{k}", "right", "a", "b", "c") for k in range(200)] + [(900, "q", " ", "a", "b", "c"), (901, "q", "x", None, "b", "c"), (902, "q", "same", "same", "same", "same")]
    got = L.sciq(spark.createDataFrame(data, "id long, question string, correct_answer string, distractor1 string, distractor2 string, distractor3 string"), ("id",)).collect()
    assert len(got) == 201
    assert all(f"{r.output}) right" in r.instruction for r in got if r.id < 900)
    assert min(sum(r.output == x for r in got) for x in "ABCD") > 25


def test_winogrande_and_hellaswag(spark):
    w = spark.createDataFrame([(1, "The _ ran.", "cat", "dog", "2"), (2, "x", "a", "b", "3"), (3, None, None, "b", "1")], "id long, sentence string, option1 string, option2 string, answer string")
    assert rows(L.winogrande(w, ("id",)), "id", "output") == [(1, "B"), (3, "A")]
    ends = ["a", "b", "c", "d"]
    h = spark.createDataFrame([(1, "A man", " sits. ", ends, "3"), (2, "x", None, ["a", "b", "c", ""], "0"), (3, "x", "y", ends, "4"), (4, None, None, ends, "0"), (5, "x", "y", None, "0")], "id long, ctx_a string, ctx_b string, endings array<string>, label string")
    got = L.hellaswag(h, ("id",))
    assert rows(got, "id", "output") == [(1, "D"), (4, "A")] and got.filter("id = 1").first().instruction.startswith("A man sits.\n\nA) a")


def test_dolly_and_alpaca(spark):
    df = spark.createDataFrame([(1, " i ", None, " o "), (2, "", "c", "o"), (3, "i", "c", None), (1, " i ", None, " o ")], "id long, instruction string, context string, response string")
    assert rows(L.dolly(df, ("id",)), "id", "instruction", "input", "output") == [(1, "i", "", "o")] * 2
    a = spark.createDataFrame([(1, None, None, None)], "id long, instruction string, input string, output string")
    assert rows(L.alpaca(a, ("id",)), "instruction", "input", "output") == [("", "", "")]


TREE = "message_id string, parent_id string, role string, text string, lang string, review_result boolean, deleted boolean, synthetic boolean, tree_state string, rank int, review_count int, created_date string"


def test_message_trees(spark):
    def m(i, parent, role, text="t", lang="en", good=True, gone=None, made=False, state="ready_for_export", rank=None):
        return (i, parent, role, text, lang, good, gone, made, state, rank, 1, "d")

    data = [
        m("p", "", "prompter", " ask "), m("a1", "p", "assistant", "second", rank=1), m("a0", "p", "assistant", "first", rank=0), m("a9", "p", "assistant", "gone", rank=0, gone=True),
        m("q", "a0", "prompter", "more"), m("b", "q", "assistant", "answer"), m("x", "q", "assistant", " ", rank=0), m("y", "q", "assistant", "dumm", lang="de", rank=0), m("z", "q", "assistant", "z", good=None, rank=0),
        m("w", "q", "assistant", "w", made=True, rank=0), m("v", "q", "assistant", "v", state="growing", rank=0), m("o", "none", "assistant"), m("s", "a1", "assistant", "side"),
    ]
    df = spark.createDataFrame(data, TREE)
    assert rows(L.usable(df), "message_id") == [(x,) for x in ("a0", "a1", "b", "o", "p", "q", "s")]
    assert rows(L.replies(L.usable(df)), "message_id") == [("a0",), ("a1",), ("b",)]
    got = rows(L.oasst1(df), "message_id", "instruction", "input", "output")
    assert got == [("a0", "ask", "", "first"), ("b", "more", "Previous conversation:\n\nUser:\nask\n\nAssistant:\nfirst", "answer")]
    assert L.oasst1(df.limit(0)).count() == 0


def test_preference_pairs(spark):
    two = "\n\nHuman: a\n\nAssistant: b\n\nHuman: c\n\nAssistant: "
    df = spark.createDataFrame([(1, two + "d", two + "e"), (2, "\n\nHuman: a\n\nAssistant: b", two + "e"), (3, two + "d", two + " "), (4, None, two), (5, two + "d\n\nAssistant: f", two + "g")], "id long, chosen string, rejected string")
    assert rows(L.hh_pairs(df, ("id",)), "id", "prompt", "chosen", "rejected") == [(1, "c", "d", "e"), (5, "c", "d\n\nAssistant: f", "g")]
    o = spark.createDataFrame([("w", "q", "a", "b"), (" Tie", "q", "a", "b"), (None, "q", " ", "b"), (None, "q", "a ", "b")], "status string, input string, chosen string, rejected string")
    assert rows(L.orca_pairs(o), "prompt", "chosen") == [("q", "a"), ("q", "a")]


def test_registry_and_caps(spark):
    df = spark.createDataFrame([(k, "i", "", "o") for k in range(30)], "id long, instruction string, input string, output string")
    assert L.load("alpaca", df, "id", 10, keep=("id",)).count() == 10 and L.load("alpaca", df, "id").count() == 30
    with pytest.raises(ValueError, match="registered: alpaca"):
        L.load("none", df, "id")


def test_chat_prompts(spark):
    df = spark.createDataFrame([(" hi ", [("a", "b"), ("c", None)]), (None, None)], "m string, h array<struct<user:string,assistant:string>>")
    simple = [r[0] for r in df.select(L.chat_prompt("m", "h", "simple")).collect()]
    assert simple == ["User: a\nAssistant: b\nUser: c\nUser: hi\nAssistant:", "User: \nAssistant:"]
    full = [r[0] for r in df.select(L.chat_prompt("m", "h")).collect()]
    assert full[0].endswith("\n\n### Instruction:\na\n\n### Response:\nb\n\n### Instruction:\nc\n\n### Response:\n\n\n### Instruction:\nhi\n\n### Response:\n") and full[1].endswith("\n\n### Instruction:\n\n\n### Response:\n")
    assert [r[0] for r in df.select(L.chat_prompt("m", "h", "raw")).collect()] == ["hi", ""]


def test_ingest_takes_before_it_drops(spark):
    df = spark.createDataFrame([(k, "x" if k % 2 else "", k) for k in range(100)], "doc_id long, body string, source long")
    sources = [Source("s1", "x", text_column="body", ratio=0.5), Source("c4", "y", text_column="body", ratio=0.5)]
    # 10,000 tokens at 4.4 characters each and 2,000 a text: 11 texts of each
    got = L.ingest(sources, lambda s: df, 10_000).groupBy("source").agg(F.count("*").alias("n"), F.min("text").alias("t")).collect()
    first = {r.doc_id for r in sampling.take(df, 11, "doc_id").collect()}
    assert {(r.source, r.n, r.t) for r in got} == {(n, sum(k % 2 for k in first), "x") for n in ("s1", "c4")}
    with pytest.raises(ValueError):
        L.ingest([], lambda s: df, 1)


@pytest.mark.parametrize(("n", "val"), [(0, 0), (1, 1), (2, 1), (100, 5)])
def test_pooled_split(spark, n, val):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    assert sampling.split_pooled(df).filter("split = 'val'").count() == val
