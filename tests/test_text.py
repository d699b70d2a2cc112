import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import parsing as P
from corpusforge.functions import text as T

ROWS = [
    None, "", "   ", "decomposed é and zero​width soft­hyphen", "see https://a.b c and www.x.y", "<b>bold</b> text", "a ```code``` b",
    "x\n    one\n    two\n    three\nend", "x\n    one\n    two\nend", "a = 1 here", "costs $x$ now", "Image caption A cat", "no Image caption here", "a\n\n\n\nb", "tab\t\tb  c",
    "def f(x):\nbody", "The same line　here", "\U0001f600 face", "== Head ==\ntext[1] {{box}} [[Category:X]] [[File:a.png]]",
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


def got(spark, column, rows=ROWS):
    return [r[0] for r in frame(spark, rows).orderBy("id").select(column).collect()]


def plain_clean(text):
    """The cleaning without code and mathematics, as a few lines of Python."""
    text = unicodedata.normalize("NFC", text or "")
    text = "".join(c for c in text if c not in T.JUNK_CHARS)
    text = re.sub(r"https?://\S+|www\.\S+", "", text)
    for p in T.BOILERPLATE_PREFIXES:
        if text.startswith(p):
            text = text[len(p) :].lstrip()
            break
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def test_clean_prose(spark):
    assert got(spark, T.clean_text("text", strip_code_and_math=False)) == [plain_clean(t) for t in ROWS]


def test_clean_code_and_math(spark):
    out = dict(zip(ROWS, got(spark, T.clean_text("text"))))
    assert out["<b>bold</b> text"] == "bold text"
    assert out["a ```code``` b"] == "a b"
    assert out["x\n    one\n    two\n    three\nend"] == "x\nend"
    assert "one" in out["x\n    one\n    two\nend"]
    assert out["costs $x$ now"] == "costs now"
    assert out["def f(x):\nbody"] == "body"
    assert out[None] == "" == out["   "]


def test_words_split_at_unicode_space(spark):
    assert got(spark, T.split_words("text"), ["A b　C d", None, ""]) == [["a", "b", "c", "d"], [], []]


def test_wikipedia(spark):
    assert got(spark, T.strip(T.clean_wikipedia("text")), [ROWS[-1], None]) == ["text", ""]


@pytest.mark.parametrize(("n", "english"), [(4, False), (5, True)])
def test_english_needs_five_words(spark, n, english):
    assert got(spark, T.is_english("text"), [" ".join(["the"] * n)]) == [english]


def test_english_ratios(spark):
    nine = "the " + "zebra " * 8
    rows = [nine, "the " + "zebra " * 7, "the of and to in ü" + "ü" * 20]
    assert got(spark, T.is_english("text"), rows) == [False, True, False]


def test_decontam_normalise(spark):
    assert got(spark, T.decontam_normalise("text"), ["Hello,  World! ﬁne", None]) == ["hello world fine", ""]


def test_small_scalars(spark):
    assert got(spark, T.slug("text"), ["Run A/B-3 ", None]) == ["run_a_b_3", ""]
    assert got(spark, T.strip_seed("text"), ["abl_x_s12", "abl_s1x"]) == ["abl_x", "abl_s1x"]
    assert got(spark, T.preview("text", 10), ["a  b", "x" * 30]) == ["a b", "x" * 9 + "..."]
    assert got(spark, T.strip_footer("text"), ["answer\n\ntokens/s: 12\n", "tokens/s: is a word here"]) == ["answer", ""]


def test_sentences(spark):
    rows = ["Mr. Smith left. He ran.", "v 3. Next one. Two  \n Three.", "no end", "", None, "A. B. C", "Hm!! Yes etc. And vs. Then... So", "Room No. Five, Mt.. Six"]
    assert got(spark, P.sentences("text"), rows) == [
        ["Mr. Smith left.", "He ran."], ["v 3. Next one.", "Two  \n Three."], ["no end"], [], [], ["A.", "B.", "C"], ["Hm!!", "Yes etc. And vs. Then...", "So"], ["Room No. Five, Mt.. Six"],
    ]


def test_options(spark):
    rows = ["Q\nA) one\nB) two\nA) again\nC)\nD. four", None, "no labels", "(a) x [B] y C - z"]
    assert got(spark, P.options("text"), rows) == [{"A": "one", "B": "two", "D": "four"}, {}, {}, {"A": "x", "B": "y", "C": "z"}]


@pytest.mark.parametrize(
    ("output", "letter"),
    [("B", "B"), ("(c)", "C"), ("Answer: D", "D"), ("The correct answer is B", "B"), ("B) Smith", "B"), ("red apple", "A"), ("E", None), ("A good thing", None), ("nothing", None)],
)
def test_decode(spark, output, letter):
    df = spark.createDataFrame([(output,)], "o string").withColumn("m", F.create_map(*[F.lit(x) for x in ("A", "Red apple", "B", "blue", "C", "green", "D", "sky")]))
    assert df.select(P.decode_answer(F.col("o"), F.map_keys("m"), F.col("m"))).first()[0] == letter


def test_cloze():
    long = " ".join(["Many people walked along the winding river toward the old station."] * 6)
    context, word, _ = P.cloze_of("1", long)
    assert word == "station" and context.endswith("the old")
    assert P.cloze_of("1", None)[:2] == (None, None)
    assert P.cloze_of("1", "= Header =")[:2] == (None, None)


def test_passages_against_the_plain_walk():
    import random

    rng = random.Random(2)
    for _ in range(200):
        parts = [" ".join(["w"] * rng.choice((0, 1, 3, 8, 30)) or ["12"]) for _ in range(rng.randint(1, 12))]
        first, least, most = rng.randrange(len(parts)), 5, 20
        slow = []
        for turn in range(len(parts)):
            at, total, taken = (first + turn) % len(parts), 0, []
            while at < len(parts) and total < least:
                n = parts[at].count("w")
                total, taken, at = total + n, taken + ([parts[at]] if n else []), at + 1
            if least <= total <= most:
                slow.append(" ".join(taken))
        assert P.passages(parts, first, least, most) == slow


def test_model_names(spark):
    rows = ["a/checkpoints/run 1/best.pt", "checkpoints/x.v2.pt", "/else/where/model.bin", "plain", None]
    assert got(spark, T.model_name("text"), rows) == ["run 1_best", "x.v2", "model", "plain", ""]
    assert got(spark, T.simple_sentences("text"), ["One two. Three! four. Five", None, " "]) == [["One two.", "Three! four.", "Five"], [], []]
