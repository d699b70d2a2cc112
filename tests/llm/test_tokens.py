import random

import pytest
from pyspark.sql import functions as F

from corpusforge.llm import mixing, tokens

TEXTS = [None, "", " ", "Hello world", "don't stop", "a" * 5000, " " * 3000 + "x", "<|endoftext|> is text", "naïve café – 漢字 😀", "one two\n\n  three\t4567", "Hello world", "ab́c ​ x"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, i, "k") for i, t in enumerate(texts)], "doc_id long, text string, id long, piece string")


def test_counts_are_those_of_the_tokenizer(spark):
    coder = tokens.encoding()
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(frame(spark)).collect()}
    assert got == {i: len(coder.encode_ordinary(t)) if t else 0 for i, t in enumerate(TEXTS)}


def test_counts_keep_repeated_rows_and_leave_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "x"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, tokens.token_counts(df).collect())) == [(1, 2), (1, 2), (2, 0)]
    assert tokens.token_counts(df.limit(0)).count() == 0


def test_trie_states_on_random_bytes():
    coder, rng = tokens.encoding(), random.Random(3)
    pieces = sorted({bytes(rng.choice(b"aeiou thn\xc3\xa9\xd0\xb0!#\xff") for _ in range(rng.randint(1, 40))) for _ in range(3000)})
    for order in (pieces, rng.sample(pieces, len(pieces)), [p for p in pieces for _ in range(2)]):
        trie = tokens.PieceTrie(coder)
        assert [trie.count(p) for p in order] == [len(coder._encode_single_piece(p)) for p in order]


def test_kept_columns_travel_with_the_ids(spark):
    df = spark.createDataFrame([(1, "a b", "x", None), (1, "a b c", "y", 5), (2, None, None, 7), (3, "", "z", 7)], "doc_id long, text string, piece string, chunk long")
    got = sorted(map(tuple, tokens.token_counts(df, keep=("piece", "chunk")).collect()), key=str)
    assert got == [(1, "x", None, 2), (1, "y", "5", 3), (2, None, "7", 0), (3, "z", "7", 0)]


def test_repeated_ids_count_once_a_row(spark):
    df = spark.createDataFrame([(1, "a b", "s")] * 3, "doc_id long, text string, key string")
    names = spark.createDataFrame([("S",)], "name string")
    assert [tuple(r) for r in tokens.source_totals(tokens.token_counts(df, keep=("key",)), names).collect()] == [("S", 3, 6)]


def test_encode_and_decode(spark):
    coder = tokens.encoding()
    ids = tokens.encode(frame(spark))
    got = {r.doc_id: list(r.ids) for r in ids.collect()}
    assert got == {i: coder.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in tokens.decode(ids).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encode(frame(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["word " * 9000, "x" * 9000 + " " + "y  z " * 9000, "a\n b  c's 'll " * 4000, " " * 9000, "no-space" * 9000, "漢字かな、カナ。" * 3000, "one\ntwo\n" * 4000, "a1b22's't'x!'s\u0301" * 2000, "('ll)'9''re" * 3000])
def test_blocks_encode_alone(text):
    coder = tokens.encoding()
    parts = tokens.blocks(text, 1000)
    assert "".join(parts) == text and (text.isspace() or max(map(len, parts)) < 9100)
    assert [i for p in parts for i in coder.encode_ordinary(p)] == coder.encode_ordinary(text)


def test_keys(spark):
    df = spark.createDataFrame([("en-GB", "WWW.Site.example."), ("English", "https://site.example/"), ("xx", None), (None, " site.example"), ("", "a"), ("deu", "b")], "l string, d string")
    got = [tuple(r) for r in df.select(tokens.lang_key("l"), tokens.domain_key("d")).collect()]
    assert got == [("en", "site.example"), ("en", "site.example"), (None, None), (None, "site.example"), (None, "a"), ("de", "b")]


def corpus(spark):
    docs = spark.createDataFrame([(k, "w " * 10, s) for k, s in enumerate(["a"] * 8 + [" A"] * 2 + ["b-b", None, "c"])], "doc_id long, text string, source string")
    counts = docs.select("doc_id", tokens.source_key("source").alias("key"), F.lit(10).cast("long").alias("n_tokens"))
    configs = spark.createDataFrame([("a", 0.5, 1), ("b_b", 0.3, 4), ("gone", 0.2, None)], "name string, ratio double, max_repeats int")
    plans = spark.createDataFrame([("a", 50), ("b_b", 30), ("gone", 20)], "name string, target_tokens long")
    return counts, configs, plans


def test_mix(spark):
    counts, configs, plans = corpus(spark)
    rated = mixing.rates(counts, configs, plans).cache()
    got = {r.source: (r.n_documents, r.tokens, r.rate, r.reachable) for r in rated.collect()}
    assert got == {"a": (10, 100, 0.5, True), "b_b": (1, 10, 3.0, True), "gone": (0, 0, 0.0, False)}
    used = mixing.copies(counts, rated)
    n = {(r.source, r.doc_id): r.n_copies for r in used.collect()}
    assert n["b_b", 10] == 3 and all(v in (0, 1) for k, v in n.items() if k[0] == "a") and len(n) == 11
    assert n == {(r.source, r.doc_id): r.n_copies for r in mixing.copies(counts.repartition(5), rated).collect()}
    assert mixing.mix(used).count() == sum(n.values())
    shares = {r.source: r for r in mixing.shares(used, rated, configs).collect()}
    assert sum(r.share for r in shares.values()) == pytest.approx(1) and shares["gone"].mixed_tokens == 0
