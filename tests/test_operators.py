import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusforge.functions import prompts as R
from corpusforge.operators import decontam, dedup, packing, runs, sampling, scoring
from corpusforge.plans import catalog, mixture

DOCS = "doc_id long, text string, source string, id long, text_md5 string"


def docs(spark, rows):
    """Documents with two further columns whose names the operators use too."""
    return spark.createDataFrame([(*r, 7, "x") for r in rows], DOCS)


def test_exact(spark):
    df = docs(spark, [(3, "a", "s"), (1, "a", "t"), (2, "b", "s"), (5, None, "s"), (4, None, None)])
    assert sorted(r.doc_id for r in dedup.exact(df).collect()) == [1, 2, 4]
    assert dedup.exact(df.limit(0)).count() == 0
    assert set(dedup.exact(df).columns) == set(df.columns)


def test_cross_source(spark):
    df = docs(spark, [(1, "a", "c4"), (2, "a", "wikipedia"), (3, "a", "wikipedia"), (4, "b", "c4"), (5, "b", "c4"), (6, "z", None), (7, "z", "other")])
    assert sorted(r.doc_id for r in dedup.cross_source(df, ("wikipedia", "c4")).collect()) == [2, 3, 4, 5, 7]


def test_minhash_greedy(spark):
    base = " ".join(f"w{i}" for i in range(60))
    df = docs(spark, [(1, base, "s"), (2, base, "s"), (3, "one two", "s"), (4, "one two", "s"), (5, None, "s"), (6, " ".join(f"v{i}" for i in range(60)), "s")])
    kept = {r.doc_id: r.kept for r in dedup.minhash_keep(df).collect()}
    assert kept == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_minhash_against_sequential_removal(spark, seed):
    """Windows over one stream of words share bands in chains; the loop has the operator's own hash values."""
    rng = random.Random(seed)
    stream = [f"w{k}" for k in range(400)]
    texts = [" ".join(stream[a : a + rng.randint(8, 30)]) for a in (rng.randint(0, 380) for _ in range(120))]
    rows, bands = 2, 3
    draw = np.random.default_rng(13)
    factors, terms = draw.integers(1, 1 << 62, rows * bands, dtype=np.uint64) | np.uint64(1), draw.integers(1, 1 << 62, rows * bands, dtype=np.uint64)
    stayed, expected = set(), {}
    for i, text in enumerate(texts):
        w = text.split()
        x = np.array([xxhash.xxh64_intdigest(" ".join(w[k : k + 5]), seed=42) for k in range(len(w) - 4)], np.uint64)
        least = (x[:, None] * factors + terms).min(0)
        own = {(b, *least[b * rows : (b + 1) * rows].tolist()) for b in range(bands)}
        expected[i] = not own & stayed
        if expected[i]:
            stayed |= own
    got = {r.doc_id: r.kept for r in dedup.minhash_keep(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), rows=rows, bands=bands).collect()}
    assert got == expected


def test_greedy_gone(spark):
    """The smallest id of band 1 goes through band 0; 4 is then behind 3, which stays."""
    members = spark.createDataFrame([(1, 0, 5), (2, 0, 5), (2, 1, 6), (3, 1, 6), (4, 1, 6), *[(k, 2, k // 2) for k in range(10, 21)], *[(k, 3, (k + 1) // 2) for k in range(10, 21)]], "id long, band int, key long")
    assert {r.id for r in dedup.greedy_gone(members).collect()} == {2, 4, 11, 13, 15, 17, 19}
    assert dedup.greedy_gone(members.limit(0)).count() == 0


def test_ngram_hits(spark):
    item = " ".join(f"i{k}" for k in range(15))
    items = spark.createDataFrame([(item,), (None,), ("short",)], "text string")
    texts = [f"x {item} y", " ".join(item.split()[:12]), " ".join(item.split()[:13]), f"{item} {item}", None, "", f"I0 {item[3:]}"]
    got = {r.doc_id: r.hits for r in decontam.ngram_hits(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), items).collect()}
    assert got == {0: 3, 2: 1, 3: 6, 6: 3}
    assert decontam.ngram_hits(docs(spark, [(1, item, "s")]), items.limit(0)).count() == 0


def test_remove_sentences(spark):
    blocked = decontam.sentence_hashes(spark.createDataFrame([("This one leaks here. Tiny.",)], "text string"))
    df = docs(spark, [(1, "Keep this sentence. This  ONE leaks here. Tiny.", "s"), (2, "This one leaks here.", "s"), (3, None, "s"), (4, "", "s")])
    got = {r.doc_id: (r.text, r.n_removed) for r in decontam.remove_sentences(df, blocked).collect()}
    assert got == {1: ("Keep this sentence. Tiny.", 1), 2: ("", 1), 3: (None, 0), 4: ("", 0)}


def test_prompt_hashes(spark):
    items = spark.createDataFrame([("The cat; sat!", "a"), ("the CAT sat", "b"), (None, "c"), ("..", "d")], "text string, eval_set string")
    rows = spark.createDataFrame([(1, "the cat sat", None), (2, "The cat sat\n\nmore", ""), (3, "another", "x"), (4, None, None)], "row_id long, instruction string, input string")
    got = sorted(map(tuple, decontam.matching_sets(rows, decontam.eval_hashes(items)).collect()))
    assert got == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]


def test_ranked_is_a_permutation_whatever_the_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id").withColumn("source", F.when(F.col("row_id") < 900, "hot").otherwise("cold"))
    a = {r.row_id: r.rn for r in sampling.ranked(df, ["source"], "row_id").collect()}
    b = {r.row_id: r.rn for r in sampling.ranked(df.repartition(7), ["source"], "row_id").collect()}
    assert a == b and sorted(v for k, v in a.items() if k < 900) == list(range(1, 901))


@pytest.mark.parametrize(("n", "val"), [(1, 1), (2, 1), (100, 5)])
def test_split_corpus(spark, n, val):
    out = sampling.split_corpus(spark.range(n).withColumnRenamed("id", "doc_id"))
    assert out.filter("split = 'val'").count() == val and out.count() == n


def test_split_groups_clamps(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "row_id long, source string")
    n = {r.source: r["count"] for r in sampling.split_groups(df).filter("split = 'val'").groupBy("source").count().collect()}
    assert n == {"a": 1, "b": 1, None: 1}
    assert sampling.split_groups(df, fraction=0).filter("split = 'val'").count() == 0


def test_weights(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id").withColumn("source", F.lit("a"))
    assert sampling.weight_copies(df, {"a": 2.5}).count() == 25
    assert sampling.weight_copies(df, {"a": 0.25}).count() == 2
    assert sampling.weight_copies(df, {}).count() == 10
    for bad in ({"a": float("nan")}, {"a": 0}, {"zzz": 1}):
        with pytest.raises(ValueError):
            sampling.check_weights(bad, {"a"})


@pytest.mark.parametrize("sizes", [[], [1], [4], [5], [8, 1], [3, 3, 3], [2, 20, 1]])
def test_pack(spark, sizes):
    flat, rows = [], []
    for i, n in enumerate(sizes):
        ids = [100 * i + k for k in range(n)]
        rows.append((i, ids))
        flat += ids
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = {r.chunk_id: (r.input_ids, r.target_ids) for r in packing.pack(df, 4).collect()}
    assert got == {i: (flat[4 * i : 4 * i + 4], flat[4 * i + 1 : 4 * i + 5]) for i in range(max(0, (len(flat) - 1) // 4))}


def test_eos_and_overflow(spark):
    df = spark.createDataFrame([([1, 2],), (None,)], "ids array<int>")
    assert [r[0] for r in df.select(packing.with_eos("ids")).collect()] == [[1, 2, packing.EOS], [packing.EOS]]
    with pytest.raises(Exception, match="65535"):
        spark.createDataFrame([([65536],)], "ids array<int>").select(packing.with_eos("ids")).collect()


def test_pair_tokens(spark):
    df = spark.createDataFrame([([1] * 4, [2]), ([1] * 3, [2, 2]), ([1], [2, 2]), ([1], [])], "p array<int>, b array<int>")
    got = [tuple(r) for r in df.select(*packing.pair_tokens("p", "b", 4).values()).collect()]
    assert got == [(None, 4, False, True), ([1, 1, 1, packing.EOS], 3, True, False), ([1, 2, 2, packing.EOS], 1, False, False), (None, 1, False, True)]


def test_collate(spark):
    df = spark.createDataFrame([(1, [5, 6, 7, 8], 2, 1), (2, [5, 6], 1, 2), (3, [5, 6, 7], 3, 3)], "row_id long, input_ids array<int>, prompt_len int, rn long")
    got = {r.row_id: (r.x, r.y) for r in packing.collate(df, 2).collect()}
    assert got == {1: ([5, 6, 7], [-100, 7, 8]), 2: ([5, packing.EOS, packing.EOS], [6, -100, -100]), 3: ([5, 6], [-100, -100])}
    assert packing.collate(df, 2, drop_last=True).count() == 2


def test_chains(spark):
    rows = [("r", None, "prompter"), ("a", "r", "assistant"), ("b", "a", "prompter"), ("c", "b", "assistant"), ("x", "gone", "assistant"), ("u", "r", "prompter"), ("v", "u", "assistant"), ("l1", "l2", "assistant"), ("l2", "l1", "prompter")]
    df = spark.createDataFrame([(*r, r[0]) for r in rows], "message_id string, parent_id string, role string, text string")
    got = {r.message_id: [m.text for m in r.chain] for r in R.ancestor_chains(df).collect()}
    assert got == {"a": ["r", "a"], "c": ["r", "a", "b", "c"]}


def test_deep_chain(spark):
    """A chain of 66 levels: each assistant message has its own depth."""
    rows = [(k, k - 1 if k else None, "assistant" if k % 2 else "prompter", "t") for k in range(66)]
    df = spark.createDataFrame(rows, "message_id long, parent_id long, role string, text string")
    assert {r.message_id: r.depth for r in R.ancestor_chains(df).collect()} == {k: k + 1 for k in range(1, 66, 2)}


def test_choice_letter(spark):
    df = spark.createDataFrame([("2",), ("b",), ("C",), ("9",), (None,)], "k string").withColumn("l", F.array(*[F.lit(x) for x in "ABCD"]))
    assert [r[0] for r in df.select(R.choice_letter("k", "l")).collect()] == ["B", "B", "C", None, None]


def test_alpaca_round_trip(spark):
    df = spark.createDataFrame([("do it ", None), ("do", "with"), (None, "")], "i string, x string")
    parts = R.alpaca_parts(F.col("p"))
    got = [tuple(r) for r in df.select(R.alpaca("i", "x").alias("p")).select(*parts.values()).collect()]
    assert got == [("do it", ""), ("do", "with"), ("", "")]


def test_upsert_and_running(spark):
    df = spark.createDataFrame([("r", 1, 1, 2.0, None), ("r", 1, 2, None, 5.0), ("r", 1, 3, 3.0, None), ("r", 5000, 1, 1.0, None), ("r", 9000, 1, 4.0, None)], "run_name string, step long, w long, a double, b double")
    one = runs.upsert(df, ["run_name", "step"], "w", ("a", "b"))
    assert sorted((r.step, r.a, r.b) for r in one.collect()) == [(1, 3.0, 5.0), (5000, 1.0, None), (9000, 4.0, None)]
    best = runs.running(one, "run_name", "step", "a", "min", "m")
    assert sorted((r.step, r.m) for r in best.collect()) == [(1, 3.0), (5000, 1.0), (9000, 1.0)]


def test_nucleus_and_top_k(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 1, 0.0), (1, 2, 0.0), (2, 0, 1.0), (2, 1, 1.0)], "g int, i int, x double")
    kept = sorted((r.g, r.i) for r in scoring.nucleus(df, "g", "i", "x", 0.9).collect())
    assert kept == [(1, 0), (2, 0), (2, 1)]
    assert scoring.nucleus(df, "g", "i", "x", 1.0).count() == 5
    assert scoring.top_k(df, "g", "x", 2).filter("g = 1").count() == 3


def test_choose_first_on_ties(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0), (2, 0, None), (2, 1, -1.0), (3, 4, None)], "g int, c int, s double")
    assert {r.g: r.c for r in scoring.choose(df, "g", "c", "s").collect()} == {1: 0, 2: 1, 3: 4}


def test_windows(spark):
    df = spark.createDataFrame([(1, 1), (2, 5), (3, 20)], "d long, n long")
    got = sorted(tuple(r) for r in scoring.windows(df, "d", "n", 8, 4).collect())
    expected = []
    for d, n in ((1, 1), (2, 5), (3, 20)):
        for s in range(0, n - 1, 4):
            e, f = min(s + 8, n - 1), 0 if s == 0 else s + 4
            expected.append((d, s, e, f, max(0, e - f)))
    assert got == sorted(expected)


def test_preference_is_stable(spark):
    df = spark.createDataFrame([(1000.0, 0.0, 0.0, 0.0), (-9000.0, 0.0, 0.0, 0.0)], "pi_c double, pi_r double, ref_c double, ref_r double")
    loss = [r.loss for r in scoring.preference(df).collect()]
    assert loss[0] == pytest.approx(0, abs=1e-9) and loss[1] == pytest.approx(900) and all(map(math.isfinite, loss))


def test_queries_have_twins_with_their_columns():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 100


def test_random_running_sum(spark):
    random.seed(1)
    values = [(("a" if random.random() < 0.9 else "b"), k, random.randint(0, 9)) for k in range(300)]
    df = spark.createDataFrame(values, "g string, k long, v long")
    got = {(r.g, r.k): r.s for r in runs.running(df, "g", "k", "v", "sum", "s", width=16).collect()}
    total: dict = {}
    for g, k, v in values:
        total[g] = total.get(g, 0) + v
        assert got[g, k] == total[g]


def test_schedules_by_hand(spark):
    steps = spark.createDataFrame([(s,) for s in (0, 5, 10, 60, 110, 500)], "s long")
    cos = [r[0] for r in steps.select(runs.cosine(F.col("s"), 2.0, 0.1, 10, 110)).collect()]
    assert cos == pytest.approx([0.0, 1.0, 2.0, 2 * 0.55, 0.2, 0.2])
    wsd = [r[0] for r in steps.select(runs.warm_stable_decay(F.col("s"), 2.0, 0.1, 10, 110, 0.5)).collect()]
    # the fall takes 55 steps from step 55 on
    assert wsd[:3] == pytest.approx([0.0, 1.0, 2.0]) and wsd[4:] == pytest.approx([0.2, 0.2]) and wsd[3] == pytest.approx(2 * (0.1 + 0.45 * (1 + math.cos(math.pi * 5 / 55))))


def test_parameter_count_by_hand(spark):
    df = spark.createDataFrame([(4, 2, 10, "swiglu"), (4, 2, 10, "gelu")], "d_model long, n_layers long, d_ff long, activation string")
    # 100 x 4, two blocks of 4 x 16 and three (or two) 4 x 10 and 8, and 4
    assert [r.n_params for r in runs.parameter_count(df, 100).collect()] == [400 + 2 * (64 + 120 + 8) + 4, 400 + 2 * (64 + 80 + 8) + 4]


def test_target_status_by_hand(spark):
    targets = spark.createDataFrame([("a", 10.0, 20.0), ("b", 10.0, 20.0), ("c", 10.0, 20.0)], "area string, low double, high double")
    now = spark.createDataFrame([("a", 25.004), ("b", 10.0)], "area string, pct double")
    got = {r.area: (r.current_pct, r.delta_to_mid, r.status) for r in mixture.target_status(now, targets).collect()}
    assert got == {"a": (25.0, -10.0, "high"), "b": (10.0, 5.0, "ok"), "c": (0.0, 15.0, "low")}


def test_whole_text(spark):
    df = spark.createDataFrame([(" i ", None, "o"), ("", "", ""), (None, "x", None)], "instruction string, input string, output string")
    assert [r.full_text for r in mixture.whole_text(df).collect()] == ["i\n\no", "", "x"]


@pytest.mark.parametrize("digits", [1, 3])
def test_ranks_do_not_depend_on_the_ranges(spark, digits):
    df = spark.createDataFrame([(k % 50, "a" if k % 3 else None) for k in range(300)], "row_id long, source string")
    plain = sorted((r.source or "", r.rn, r.row_id) for r in sampling.ranked(df, ["source"], "row_id").collect())
    assert plain == sorted((r.source or "", r.rn, r.row_id) for r in sampling.ranked(df, ["source"], "row_id", digits=digits).collect())


def test_offsets_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(k // 2, k % 7) for k in range(200)] + [(None, 3)], "doc_id long, n_tokens long").repartition(5)
    rows = sorted(packing.offsets(df).collect(), key=lambda r: r.token_offset + (r.n_tokens > 0) / 2)
    assert len(rows) == 200 and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    total = 0
    for r in rows:
        assert r.token_offset == total
        total += r.n_tokens
    assert packing.offsets(df.limit(0)).count() == 0


def test_hits_are_the_same_whatever_the_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + j) % 60}" for j in range(20))) for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(f"w{(k + j) % 80}" for j in range(60))) for k in range(40)] + [(99, None), (None, "x")], "doc_id long, text string")
    once = sorted(map(tuple, decontam.ngram_hits(docs, items, n=5).collect()))
    monkeypatch.setattr(decontam, "INDEX_BLOCK", 20)
    assert once and sorted(map(tuple, decontam.ngram_hits(docs, items, n=5).collect())) == once


def test_segments_of_any_shape(spark):
    schema = "a string, b array<string>, c struct<text:array<string>,label:array<string>>, d array<struct<text:string>>, e struct<text:string>"
    df = spark.createDataFrame([("1", ["2", None], (["3", "4"], ["A", "B"]), [("5",)], ("6",)), (None, None, None, None, None)], schema)
    assert sorted(r.t for r in decontam.segments_of(df, ("a", "b", "c", "d", "e")).collect()) == list("123456")


def test_best_reply_by_every_key(spark):
    rows = [("a", "p", "assistant", None, 9, "1"), ("b", "p", "assistant", 1, 1, "2"), ("c", "p", "assistant", 1, 3, "2"), ("d", "p", "assistant", 1, 3, "1"), ("e", "p", "assistant", 1, 3, "1"), ("f", "p", "prompter", 0, 9, "0"), ("g", "q", "assistant", None, None, None)]
    df = spark.createDataFrame(rows, "message_id string, parent_id string, role string, rank int, review_count int, created_date string")
    assert sorted(map(tuple, R.best_reply(df).collect())) == [("p", "d"), ("q", "g")]


def test_constrained_choice_falls_back(spark):
    inf = float("-inf")
    rows = [(1, 0, 5.0), (1, 1, 1.0), (1, 2, 1.0), (2, 0, 5.0), (2, 1, inf), (2, 2, None), (3, 0, 1.0)]
    df = spark.createDataFrame(rows, "q long, item long, s double")
    assert dict(map(tuple, scoring.choose_allowed(df, "q", "item", "s", (1, 2)).collect())) == {1: 1, 2: 0, 3: 0}
    assert dict(map(tuple, scoring.choose_allowed(df, "q", "item", "s", ()).collect())) == {1: 0, 2: 0, 3: 0}


def test_best_per_group_falls_back(spark):
    df = spark.createDataFrame([("a", "x", 2.0, 1.0), ("a", "y", 1.0, 0.0), ("b", "x", None, 1.0), ("b", "y", None, 3.0), ("c", "x", None, None)], "g string, run string, loss double, acc double")
    assert sorted(map(tuple, runs.best_per_group(df, "g", "run", "loss", "acc").collect())) == [("a", "y", True), ("b", "y", False), ("c", None, False)]


def test_duplicate_flags(spark):
    df = docs(spark, [(3, "x", "s"), (1, "x", "s"), (2, "y", "s"), (4, None, "s"), (5, None, "s")])
    assert sorted(map(tuple, dedup.flags(df).collect())) == [(1, True, 1), (2, False, 2), (3, True, 1), (4, True, 4), (5, True, 4)]


def test_remove_sentences_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, "Keep this one. Drop this sentence. Short."), (1, "Drop this sentence. And keep that."), (2, "Nothing here. At all"), (3, None), (4, ""), (None, "Drop this sentence.")], "doc_id long, text string")
    blocked = decontam.sentence_hashes(spark.createDataFrame([("DROP  this sentence. Other one stands.",), ("Short.",)], "text string"))
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in decontam.remove_sentences(df, blocked).collect()), key=str)
    assert got == [(1, "And keep that.", 1), (1, "Keep this one. Short.", 1), (2, "Nothing here. At all", 0), (3, None, 0), (4, "", 0), (None, "Drop this sentence.", 0)]


def test_chain_of_repeated_and_cyclic_messages(spark):
    rows = [(k, k - 1 if k else None, "assistant" if k % 2 else "prompter", f"t{k}") for k in range(300)] * 2
    rows += [(1000 + k, 1000 + (k + 1) % 4, "assistant" if k % 2 else "prompter", "c") for k in range(4)] + [(2000, 1001, "prompter", "h"), (2001, 2000, "assistant", "h"), (None, None, "prompter", "n")]
    df = spark.createDataFrame(rows, "message_id long, parent_id long, role string, text string")
    got = {r.message_id: r.chain for r in R.ancestor_chains(df).collect()}
    assert {i: len(c) for i, c in got.items()} == {k: k + 1 for k in range(1, 300, 2)} and [t.text for t in got[5]] == [f"t{k}" for k in range(6)]
