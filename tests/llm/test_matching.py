import random

import numpy as np
import pytest

from corpusforge.llm import leakage, neardup
from corpusforge.llm.common import words


def edited(base, rate, rng):
    return [w if rng.random() > rate else rng.choice([f"new{rng.randint(0, 999)}", ""]) for w in base]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows, i = [], 0
    for group in range(25):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(30, 200))]
        for copy in range(4):
            rows.append((i, " ".join(edited(base, (0, 0, 0.05, 0.15)[copy], rng))))
            i += 1
    rows += [(900, "hot copy " + " ".join(f"h{k}" for k in range(40)))] * 1
    rows += [(901 + k, rows[-1][1].upper() + "!") for k in range(30)]
    rows += [(2000, "too short"), (2001, None), (2002, "")]
    return rows


def truth(rows, similarity, size):
    sets = {}
    for i, t in rows:
        w = words(t or "")
        if len(w) >= 20:
            sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("similarity", "size"), [(0.6, 3), (0.8, 5)])
def test_pairs_against_brute_force(spark, corpus, similarity, size):
    df = spark.createDataFrame([(*r, 0, "k") for r in corpus], "doc_id long, text string, key long, id string")
    pairs, members = neardup.similar_pairs(df, similarity, size)
    got = {tuple(r) for r in neardup.all_pairs(pairs, members).collect()}
    assert got == truth(corpus, similarity, size)


def test_groups_are_components(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    pairs, members = neardup.similar_pairs(df, 0.6, 3)
    got = {r.id: r.group for r in neardup.groups(pairs, members).collect()}
    parent = {i: i for i, t in corpus if len(words(t or "")) >= 20}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in truth(corpus, 0.6, 3):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in parent}


def test_empty_and_null(spark):
    df = spark.createDataFrame([(None, "a " * 30), (1, None)], "doc_id long, text string")
    pairs, members = neardup.similar_pairs(df)
    assert pairs.count() == 0 and members.count() == 0 and neardup.groups(pairs, members).count() == 0


def test_every_document_has_a_group(spark):
    """Short copies and near copies, texts below a shingle, without words, empty and null."""
    near = [f"s{k}" for k in range(15)]
    rows = [(10, " ".join(near)), (11, " ".join(near[:14])), (12, " ".join(near).upper()), (20, "Two words"), (21, "two  words!"), (22, "other two"), (30, ""), (31, ""), (32, "..."), (40, None), (41, None), (None, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, neardup.document_groups(df).collect()))
    assert got == [(10, 10), (11, 10), (12, 10), (20, 20), (21, 20), (22, 22), (30, 30), (31, 30), (32, 32), (40, 40), (41, 41)]


@pytest.mark.parametrize("pairs_a_row", [0, 16])
def test_a_family_costs_pairs_in_proportion(spark, corpus, monkeypatch, pairs_a_row):
    """1,500 near copies of one text, beside others: the components are those of
    all pairs, from far fewer comparisons than the family has pairs."""
    rng = random.Random(8)
    base = [f"f{k}" for k in range(120)]
    family = [(5000 + k, " ".join(base[:k % 100] + [f"x{k}"] + base[k % 100 + 1 :])) for k in range(1500)]
    near = [(9000 + k, " ".join(w if rng.random() > 0.03 else "y" for w in base)) for k in range(20)]
    df = spark.createDataFrame(corpus + family + near, "doc_id long, text string").repartition(4)
    pairs, members = neardup.similar_pairs(df, least_words=0)
    slow = {r.id: r.group for r in neardup.groups(pairs, members).collect()}
    compared = []
    plain = neardup._near
    monkeypatch.setattr(neardup, "_near", lambda c, *rest: compared.append(c.count()) or plain(c, *rest))
    got = {r.id: r.group for r in neardup.document_groups(df, pairs_a_row=pairs_a_row).collect()}
    assert {i: g for i, g in got.items() if i in slow} == slow
    assert sum(compared) < 40 * len(got) < 1500 * 1499 / 2


def test_every_vector_within_the_radius_collides():
    """Any two of six lanes may differ in a part: some mask of it keeps none of them."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 32, neardup.LANES, dtype=np.uint32)
    for x in range(6):
        for y in range(x + 1, 6):
            other = rng.integers(0, 1 << 32, neardup.LANES, dtype=np.uint32)
            other[:6] = base[:6]
            other[[x, y]] += 1
            a, b = neardup.keys(np.stack([base, other]))
            assert (a == b)[: len(neardup.MASKS)].any()


# ------------------------------------------------------------------ leakage


def brute(doc, item):
    """Whether a stretch of 20 words of the item, or all of a shorter one, stands
    in the document with at most one word in eight substituted."""
    d, q = leakage.normal_words(doc), leakage.normal_words(item)
    n = min(20, len(q))
    for length in {n, min(24, len(q)), min(32, len(q))}:
        if length < n:
            continue
        for a in range(len(q) - length + 1):
            for p in range(len(d) - length + 1):
                if sum(x != y for x, y in zip(q[a : a + length], d[p : p + length])) <= length // 8:
                    return True
    return False


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(150)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 19, 25, 60])))) for k in range(25)]
    items.append((99, items[3][1].upper()))
    docs = []
    for i in range(120):
        filler = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        q = leakage.normal_words(rng.choice(items)[1])
        a = rng.randint(0, max(0, len(q) - 20))
        part = [w if rng.random() > 0.12 else f"x{rng.randint(0, 99)}" for w in q[a : a + rng.randint(15, 40)]]
        docs.append((i, " ".join(filler[:20] + part + filler[20:]) if i % 3 else " ".join(filler)))
    docs += [(500, None), (501, ""), (502, docs[1][1]), (503, docs[1][1])]
    di = spark.createDataFrame([(*r, "k") for r in docs], "doc_id long, text string, item string")
    ii = spark.createDataFrame(items + [(100, None), (101, "...")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(di, ii).collect()}
    expected = {(i, k) for i, t in docs if t for k, q in items if brute(t, q)}
    assert expected <= got
    # what alignment finds beyond substitution is close to the tolerance, never far from it
    assert len(got - expected) <= 0.1 * len(got) + 2
    assert {k for i, k in got if i == 502} == {k for i, k in got if i == 503}
    blocks = {(r.doc_id, r.item_id) for r in leakage.leaks(di, ii, block_words=50).collect()}
    assert blocks == got


@pytest.mark.parametrize(
    ("doc", "leaks"),
    [
        ("Before. Anna could not put the old jar into the red box from the far town because the JAR was much too wide, so she sold it. After.", True),
        ("Anna could not put the old jar into the red box from the far town because the very old tin jar was much too wide so she sold it", True),
        ("anna could not​ put the  old\njar into the red box from far town because the box was much too wide", True),
        ("anna could not put the old jar", False),
        ("", False),
    ],
)
def test_blank_spacing_and_dropped_words(doc, leaks):
    item = "Anna could not put the old jar into the red box from the far town because the _ was much too wide, so she sold it."
    assert bool(leakage.scan(leakage.Items([(1, item)]), leakage.Shard([doc]))) == leaks


def test_longest_match_beyond_the_window(spark):
    """Two copied runs of 60 and 150 words, the shorter one first and last; then a whole item of 300."""
    item = [f"i{k}" for k in range(300)]
    early, late = item[:60], item[100:250]
    gap = ["filler"] * 10
    docs = [(1, gap + early + gap + late), (2, late + gap + early), (3, gap + item), (4, item[:41]), (5, item[:42] + gap)]
    found = leakage.leaks(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, "other words")], "item_id long, text string"))
    got = {r.doc_id: (r.item_id, r.doc_word, r.item_word, r.n_words) for r in found.collect()}
    assert got == {1: (7, 80, 100, 150), 2: (7, 0, 100, 150), 3: (7, 10, 0, 300), 4: (7, 0, 0, 41), 5: (7, 0, 0, 42)}


def test_without_leaks(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "doc_id long, text string")
    assert {r.doc_id for r in leakage.without_leaks(df, spark.createDataFrame([(1,)], "doc_id long")).collect()} == {2, None}
    assert leakage.leaks(df.limit(0), spark.createDataFrame([], "item_id long, text string")).count() == 0
