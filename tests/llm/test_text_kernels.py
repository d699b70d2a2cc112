import numpy as np
import pytest

from corpusforge.llm import langid, mojibake, pairs, quality

SAMPLES = {
    "en": ["The young baker opened the old window because the rain had stopped.", "What the farmer carried was not a heavy basket but a small letter.", "After the storm we walked along the river and counted the boats."],
    "de": ["Der junge Bäcker öffnet das alte Fenster, weil der Regen aufgehört hat.", "Die fröhliche Lehrerin verkauft den schönen Garten nicht.", "Nach dem Frühstück gehen wir über die große Straße zum Schloss."],
    "fr": ["Le jeune boulanger ouvre la vieille fenêtre parce que la pluie a cessé.", "L’élève discrète a trouvé le chapeau près de la rivière.", "Après le dîner nous marchons dans la forêt avec les enfants."],
    "es": ["El joven panadero abre la ventana vieja porque la lluvia ha parado.", "La niña pequeña no vende el jardín español en otoño.", "Después de la cena caminamos por la montaña con los niños."],
    "ru": ["Молодой пекарь открывает старое окно, потому что дождь закончился.", "Весёлая учительница продаёт большой сад около реки.", "После завтрака мы идём через широкую улицу к старому замку."],
}
ROWS = tuple(sorted((k, t) for k, v in SAMPLES.items() for t in v))
CLEAN = tuple(sorted(t for _, t in ROWS))


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(list(ROWS), "lang string, text string").cache()


@pytest.fixture(scope="module")
def field():
    return langid.language_model(ROWS)


@pytest.fixture(scope="module")
def garbled():
    return mojibake.model(CLEAN)


# ---------------------------------------------------------- wrong encoding


@pytest.mark.parametrize("chain", [*mojibake.MULTI[:9], *mojibake.DOUBLE])
def test_round_trip_of_chains(garbled, chain):
    text = SAMPLES["de"][1] + " " + SAMPLES["fr"][0]
    bad = mojibake.garble(text, chain)
    found, fixed, _ = garbled.judge(bad)
    assert found and mojibake.repair_text(bad, fixed) == text


@pytest.mark.parametrize("chain", [(("koi8-r", "latin-1"),), (("cp1251", "latin-1"),), (("cp1251", "koi8-r"),)])
def test_single_byte_cyrillic(garbled, chain):
    text = " ".join(SAMPLES["ru"])
    bad = mojibake.garble(text, chain)
    assert garbled.judge(bad)[0]


@pytest.mark.parametrize("text", [*CLEAN, "PEQUEÑA ÑANDÚ", "© 2015 Harrow™ · 13 °C, ±1 µm, 44 € / £60 «Tam» §5 ½", "éä", "&ntilde;a &amp; b", "ﬁnal 漢字 😀", "guard​ed", "", " "])
def test_sound_text_is_left_alone(garbled, text):
    assert not garbled.judge(text)[0]


def test_the_classifier_decides(garbled):
    """Without its weights nothing is found, and with weights shuffled over classes or features far less."""
    import copy

    texts = [mojibake.garble(" ".join(v), chain) for v in SAMPLES.values() for chain in mojibake.MULTI[:6]]
    texts = [t for t in texts if t is not None and not t.isascii()]
    assert all(garbled.judge(t)[0] for t in texts)
    rng = np.random.default_rng(1)
    for weights in (np.zeros_like(garbled.weights), rng.permuted(garbled.weights, axis=0), rng.permuted(garbled.weights, axis=1)):
        other = copy.copy(garbled)
        other.weights, other.known, other.alone = weights, {}, {}
        assert sum(other.judge(t)[0] for t in texts) < 0.75 * len(texts)


def test_training_words_hold_every_script():
    """Thousands of Latin words leave room for the Cyrillic ones."""
    clean = [f"é{k}wörter" for k in range(6000)] + SAMPLES["ru"]
    model = mojibake.GarbleModel(clean)
    bad = mojibake.garble(" ".join(SAMPLES["ru"]), (("cp1251", "latin-1"),))
    assert model.judge(bad)[0] and "cp1251" in str(mojibake.CHAINS[model.judge(bad)[2] - 1])


def test_lost_characters_are_a_case(garbled):
    assert garbled.judge("Cet �t�")[0] and garbled.judge("it\x80\x99s")[0]


def test_repairs(spark, samples):
    df = spark.createDataFrame([(1, "Der BÃ¤cker"), (1, "Der BÃ¤cker"), (2, None), (3, ""), (None, "BÃ¤cker"), (4, "plain")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.restored) for r in mojibake.repairs(df, samples).collect())
    assert got == [(1, "Der Bäcker", True)] * 2


# ------------------------------------------------------------------- kinds

PROSE = "The young baker opened the old window because the rain had stopped. After the storm we walked along the river and counted the boats. What the farmer carried was not a heavy basket but a small letter."


KINDS = [
    (PROSE, None),
    (PROSE.upper(), None),
    (PROSE.replace(". ", ".\n"), None),
    ("\n".join(PROSE[i : i + 40] for i in range(0, len(PROSE), 40)), None),
    (PROSE + "\n- jar\n- old dam", None),
    ("- red jar\n- old dam\n- bell\n- the quiet well\n- a candle\n- spade\n- lantern of tin", "list"),
    ("A sentence that leads into the things below it.\n\n1. jar\n2. dam\n3. bell\n4. well\n5. tin lantern\n6. old rope\n7. sharp spade\n8. cup", "list"),
    ("a|b|c\n1|2|3\nx y|z|w\n4|5|6\nlong name|other name|third name here", "table"),
    ("Name;Town;Price\njar;Ash;12\ndam;Elm;30\nbell;Oak;41\nwell;Fir;7\nrope;Yew;19", "table"),
    ("name   town   price\njar    Ash    12\ndam    Elm    30\nbell   Oak    41\nwell   Fir    99", "table"),
    ("#### <<<< ~~~~ ==== !!!! @@@@ ***** ____ %%%% ^^^^ ++++ //// ---- |||| >>>>", "junk"),
    ("old jar | red dam | old jar | red dam | red dam | old jar | old jar | red dam | old jar", "junk"),
    ("aGVsbG8gd29ybGQgaGVsbG8gd29ybGQgaGVsbG8gd29ybGQ= aGVsbG8gd29ybGQgaGVsbG8gd29ybGQ", "junk"),
    ("too short", None),
    ("", None),
    (None, None),
    (" " * 100, "junk"),
]


def test_kinds(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(KINDS)], "doc_id long, text string")
    got = {r.doc_id: (r.kind, r.reason) for r in quality.with_kinds(df).collect()}
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (_, k) in enumerate(KINDS)}
    # every case has the rule that named it, prose has none
    assert all((k is None) == (r is None) for k, r in got.values())
    assert {r for _, r in got.values()} - {None} <= {r for _, r, _ in quality.KIND_RULES}


def test_long_texts_do_not_upset_the_patterns(spark):
    """A million characters in one token, in one line, and in many lines."""
    rows = [(1, "#" * 1_000_000), (2, "a(b" * 300_000), (3, "jar | dam\n" * 100_000), (4, PROSE * 5000), (5, "item\n" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kind for r in quality.with_kinds(df).collect()}
    assert got[1] == got[2] == "junk" and got[3] in ("table", "junk") and got[4] is None


def test_kinds_of_a_frame(spark, samples):
    df = spark.createDataFrame([(1, "a|b|c\n" * 30, "x"), (2, None, "x"), (None, "a|b|c\n" * 30, "x"), (3, PROSE, "x")], "doc_id long, text string, kind string")
    assert [(r.doc_id, r.kind) for r in quality.kinds(df, samples).collect()] == [(1, "table")]
    assert quality.kinds(df.limit(0), samples).count() == 0


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The cat sat.\n- on\nthe mat # x"), (2, None), (3, "")], "doc_id long, text string")
    a, b, c = quality.rule_failures(quality.statistics(df)).orderBy("doc_id").collect()
    assert (a.n_words, a.n_lines, a.punctuated_lines, a.bullet_lines) == (9, 3, pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert a.symbol_ratio == pytest.approx(1 / 9) and a.common_words == pytest.approx(3 / 9)
    assert b.n_words == c.n_words == 0 and "n_words" in b.reasons


# --------------------------------------------------------------- languages


def test_code_switched_text(field):
    text = " ".join([*SAMPLES["en"], *SAMPLES["ru"], *SAMPLES["de"]])
    found, starts = langid.units(text)
    langs = {x[0] for x in langid.mixture(found, starts, field.label([(found, starts)])[0], field.languages, least=15)}
    assert langs == {"en", "ru", "de"}


def test_windows_agree_with_one_pass(field, monkeypatch):
    found, starts = langid.units(" ".join([*SAMPLES["en"], *SAMPLES["fr"]] * 30))
    whole = field.label([(found, starts), (found[:50], starts[:50])])
    for size in (200, 37, 1):
        monkeypatch.setattr(langid, "WINDOW", size)
        parts = field.label([(found, starts), (found[:50], starts[:50])])
        assert all(np.allclose(a, b, atol=2e-3) for a, b in zip(parts, whole))


def test_a_switch_inside_a_sentence(field):
    """No mark between the languages, and both are found, each from its first word to its last."""
    parts = [langid.units(" ".join(SAMPLES[g]).replace(".", "").replace(",", ""))[0] for g in ("de", "ru")]
    found = [w for p in parts for w in p]
    starts = np.zeros(len(found), bool)
    starts[0] = True
    prob = field.label([(found, starts)])[0]
    assert {x[0] for x in langid.mixture(found, starts, prob, field.languages, least=15)} == {"de", "ru"}
    got = langid.segments(found, prob, field.languages)
    assert [g[2] for g in got] == ["de", "ru"] and abs(got[0][1] - len(parts[0])) <= 1


def test_twenty_short_words_count(spark, samples):
    """Twenty words of one letter are 39 characters."""
    text = " ".join("вкосуиаявкосуиаявкос")
    got = langid.corrections(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"), samples).collect()
    assert [tuple(r) for r in got] == [(1, "ru")]


@pytest.mark.parametrize(("label", "code"), [("English (US)", "en"), ("de_AT", "de"), ("POR", "pt"), (" fr ", "fr"), ("xx", None), ("", None), (None, None), ("e n", None)])
def test_one_rule_for_labels(spark, label, code):
    from corpusforge.llm.tokens import lang_key

    assert langid.label_code(label) == code
    assert spark.createDataFrame([(label,)], "lang string").select(lang_key("lang")).first()[0] == code


def test_forward_backward_against_enumeration(field):
    import itertools

    found, starts = langid.units("The Bäcker la. ventana")
    e, k = field.emissions(found).astype(float), len(field.languages)
    total = np.zeros((len(found), k))
    for path in itertools.product(range(k), repeat=len(found)):
        s = sum(e[t, y] for t, y in enumerate(path)) + sum(field.steps[int(starts[t])][path[t - 1], path[t]] for t in range(1, len(found)))
        for t, y in enumerate(path):
            total[t, y] += np.exp(s)
    assert np.allclose(field.label([(found, starts)])[0], total / total.sum(1, keepdims=True), atol=1e-3)


def test_corrections(spark, samples):
    en, de = " ".join(SAMPLES["en"]), " ".join(SAMPLES["de"])
    rows = [(1, en, "en-GB"), (2, en, "German"), (3, de, None), (4, f"{en} {de}", "en"), (5, "too short", None), (6, None, "en"), (None, de, None), (7, en, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(map(tuple, langid.corrections(df, samples).collect()))
    assert got == [(2, "en"), (3, "de"), (4, "de"), (4, "en"), (7, "en")]
    full = langid.document_languages(df, samples)
    assert {r.doc_id: r.lang for r in full.filter("doc_id in (1, 6)").collect()} == {1: "en", 6: None}
    assert langid.language_segments(df.limit(0), samples).count() == 0


# ------------------------------------------------------------------- pairs

LIST_TASK = "List 3 things you might find in a bakery."
CHOICE = "Which option would help?\n\nA) old jar\nB) red dam\nC) bell\nD) well"
ANSWER = "The young baker opened the old window. After the storm we walked along the river."


@pytest.mark.parametrize(
    ("instruction", "given", "output", "expected"),
    [
        ("Tell me about the baker.", "", ANSWER, None),
        ("Tell me about the baker.", None, None, "empty"),
        ("Tell me about the baker.", "", " ﻿\n", "empty"),
        ("Tell me about the baker.", "", "N/A", "empty"),
        ("Tell me about the baker.", "", "<noinput>", "empty"),
        ("Tell me about the baker.", "", ANSWER[:-14], "truncated"),
        ("Tell me about the baker.", "", "The young baker opened the old window. After the storm (see", "truncated"),
        ("Write code.", "", "Here it is:\n```python\nx = 1", "truncated"),
        ("Tell me about the baker.", "", "I'd rather not respond to this one. You may want to talk to a mason instead.", "refusal"),
        ("Tell me about the baker.", "", "Kann ich leider nicht beantworten.", "refusal"),
        ("Tell me about the baker.", "", "N/A" + "." * 400, "empty"),
        ("Tell me about the baker.", "", "The young ba", "truncated"),
        ("Tell me about the baker.", "", "The <b>young baker opened the old window.", "truncated"),
        ("Tell me about the baker.", "", "The <b>young</b> baker opened the **old** window.<br>", None),
        ("Tell me about the baker.", "", "1. The young baker opened the window.\n2. After the storm we walked home.\n3. What the farmer", "truncated"),
        ("Tell me about the baker.", "", "Да, конечно", "other_language"),
        (LIST_TASK, "", "- Old jar\n- Red dam\n- Bell", None),
        (LIST_TASK, "", "Old jar\nRed dam\nBell", None),
        (CHOICE, "", "B)", None),
        (CHOICE, "", "red dam", None),
        (CHOICE, "", CHOICE, "copy"),
        ("Give this text a title.", ANSWER, "The Old Window of the Baker", None),
        ("Tell me about the baker.", "", "You asked: Tell me about the baker.", "copy"),
        ("Shorten this text.", ANSWER, ANSWER, "copy"),
        ("Shorten this text.", ANSWER, f"{ANSWER}\n{ANSWER}", "copy"),
        ("Repeat the sentence exactly as it is.", ANSWER, ANSWER, None),
        ("Tell me about the baker.", "", "I'm sorry, but I can't help with that.", "refusal"),
        ("Tell me about the baker.", "", "As an assistant, I won't be able to write that. I hope you understand.", "refusal"),
        ("Write an apology note to Ann.", "", "Dear Ann, I'm sorry that I lost the jar. I cannot say how it happened, but it fell.", None),
        ("Tell me about the baker.", "", " ".join(SAMPLES["de"]), "other_language"),
        ("Translate the following into German.", "The baker.", " ".join(SAMPLES["de"]), None),
        ("Answer in German: what do you know?", "", " ".join(SAMPLES["de"]), None),
    ],
)
def test_defects(field, instruction, given, output, expected):
    assert pairs.defect(field, instruction, given, output)[0] == expected


def test_tiles_against_the_plain_algorithm():
    import random

    rng = random.Random(4)

    def slow(a, b, least):
        fa, fb, covered = [True] * len(a), [True] * len(b), 0
        while True:
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and fa[i + k] and fb[j + k]:
                        k += 1
                    if k > best[0]:
                        best = (k, i, j)
            k, i, j = best
            if k < least:
                return covered
            fa[i : i + k], fb[j : j + k] = [False] * k, [False] * k
            covered += k

    for _ in range(60):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert sum(n for _, _, n in pairs.tiles(a, b, 3)) == slow(a, b, 3)


def test_long_repetition_is_quick():
    assert pairs.covered(["a"] * 5000, ["a"] * 4000) == 0.8


def test_defects_of_a_frame(spark, samples):
    rows = [(1, "Tell me.", "", None, "x"), (2, "Tell me.", "", None, "x"), (None, "Tell me.", "", None, "x"), (3, None, None, ANSWER, "x"), (4, "Hi", "", "Yes", "x")]
    df = spark.createDataFrame(rows, "row_id long, instruction string, input string, output string, id string")
    assert sorted((r.row_id, r.defect) for r in pairs.defects(df, samples).collect()) == [(1, "empty"), (2, "empty")]
    assert pairs.defects(df.limit(0), samples).count() == 0


def test_every_labelled_sentence_is_trained_on():
    """1,200 sentences of a word of their own each, most of one language."""
    rows = [("de" if k % 6 else "fr", f"zq{k}x{k * k}") for k in range(1200)]
    model = langid.LanguageModel(rows, rounds=3)
    own = [langid.crc32(f"w{t}".encode()) % langid.FEATURES for _, t in rows]
    assert (model.weights[own] != 0).any(1).all()


def test_long_refusals():
    """Nine sentences, and more than 600 characters; one sentence that answers ends it."""
    once = "I'm sorry, but I cannot help with that request because of the guidelines that I have to follow here."
    assert pairs.is_refusal("Write a poem.", " ".join([once] * 9)) and len(once) * 9 > 600
    assert pairs.is_refusal("Write a poem.", " ".join(["I cannot answer that question."] * 8))
    assert not pairs.is_refusal("Write a poem.", " ".join([once] * 9) + " The sea is blue and the boats are white.")


def test_repairs_of_numeric_entities(spark, samples):
    """ASCII texts whose wrongly decoded characters are numeric entities, decimal and hexadecimal."""
    df = spark.createDataFrame([(1, "Der B&#195;&#164;cker"), (2, "Der B&#xC3;&#xa4;cker"), (3, "Der B&Atilde;&curren;cker"), (4, "one &#38; two &#8212; three"), (5, "AT&T; plain")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in mojibake.repairs(df, samples).collect()} == dict.fromkeys((1, 2, 3), "Der Bäcker")


def test_whatever_the_grammar_accepts_is_a_refusal():
    """No first look stands before the grammar."""
    for text in ("Kann ich leider nicht beantworten.", "Dabei kann ich nicht helfen.", "I’m unable to help with this request.", "Regrettably, I’d rather not respond to this one."):
        assert pairs.REFUSAL.match(text) and pairs.is_refusal("Write a poem.", text)


@pytest.mark.parametrize(
    ("text", "waiting", "items"),
    [
        ("a (b [c) d", [], 0),
        ("a (b", [")"], 0),
        ("```\n( [ <b>\n```", [], 0),
        ("- one (two\n- three", [], 2),
        ("1. **one**\n2. **two", ["**"], 2),
        ("<p>a <i>b</i>", ["</p>"], 0),
        ("a) b) :)", [], 1),
        ("", [], 0),
    ],
)
def test_pushdown_parser(text, waiting, items):
    assert pairs.open_at_end(text) == waiting and len(pairs.parse(text)[1]) == items
