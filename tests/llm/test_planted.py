"""Cases planted among sound rows, found again: recall and precision of the
operators whose answers the test tables do not carry."""

import random

import pytest

from corpusforge.llm import langid, mojibake, pairs, quality

NOUNS = "jar dam bell well rope spade cup lamp door clock fence river boat baker window garden bridge letter basket stone".split()
KINDS = "old red quiet heavy small narrow empty bright wooden broken".split()
OTHERS = {
    "de": ["Der junge Bäcker öffnet das alte Fenster, weil der Regen aufgehört hat.", "Die fröhliche Lehrerin verkauft den schönen Garten nicht.", "Nach dem Frühstück gehen wir über die große Straße zum Schloss.", "Am Abend zählt der Müller die grünen Bäume am Fluss."],
    "fr": ["Le jeune boulanger ouvre la vieille fenêtre parce que la pluie a cessé.", "L’élève discrète a trouvé le chapeau près de la rivière.", "Après le dîner nous marchons dans la forêt avec les enfants.", "Le soir, la fermière compte les bœufs derrière l’église."],
    "ru": ["Молодой пекарь открывает старое окно, потому что дождь закончился.", "Весёлая учительница продаёт большой сад около реки.", "После завтрака мы идём через широкую улицу к старому замку.", "Вечером мельник считает зелёные деревья у реки."],
}


def sentence(rng):
    a, b, c = (f"{rng.choice(KINDS)} {rng.choice(NOUNS)}" for _ in range(3))
    return rng.choice([f"The {a} was near the {b} because they had left the {c} in the garden.", f"What she carried was not the {a} but the {b} of the {c}.", f"After the rain we found a {a} and the {b} by the {c}.", f"It was the {a} that stood on the {b}, and he took it for the {c}."])


def prose(rng, n=6):
    return " ".join(sentence(rng) for _ in range(n))


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(1)
    rows = [("en", sentence(rng)) for _ in range(40)] + [(g, t) for g, ts in OTHERS.items() for t in ts]
    return spark.createDataFrame(sorted(set(rows)), "lang string, text string").cache()


def compared(found, true):
    both = len(found & true)
    return both / len(true), both / max(1, len(found))


def test_kinds(spark, samples):
    rng = random.Random(2)
    item = lambda: f"{rng.choice(KINDS)} {rng.choice(NOUNS)}"
    make = {
        "list": [
            lambda: "\n".join(f"- {item()}" for _ in range(rng.randint(6, 14))),
            lambda: sentence(rng) + "\n\n" + "\n".join(f"{k}. {item()}" for k in range(1, rng.randint(8, 14))),
            lambda: "\n".join(item().capitalize() for _ in range(rng.randint(6, 14))),
        ],
        "table": [lambda: (lambda sep: "\n".join(sep.join(rng.choice([item(), str(rng.randint(1, 999))]) for _ in range(4)) for _ in range(rng.randint(5, 12))))(rng.choice(["|", "\t", ";", ","]))],
        "junk": [
            lambda: " ".join("".join(rng.choice("#<>~=!@*_%^+/|&{}") for _ in range(rng.randint(3, 9))) for _ in range(30)),
            lambda: "".join(rng.choice("abcdefABCDEF0123456789+/") for _ in range(200)),
            lambda: " ".join([item()] * 40),
        ],
        None: [lambda: prose(rng), lambda: prose(rng).upper(), lambda: prose(rng).replace(". ", ".\n"), lambda: prose(rng) + "\n- jar\n- dam", lambda: "\n".join(sentence(rng) for _ in range(5))],
    }
    rows, true = [], set()
    for kind, makers in make.items():
        for _ in range(60):
            rows.append((len(rows), rng.choice(makers)()))
            if kind:
                true.add((rows[-1][0], kind))
    found = {(r.doc_id, r.kind) for r in quality.kinds(spark.createDataFrame(rows, "doc_id long, text string"), samples).collect()}
    recall, precision = compared(found, true)
    assert recall >= 0.95 and precision >= 0.98


def test_wrong_encodings(spark, samples):
    rng = random.Random(3)
    rows, true, restored = [], set(), {}
    for chain in [*mojibake.MULTI[:8], *mojibake.DOUBLE]:
        for _ in range(6):
            sound = rng.choice([t for ts in OTHERS.values() for t in ts] + ["It’s a café – “old” and naïve."])
            bad = mojibake.garble(sound, chain)
            if bad is None or bad == sound:
                continue
            whole = prose(rng, 2)
            rows.append((len(rows), f"{whole} {bad} {whole}"))
            true.add(rows[-1][0])
            restored[rows[-1][0]] = f"{whole} {sound} {whole}"
    for _ in range(100):
        rows.append((len(rows), prose(rng, 2) + " " + rng.choice([t for ts in OTHERS.values() for t in ts] + ["© 2015, 12 °C, £3", "ÉCOLE", "naïve – “so”"])))
    got = {r.doc_id: r.text for r in mojibake.repairs(spark.createDataFrame(rows, "doc_id long, text string"), samples).collect()}
    recall, precision = compared(set(got), true)
    assert recall >= 0.97 and precision >= 0.98
    assert sum(got.get(i) == t for i, t in restored.items()) >= 0.9 * len(restored)


def test_languages(spark, samples):
    rng = random.Random(4)
    rows, true = [], set()
    for lang, sentences in {**OTHERS, "en": [sentence(rng) for _ in range(8)]}.items():
        for _ in range(20):
            text = " ".join(rng.choice(sentences) for _ in range(4))
            label = rng.choice([lang, {"de": "German", "fr": "fr-FR", "ru": "rus", "en": "English (US)"}[lang], None, "xx", "it"])
            rows.append((len(rows), text, label))
            if langid.label_code(label) != lang:
                true.add((rows[-1][0], lang))
    for _ in range(20):
        a, b = rng.sample(sorted(OTHERS), 2)
        rows.append((len(rows), " ".join([*OTHERS[a], *OTHERS[b]]), rng.choice([a, b, None])))
        true |= {(rows[-1][0], a), (rows[-1][0], b)}
    found = {tuple(r) for r in langid.corrections(spark.createDataFrame(rows, "doc_id long, text string, lang string"), samples).collect()}
    recall, precision = compared(found, true)
    assert recall >= 0.97 and precision >= 0.97


def test_segments_of_switched_sentences(spark, samples):
    """Words labelled with their own language, where it changes inside sentences."""
    rng = random.Random(5)
    rows, truth = [], {}
    for k in range(40):
        words, langs = [], []
        for lang in rng.sample(["en", *OTHERS], 3):
            part = langid.units(" ".join(sentence(rng) for _ in range(2)) if lang == "en" else " ".join(rng.sample(OTHERS[lang], 2)))[0]
            words += part
            langs += [lang] * len(part)
        rows.append((k, " ".join(words)))
        truth[k] = langs
    right = total = 0
    for r in langid.language_segments(spark.createDataFrame(rows, "doc_id long, text string"), samples).collect():
        own = truth[r.doc_id][r.first_word : r.first_word + r.n_words]
        right += sum(x == r.lang for x in own)
        total += len(own)
    assert total == sum(map(len, truth.values())) and right >= 0.95 * total


def test_defects(spark, samples):
    rng = random.Random(6)
    ask = lambda: f"Describe the {rng.choice(KINDS)} {rng.choice(NOUNS)} in a few sentences."
    cut = lambda t: t[: rng.randint(len(t) // 2, len(t) - 4)].rstrip(" .,")
    make = {
        "empty": lambda: (ask(), rng.choice([None, "", " \n", "N/A", "<nooutput>", "None.", "​"])),
        "truncated": lambda: (ask(), cut(prose(rng, 3))),
        "refusal": lambda: (ask(), rng.choice(["I'm sorry, but I can't help with that.", "As an assistant, I'm unable to answer this question.", "Unfortunately, I’d rather not respond to this one. I hope you understand.", "I cannot provide that. Please ask something else."])),
        "copy": lambda: (lambda q: (q, rng.choice([q, q.upper(), f"You asked: {q}"])))(ask()),
        "other_language": lambda: (ask(), " ".join(rng.sample(OTHERS[rng.choice(sorted(OTHERS))], 2))),
        None: lambda: rng.choice([(ask(), prose(rng, 3)), ("Answer in German: what is a jar?", OTHERS["de"][0]), ("List three things.", "- jar\n- dam\n- bell"), ("Which one?\n\nA) jar\nB) dam", "B")]),
    }
    rows, true = [], set()
    for defect, maker in make.items():
        for _ in range(40):
            instruction, output = maker()
            rows.append((len(rows), instruction, "", output))
            if defect:
                true.add((rows[-1][0], defect))
    found = {(r.row_id, r.defect) for r in pairs.defects(spark.createDataFrame(rows, "row_id long, instruction string, input string, output string"), samples).collect()}
    recall, precision = compared(found, true)
    assert recall >= 0.95 and precision >= 0.97
