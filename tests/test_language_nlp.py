"""Language model, entities and keyphrases against direct computations."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesieve.operators import entities as entities_module
from pagesieve.operators import keyphrases as keyphrases_module
from pagesieve.operators import language as language_module
from pagesieve.operators.entities import extract_entities, format_entities, pattern_entities
from pagesieve.operators.keyphrases import extract_keyphrases, train_word_frequencies
from pagesieve.operators.language import count_trigrams, detect_language, train_language_profile, trigrams
from pagesieve.schemas import LANGUAGE_PROFILE, Options

TEXTS = [("Abc ab! abc", "en"), ("xyz xyz", "fr"), ("ab", "fr"), ("ünï 12 ünï", "de"), ("skip", None)]


def grams(text):
    letters, out = text.lower(), ""
    for c in letters:
        out += c if c.isalpha() else ("" if out.endswith(" ") else " ")
    return [out[i : i + 3] for i in range(len(out) - 2)]


def test_trigrams(spark):
    df = spark.createDataFrame([(t,) for t in ("Abc ab! abc", "ab", "", "12ünï", "𝒜𝒷𝒸𝒹")], "t string")
    got = [r.g for r in df.select(trigrams("t").alias("g")).collect()]
    assert got[:4] == [grams("Abc ab! abc"), [], [], [" ün", "ünï"]]
    assert got[4] == ["𝒜𝒷𝒸", "𝒷𝒸𝒹"]


def direct_profile():
    counts, totals = Counter(), Counter()
    for text, lang in TEXTS:
        for g in grams(text) if lang else []:
            counts[lang, g] += 1
            totals[lang] += 1
    v = len({g for _, g in counts})
    seen = {k: math.log((n + 0.5) / (totals[k[0]] + 0.5 * v)) for k, n in counts.items()}
    return seen | {(lang, ""): math.log(0.5 / (t + 0.5 * v)) for lang, t in totals.items()}


def test_profile(spark):
    profile = train_language_profile(spark.createDataFrame(TEXTS, "text string, lang string"))
    assert profile.columns == LANGUAGE_PROFILE.fieldNames()
    got = {(r.lang, r.gram): r.logp for r in profile.collect()}
    assert got == pytest.approx(direct_profile())


@pytest.mark.parametrize("broadcast_bytes", [10**6, 0])
def test_detection(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(language_module, "_BROADCAST_BYTES", broadcast_bytes)
    profile = train_language_profile(spark.createDataFrame(TEXTS, "text string, lang string"))
    pages = ["abc abc xyz abc abc abc abc", "xyz xyz abc xyz xyz xyz", "qqq qqq qqq qqq qqq qqq qqq", "abc", "123 456 789 123 456 789"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(pages)], "key int, visible_text string")
    got = {r.key: (r.detected, r.en_conf) for r in detect_language(df, profile, ["key"]).collect()}
    model = direct_profile()
    langs = sorted({lang for lang, _ in model})
    expected = {}
    for i, text in enumerate(pages):
        gs = grams(text)
        if len(text.encode()) < 20 or not any((lang, g) in model for lang in langs for g in gs):
            continue
        mean = {lang: sum(model.get((lang, g), model[lang, ""]) for g in gs) / len(gs) for lang in langs}
        total = sum(math.exp(a) for a in mean.values())
        expected[i] = (max(mean, key=mean.get), math.exp(mean["en"]) / total)
    assert set(got) == set(expected) == {0, 1}
    for i, (lang, confidence) in expected.items():
        assert got[i][0] == lang and got[i][1] == pytest.approx(confidence)


def test_pattern_entities(spark):
    text = (
        "On 2024-05-01 Acme.example.com paid $1,200.50 and €5, up 12.5 % by 3 March 2023 or March 4, 2022 at 10:30; "
        "call 555-1234, see x.org/y and v2.0."
    )
    df = spark.createDataFrame([(text,), ("",), (None,)], "visible_text string")
    rows = df.select(format_entities(pattern_entities("visible_text")).alias("e")).collect()
    assert rows[0].e == [
        "DATE: 2024-05-01", "ORG: Acme.example.com", "MONEY: $1,200.50", "MONEY: €5", "PERCENT: 12.5 %", "DATE: 3 March 2023",
        "DATE: March 4, 2022", "TIME: 10:30", "CARDINAL: 555", "CARDINAL: 1234", "ORG: x.org",
    ]
    assert rows[1].e is None and rows[2].e is None


RULES = [  # text, entities
    ("www.example.company", []), ("a.organic a.org", ["ORG: a.org"]), ("2024-01-021", []), ("1.5kg of 1.5", ["CARDINAL: 1.5"]),
    ("10.example.com", ["ORG: 10.example.com"]), (".".join(["a"] * 40) + ".com", ["ORG: " + ".".join(["a"] * 40) + ".com"]),
    ("x" * 200 + ".net", ["ORG: " + "x" * 200 + ".net"]), ("$5k $5.", ["MONEY: $5"]), ("xMay 4, 2022", ["CARDINAL: 4", "CARDINAL: 2022"]),
    ("at 10:305 or 10:30:15", ["TIME: 10:30:15"]), ("12 %x 12 %", ["PERCENT: 12 %"]), ("é5 5é", []), ("end.Next", []),
]


def test_entities_end_with_words(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RULES)], "key int, visible_text string")
    for found in (df.select("key", pattern_entities("visible_text").alias("entities")), extract_entities(df, NOBODY(spark))):
        got = {r.key: r.e or [] for r in found.select("key", format_entities("entities").alias("e")).collect()}
        assert got == {i: e for i, (_, e) in enumerate(RULES)}


def NOBODY(spark):
    return spark.createDataFrame([("5é 5é", "NONE"), ("...", "NONE")], "name string, label string")


def test_long_runs_need_no_stack(spark):
    n = 20_000
    texts = ["1," * n + "2", "a." * n + "com", "a-" * n, "1" * n, "é1." * n, "May " * n]
    df = spark.createDataFrame([(t,) for t in texts], "visible_text string")
    rows = [r.e for r in df.select(pattern_entities("visible_text").alias("e")).collect()]
    assert [(e.label, e.text) for e in rows[0]] == [("CARDINAL", texts[0])]
    assert [(e.label, e.text) for e in rows[1]] == [("ORG", texts[1])] and rows[2] == []
    assert [(e.label, len(e.text)) for e in rows[3]] == [("CARDINAL", n)]
    names = spark.createDataFrame([("May May", "PERSON")], "name string, label string")
    found = extract_entities(df.withColumn("key", F.monotonically_increasing_id()), names)
    assert found.select(F.max(F.size("entities")).alias("n")).first().n == n // 2


@pytest.mark.parametrize("broadcast_names", [10**6, 0])
def test_gazetteer(spark, monkeypatch, broadcast_names):
    monkeypatch.setattr(entities_module, "_BROADCAST_BYTES", broadcast_names)
    docs = spark.createDataFrame(
        [("a", "In new  York, york and New-York City; then YORK"), ("b", "nothing"), ("c", None)], "key string, visible_text string"
    )
    names = spark.createDataFrame([("New York", "GPE"), ("york", "GPE"), ("New York City", "LOC"), ("New York", "GPE")], "name string, label string")
    got = {r.key: [(e.label, e.text) for e in r.entities] for r in extract_entities(docs, names).collect()}
    assert got["a"] == [("GPE", "new York"), ("GPE", "york"), ("LOC", "New York City"), ("GPE", "YORK")]
    assert got["b"] == [] and got["c"] == []


def test_names_of_any_length_in_text_order(spark):
    docs = spark.createDataFrame(
        [("a", "In 2020 the University of New York and O'Neill met Coca-Cola, 5 % up, at Area 51 of york.com")], "key string, visible_text string"
    )
    names = spark.createDataFrame(
        [("University of New York", "ORG"), ("New York", "GPE"), ("O'Neill", "PERSON"), ("coca-cola", "ORG"), ("Area 51", "FAC"), ("York", "GPE"), ("", "X")],
        "name string, label string",
    )
    assert [(e.label, e.text) for e in extract_entities(docs, names).first().entities] == [
        ("CARDINAL", "2020"), ("ORG", "University of New York"), ("PERSON", "O Neill"), ("ORG", "Coca Cola"), ("PERCENT", "5 %"),
        ("FAC", "Area 51"), ("ORG", "york.com"),
    ]
    assert extract_entities(docs, names.limit(0)).first().entities[0].text == "2020"


def direct_keyphrases(texts, stop, top_n, diversity):
    """Maximal marginal relevance over every candidate, straight from the definition."""
    import re

    tokens = [[w for w in re.findall(r"\w{2,}", t.lower()) if w not in stop] for t in texts]
    df = Counter(w for ws in tokens for w in set(ws))
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}

    def vector(words):
        return {w: n * idf[w] for w, n in Counter(words).items()}

    def cosine(a, b):
        dot = sum(v * b.get(w, 0) for w, v in a.items())
        return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    out = []
    for words in tokens:
        runs = {tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
        relevance = {r: round(cosine(vector(r), vector(words)), 9) for r in runs}
        order = sorted(runs, key=lambda r: (-relevance[r], r))
        picked = []
        while order and len(picked) < top_n:
            def value(r):
                redundancy = max((cosine(vector(r), vector(p)) for p in picked), default=0.0)
                return round((1 - diversity) * relevance[r] - diversity * round(redundancy, 9), 9)

            best = max(order, key=value)
            picked.append(best)
            order.remove(best)
        out.append([" ".join(r) for r in sorted(picked, key=lambda r: (-relevance[r], r))])
    return out


@pytest.mark.parametrize(("broadcast_words", "top_n", "diversity"), [(10**6, 10, 0.5), (8, 3, 0.7), (8, 2, 0.0)])
def test_keyphrases(spark, monkeypatch, broadcast_words, top_n, diversity):
    monkeypatch.setattr(keyphrases_module, "_BROADCAST_WORDS", broadcast_words)
    rng = np.random.default_rng(3)
    vocabulary = [f"word{i}" for i in range(60)] + ["the", "of"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    texts = [" ".join(rng.choice(vocabulary, size=n, p=weights / weights.sum())) for n in (1, 2, 5, 40, 200, 400)]
    texts += ["", "x y z", "same same same same"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, visible_text string")
    options = Options(top_keyphrases=top_n, diversity=diversity)
    got = {r.key: list(r.keyphrases) for r in extract_keyphrases(docs, options, stop_words=["the", "of"]).collect()}
    expected = direct_keyphrases(texts, {"the", "of"}, top_n, diversity)
    assert [got[str(i)] for i in range(len(texts))] == expected


def test_saved_frequencies(spark):
    corpus = spark.createDataFrame([("a", "alpha beta"), ("b", "alpha gamma")], "key string, visible_text string")
    saved = train_word_frequencies(corpus, stop_words=[])
    assert {r.word: r.df for r in saved.collect()} == {"": 2, "alpha": 2, "beta": 1, "gamma": 1}
    new = spark.createDataFrame([("c", "alpha delta")], "key string, visible_text string")
    got = extract_keyphrases(new, Options(diversity=0.0), stop_words=[], frequencies=saved).first()
    # an unseen word weighs more than a common one
    assert list(got.keyphrases) == ["alpha delta", "delta", "alpha"]


def test_default_stop_words(spark):
    docs = spark.createDataFrame([("a", "the and of")], "key string, visible_text string")
    assert list(extract_keyphrases(docs).first().keyphrases) == []


def test_keyphrases_with_rare_words_beside_the_broadcast(spark, monkeypatch):
    from pagesieve.operators import keyphrases

    texts = ["red green blue red", "green blue violet", "blue amber", "amber " + "q" * 100 + " red", "", None]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, visible_text string")
    whole = {r.key: list(r.keyphrases) for r in extract_keyphrases(docs, stop_words=["blue"]).collect()}
    assert len(whole) == 6 and whole["4"] == whole["5"] == []
    for limit in (0, 2):
        monkeypatch.setattr(keyphrases, "_BROADCAST_WORDS", limit)
        assert {r.key: list(r.keyphrases) for r in extract_keyphrases(docs, stop_words=["blue"]).collect()} == whole


def test_keyphrases_shuffle_no_texts(spark):
    from pagesieve.operators.keyphrases import train_word_frequencies

    docs = spark.createDataFrame([("a", "red green blue")], "key string, visible_text string")
    found = extract_keyphrases(docs, stop_words=[], frequencies=train_word_frequencies(docs, stop_words=[]))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


class Sent:
    """A broadcast value."""

    def __init__(self, value):
        self.value = value


def test_rest_of_a_page_is_made_by_bounded_slices(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from pagesieve.operators import language

    texts = ["the cat", "", "ab", "über the", "the the " * 20, "x y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["key", "folded"])
    known = np.array([language._codes("the")[0][0]]), np.array([[-1.0, -2.0]]), np.array([-5.0, -6.0])
    score = language._score(Sent(known), ["key"], True)
    (whole,) = score(iter([batch]))
    monkeypatch.setattr(language, "_SLICE_BYTES", 16)
    parts = list(score(iter([batch])))
    assert len(parts) > 1 and pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()
    for row, text in zip(whole.to_pylist(), texts):
        grams = [text[i : i + 3] for i in range(len(text) - 2)]
        assert {r["gram"]: r["times"] for r in row["rest"]} == {g: grams.count(g) for g in grams if g != "the"}
        assert row["n"] == len(grams) and row["known"] == ("the" in grams)


def test_pages_are_ranked_by_bounded_slices(monkeypatch):
    import pyarrow as pa

    pages = [["a", "b", "a"], [], ["of"], ["b"] * 30, ["c", "of", "d"]]
    rare = [None, None, None, None, [{"word": "d", "df": 2}]]
    kind = pa.list_(pa.struct([("word", pa.string()), ("df", pa.int64())]))
    arrays = [pa.array(range(5), pa.int64()), pa.array(pages, pa.list_(pa.string())), pa.array(rare, kind)]
    batch = pa.RecordBatch.from_arrays(arrays, ["key", "words", "_rare"])
    rank = keyphrases_module._rank(Sent({"a": 3, "b": 1}), 5, frozenset(["of"]), "key", 3, 0.5)
    (whole,) = rank(iter([batch]))
    monkeypatch.setattr(keyphrases_module, "_SLICE_WORDS", 4)
    parts = list(rank(iter([batch])))
    assert [p.num_rows for p in parts] == [3, 1, 1]
    assert pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()


def test_trigrams_are_counted_without_a_row_for_each(spark, monkeypatch):
    monkeypatch.setattr(language_module, "_HELD_GRAMS", 3)
    texts = [*TEXTS, ("Ünï 中文字符 𝒳𝒴𝒵 x", "DE"), ("", "de"), (None, "fr"), ("ab", "fr"), ("abc abc", None)]
    df = spark.createDataFrame(texts, "text string, lang string")
    expected = Counter((lang.lower(), g) for text, lang in texts if lang for g in grams(text or ""))
    counts = count_trigrams(df)
    assert {(r.lang, r.gram): r.n for r in counts.collect()} == expected
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
