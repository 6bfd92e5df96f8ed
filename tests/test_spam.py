"""Spam scoring against a direct count."""

import random

import pytest
from pyspark.sql import functions as F

from pagesieve.operators.spam import (
    dictionary_matches, dilute, is_high_spam, matched_phrases, spam_raw, spam_score, spam_scores_by_join,
)
from pagesieve.sources.dictionary import (
    EXPLICIT_WEIGHTS, MAX_LITERAL_PHRASES, as_literals, build_dictionary, dictionary_table, read_dictionary,
)


def texts_df(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, visible_text string")


def test_dictionary_rules():
    built = build_dictionary(["Cash", "cash bonus", "cash", "% off"], {"cash bonus": 3})
    assert built == {"cash": 1, "cash bonus": 3, "% off": 1}
    assert len(EXPLICIT_WEIGHTS) == 53
    assert sorted(EXPLICIT_WEIGHTS.values()) == [2] * 29 + [3] * 21 + [4] * 3


def test_read_dictionary(spark, tmp_path):
    (tmp_path / "phrases.txt").write_text("free gift\nbuy now\nbuy now\nBUY NOW\n\n")
    assert as_literals(read_dictionary(spark, str(tmp_path / "phrases.txt"))) == {"free gift": 3, "buy now": 1}
    (tmp_path / "weights.csv").write_text("buy now,7\n")
    assert as_literals(read_dictionary(spark, str(tmp_path / "phrases.txt"), str(tmp_path / "weights.csv"))) == {
        "free gift": 1, "buy now": 7,
    }


def test_substrings_overlaps_and_case(spark):
    words = build_dictionary(["cash", "bonus", "cash bonus", "ad", "cum"], {"cash bonus": 3})
    texts = ["A CASH BONUS for you", "read the document", "cash cash cash", "", None, "nothing"]
    got = [r.s for r in texts_df(spark, texts).select(spam_raw("visible_text", words).alias("s")).collect()]
    assert got == [1 + 1 + 3, 1 + 1, 1, 0, 0, 0]


def test_against_direct_count(spark):
    rnd = random.Random(7)
    alphabet = "ab .%?é"
    phrases = {"".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 5))) for _ in range(60)}
    words = {p: rnd.randint(1, 4) for p in phrases}
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    df = texts_df(spark, texts)
    expected = [sum(w for p, w in words.items() if p in t) for t in texts]
    assert [r.s for r in df.select(spam_raw("visible_text", words).alias("s")).collect()] == expected
    found = df.select(F.sort_array(matched_phrases("visible_text", words)).alias("p")).collect()
    assert [r.p for r in found] == [sorted(p for p in words if p in t) for t in texts]
    joined = {r.key: r.spam_score for r in spam_scores_by_join(df, dictionary_table(spark, words)).collect()}
    assert [joined[str(i)] for i in range(len(texts))] == expected
    pairs = {(r.key, r.phrase) for r in dictionary_matches(df, dictionary_table(spark, words)).collect()}
    assert pairs == {(str(i), p) for i, t in enumerate(texts) for p in words if p in t}


@pytest.mark.parametrize(
    ("length", "expected"), [(5000, 7), (5001, 7 * 5000 // 5001), (10_000, 3), (70_000, 0)]
)
def test_dilution(spark, length, expected):
    # dilution counts characters, not bytes
    df = spark.createDataFrame([("é" * length,)], "t string")
    assert df.select(dilute(F.lit(7).cast("long"), "t").alias("s")).first().s == expected


def test_gate_is_inclusive_and_spares_empty_text(spark):
    df = spark.createDataFrame([("x", 14), ("x", 15), ("", 15), (None, 20)], "t string, s int")
    assert [r.b for r in df.select(is_high_spam("t", "s", 15).alias("b")).collect()] == [False, True, False, False]
    df = spark.createDataFrame([("",)], "t string")
    assert df.select(spam_score("t", EXPLICIT_WEIGHTS).alias("s")).first().s == 0


def test_large_dictionaries_are_refused_as_literals(spark):
    with pytest.raises(ValueError):
        matched_phrases("t", {f"phrase {i}": 1 for i in range(MAX_LITERAL_PHRASES + 1)})


def test_empty_dictionary(spark):
    df = texts_df(spark, ["a", "b"])
    assert [r.s for r in df.select(spam_score("visible_text", {}).alias("s")).collect()] == [0, 0]
    assert dictionary_matches(df, dictionary_table(spark, {})).count() == 0


def test_long_text(spark):
    words = build_dictionary(["aab", "ab", "abc"])
    df = texts_df(spark, ["a" * 500_000 + "b", "ab" * 300_000])
    assert [r.s for r in df.select(spam_raw("visible_text", words).alias("s")).collect()] == [2, 1]


def test_automata_of_one_and_of_many_shards(spark, monkeypatch):
    from pagesieve.operators import phrases

    rnd = random.Random(5)
    base = "".join(rnd.choice("abc d") for _ in range(300))
    words = {base[i : i + n].lower(): 1 for n in (1, 2, 5, 7, 8, 9, 13, 40) for i in range(0, 200, 37)}
    words |= {base[3:11] + "zz": 1, base[9:21] + "no": 1}  # begin right, go on wrong
    texts = [base, base[50:120].upper(), base[:12], "", None]
    df = texts_df(spark, texts)
    expected = {(str(i), p) for i, t in enumerate(texts) for p in words if p in (t or "").lower()}
    sums = {str(i): sum(p in (t or "").lower() for p in words) for i, t in enumerate(texts)}
    for limit in (phrases.SHARD_BYTES, 700):  # one shard, and characters cut by hash
        monkeypatch.setattr(phrases, "SHARD_BYTES", limit)
        assert {r.key: r.spam_score for r in spam_scores_by_join(df, dictionary_table(spark, words)).collect()} == sums
        found = dictionary_matches(df, dictionary_table(spark, words)).collect()
        assert len(found) == len(expected) and {(r.key, r.phrase) for r in found} == expected
    nobody = spark.createDataFrame([(None, "a b")], "key string, visible_text string")
    assert dictionary_matches(nobody, dictionary_table(spark, words)).count() == 0


def test_a_hundred_thousand_phrases_move_no_text(spark):
    words = {f"phrase {i} of many": 1 + i % 3 for i in range(100_000)}
    texts = [" / ".join(f"Phrase {i} of many" for i in range(k, 100_000, 9_973)) for k in range(40)]
    df, table = texts_df(spark, texts), dictionary_table(spark, words).repartition(8)
    scored = spam_scores_by_join(df, table)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    expected = [sum(w for p, w in ((f"phrase {i} of many", 1 + i % 3) for i in range(100_000)) if p in t.lower()) for t in texts[:3]]
    got = {r.key: r.spam_score for r in scored.collect()}
    assert [got[str(i)] for i in range(3)] == expected
    assert dictionary_matches(df, table).count() == sum(len(t.split(" / ")) for t in texts)
