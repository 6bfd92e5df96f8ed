"""The divergence audit against direct sums over whole dense tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from pagesieve.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute_force(rows, top=200):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source in rows]
    counts, held, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        counts[lang, source].update(words)
        held[lang].update(set(words))
        total[lang].update(words)
    kept = {lang: sorted(t for t, n in c.items() if n >= 3) for lang, c in held.items()}

    def shares(lang, c):
        n = sum(c[t] for t in kept[lang])
        return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept[lang])) for t in kept[lang]}

    def f(p, q):
        return (p - q) ** 2 // q

    out = set()
    of = {g: shares(g[0], c) for g, c in counts.items()}
    whole = {lang: shares(lang, c) for lang, c in total.items()}
    for (lang, source), p in of.items():
        pairs = [(o, sum(f(p[t], of[lang, o][t]) for t in kept[lang])) for a, o in of if a == lang and o != source]
        terms = [(t, f(p[t], whole[lang][t])) for t in kept[lang] if counts[lang, source][t] and p[t] > whole[lang][t]]
        for part, found, most in (("pair", pairs, 10**9), ("term", terms, top)):
            for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1):
                if rank <= most:
                    out.add((lang, source, part, item, value, rank))
    return out


def rows_of(spark, rows, **options):
    found = divergence.source_divergence(spark.createDataFrame(rows, SCHEMA), **options).collect()
    return {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in found}, len(found)


def made(seed, n, sources=7):
    random.seed(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["É", "straße", "漢字"]
    rows = []
    for k in range(n):
        text = " ".join(random.choice(words[: random.randint(5, len(words))]) + random.choice(["", ".", "1", "X"]) for _ in range(random.randint(0, 60)))
        rows.append((k, text, random.choice(["en", "de"]), "hot" if k % 3 == 0 else f"s{random.randrange(sources)}"))
    return rows


@pytest.mark.parametrize("blocks", [(20_000, 512), (10, 512), (1, 3)])
def test_divergence_matches_dense_sums(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", blocks[0])
    monkeypatch.setattr(divergence, "ROWS", blocks[1])
    rows = made(1, 150)
    found, n = rows_of(spark, rows)
    assert found == brute_force(rows) and n == len(found)
    assert rows_of(spark, rows, top_terms=3)[0] == brute_force(rows, 3)


def test_shuffled_groups_and_small_combiners_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(divergence, "COMBINED", 1)
    rows = made(2, 80)
    assert rows_of(spark, rows)[0] == brute_force(rows)


def test_odd_documents(spark, odd_documents):
    long = "alpha beta gamma " * 60_000
    rows = [
        (1, None, None, None), (1, None, None, None), (2, "", "en", "a"), (3, "12 34 ..", "en", "b"), (4, long, "fr", "x"), (5, "alpha", "fr", "y"),
        (5, "alpha", "fr", "y"), (6, "Alpha BETA", "fr", None), (None, "only one", "xx", "z"), (7, "c d", "en", "a"), (8, "ÀÉ", "fr", "x"),
    ]
    found, n = rows_of(spark, rows)
    assert found == brute_force(rows) and n == len(found)
    assert ("en", "a", "pair", "b", 0, 1) in found  # no kept term in this language
    assert rows_of(spark, [])[0] == set()
    clashing = divergence.source_divergence(odd_documents.selectExpr("*", "1 AS term", "2 AS g", "3 AS p", "'x' AS item"))
    expected = brute_force([(r.doc_id, r.text, r.lang, r.source) for r in odd_documents.collect()])
    assert {tuple(r) for r in clashing.collect()} == expected


def test_a_frequency_is_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n = 10**13 + 7
    row = spark.range(1).select(divergence.frequency(F.lit(n), F.lit(3 * n), F.lit(1000)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (3 * n + 1000)
