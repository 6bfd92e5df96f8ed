"""Small inputs for the operators: nulls, empties, repeats, clashing column names."""

from __future__ import annotations

import pytest

SENTENCES = [
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon",
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen",
]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null and empty texts, a very long one, repeated rows, null ids and sources, and columns named like the operators' own."""
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "   \t\n", None), (4, SENTENCES[0], "a"), (4, SENTENCES[0], "a"), (5, SENTENCES[0] + " phi", "b"),
        (None, SENTENCES[1], "b"), (6, " ".join(SENTENCES * 2000), "c"), (7, "ÀÉ ß <|endoftext|> 漢字", "c"), (8, "x", "a"),
    ]
    rows = [(d, t, "en", s, len(t or ""), 0.5, [1], "k", True, 3) for d, t, s in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, spans array<int>, row string, kept boolean, n int"
    return spark.createDataFrame(rows, names)
