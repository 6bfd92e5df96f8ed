"""Gates, shapes, scores, sinks and the whole batch pipeline on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.functions.quality import penalized_quality, quality_score
from pagesieve.operators.dedup import first_per_signature, mark_duplicates, survivors
from pagesieve.operators.document import attach_enrichment, to_documents
from pagesieve.operators.language import gate_language, is_rejected_language, train_language_profile
from pagesieve.operators.metrics import SPAM_BUCKETS, observe_outcomes, run_counters, spam_histogram
from pagesieve.operators.upsert import id_collisions, latest_per_id
from pagesieve.plans.curate import curate
from pagesieve.schemas import DOCUMENT, ENRICHMENT, PAGE, SIGNATURES, Options
from pagesieve.sinks.bulk import bulk_lines, write_bulk

ENGLISH = "the quick brown fox jumps over the lazy dog and then the other dog in the house"
FRENCH = "le renard brun saute par dessus le chien paresseux et la maison de la ville est belle"
KEYED = T.StructType([T.StructField("key", T.StringType()), T.StructField("ingest_order", T.LongType()), *PAGE.fields])


def page(key, order, **fields):
    row = {f.name: None for f in PAGE.fields}
    row.update(url=f"https://example.com/{key}", visible_text=ENGLISH, is_secure=True)
    row.update(fields)
    return (key, order, *[row[f.name] for f in PAGE.fields])


def pages_df(spark, rows):
    return spark.createDataFrame(rows, KEYED)


@pytest.fixture(scope="module")
def profile(spark):
    labelled = spark.createDataFrame([(ENGLISH, "en"), (FRENCH, "fr")], "text string, lang string")
    return train_language_profile(labelled)


def enrichment_df(spark, rows):
    return spark.createDataFrame(rows, ENRICHMENT)


def outcomes(curated):
    return {r.key: r.outcome for r in curated.decisions.collect()}


def test_gate_order(spark, profile):
    """An invalid URL does not claim its signature; a page rejected later has claimed it."""
    rows = [
        page("a", 1, url="/relative", visible_text=ENGLISH),
        page("b", 2, visible_text=ENGLISH),
        page("c", 3, visible_text=f"\n{ENGLISH} "),
        page("d", 4, visible_text=FRENCH),
        page("e", 5, visible_text=FRENCH),
        page("f", 6, visible_text="buy viagra and cialis in the house of the dog and the fox"),
        page("g", 7, visible_text="buy viagra and cialis in the house of the dog and the fox"),
        page("h", 8, visible_text="short"),
        page("i", 9, visible_text=""),
        page("j", 10, visible_text=None),
        page("k", 11, visible_text=ENGLISH.upper()),
    ]
    options = Options(spam_threshold=4)
    run = curate(pages_df(spark, rows), {"viagra": 2, "cialis": 2}, profile, None, enrichment_df(spark, []), options)
    assert outcomes(run) == {
        "a": "invalid_url", "b": "indexed", "c": "duplicate", "d": "non_english", "e": "duplicate", "f": "high_spam",
        "g": "duplicate", "h": "indexed", "i": "indexed", "j": "duplicate", "k": "indexed",
    }
    assert {r.key for r in run.new_signatures.collect()} == set("bdfhik")
    rejected = {r.key: (r.outcome, r.detected_language, r.spam_score) for r in run.rejected.collect()}
    assert rejected["a"] == ("invalid_url", None, None)
    assert rejected["d"] == ("non_english", "fr", None)
    assert rejected["e"] == ("duplicate", None, None)
    assert rejected["f"] == ("high_spam", "en", 4)
    counters = run_counters(run.decisions, options).first().asDict()
    assert counters == {
        "pages_processed": 4, "invalid_urls": 1, "unkeyed": 0, "duplicates": 4, "non_english": 1, "high_spam": 1, "detection_failures": 0,
    }


def test_seen_signatures_are_duplicates(spark, profile):
    rows = [page("a", 1), page("b", 2, visible_text=ENGLISH + " more")]
    first = curate(pages_df(spark, rows[:1]), {}, profile, None, enrichment_df(spark, []))
    store = first.new_signatures.select("sig", "key", F.lit(0).cast("long").alias("batch_id"))
    second = curate(pages_df(spark, rows), {}, profile, store, enrichment_df(spark, []))
    assert outcomes(second) == {"a": "duplicate", "b": "indexed"}
    assert SIGNATURES.fieldNames() == store.columns


def test_first_wins_is_by_order_then_key(spark):
    signed = spark.createDataFrame([("s", 2, "a"), ("s", 1, "z"), ("s", 1, "y"), ("t", 5, "b")], "sig string, ingest_order int, key string")
    assert {(r.sig, r.key) for r in first_per_signature(signed).collect()} == {("s", "y"), ("t", "b")}
    marked = {r.key: r.is_duplicate for r in mark_duplicates(signed).collect()}
    assert marked == {"a": True, "z": True, "y": False, "b": False}
    store = spark.createDataFrame([("s",), ("s",)], "sig string")
    assert [r.key for r in survivors(signed, store).collect()] == ["b"]


def test_one_hot_signature(spark):
    """A third of all pages share a text; the plan never shuffles by their signature alone without pre-aggregation."""
    pages = spark.range(30_000).select(
        F.col("id").alias("ingest_order"), F.col("id").cast("string").alias("key"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("sig"),
    )
    assert survivors(pages).count() == 20_001
    assert mark_duplicates(pages).where("is_duplicate").count() == 9_999


@pytest.mark.parametrize(
    ("detected", "confidence", "n_bytes", "language", "rejected"),
    [
        ("fr", 0.1, 19, "unknown", False),
        ("fr", 0.1, 20, "fr", True),
        ("fr", 0.33, 20, "fr", True),
        ("fr", 0.3301, 20, "fr", False),
        ("en", 0.01, 20, "en", False),
        (None, None, 500, "unknown", False),
    ],
)
def test_language_gate(spark, detected, confidence, n_bytes, language, rejected):
    df = spark.createDataFrame([(detected, confidence, n_bytes)], "d string, c double, n int")
    gated = df.withColumn("lang", gate_language("d", "n")).withColumn("r", is_rejected_language("lang", "c")).first()
    assert (gated.lang, gated.r) == (language, rejected)


def test_shapes(spark, profile):
    rows = [
        page("full", 1, url=" HTTPS://Example.com/A", canonical_url="//Example.com/C", title="A title", visible_text=f" {ENGLISH}  a",
             internal_links=["/x", "//Example.com/y"], external_links=["/z"], load_time=1_500_000_000,
             date_published=dt.datetime(2025, 2, 13, 10), social_links=["//Raw"]),
        page("failed", 2, url=" HTTPS://Example.com/B", title="A title", visible_text=f" {ENGLISH}  b", load_time=5),
        page("empty", 3, url=" HTTPS://Example.com/C", title="A title", visible_text=""),
    ]
    found = [("full", [("Ada", "PERSON")], ["w", "x", "y", "z"]), ("empty", [("No", "NO")], ["no"])]
    run = curate(pages_df(spark, rows), {"fox": 3}, profile, None, enrichment_df(spark, found))
    docs = {r.key: r for r in run.documents.collect()}
    assert [f for f in run.documents.columns if f in DOCUMENT.fieldNames()] == DOCUMENT.fieldNames()
    full = docs["full"]
    assert (full.shape, full.url, full.canonical_url, full.visible_text) == (
        "full", " HTTPS://Example.com/A", "https://example.com/C", f" {ENGLISH}  a",
    )
    assert (full._id, full.language, full.entities, full.keywords) == ("example.com_C", "en", ["PERSON: Ada"], ["w", "x", "y", "z"])
    assert (full.internal_links, full.external_links, full.social_links) == (["https://example.com/y"], None, ["//Raw"])
    assert (full.load_time, full.is_secure, full.spam_score) == (1500, True, 3)
    # title 10, entity 10, keywords 10, internal link 5, English 10, secure 25, 1.5 s 5; twice the spam off
    assert full.quality_score == 75 - 6
    assert full.last_crawled is not None and full.date_published == dt.datetime(2025, 2, 13, 10)
    failed = docs["failed"]
    assert (failed.shape, failed.url, failed.visible_text) == ("nlp_failed", "https://example.com/B", f"{ENGLISH} b")
    assert (failed.title, failed.language, failed.quality_score, failed.spam_score, failed.load_time) == ("", "", 0, 3, 0)
    assert failed.entities is None and failed.last_crawled is None
    empty = docs["empty"]
    assert (empty.shape, empty.url, empty.visible_text, empty.spam_score) == ("empty_text", "https://example.com/C", "", 0)
    assert empty.entities is None
    clean = curate(pages_df(spark, rows[:1]), {}, profile, None, enrichment_df(spark, found), Options(emit_clean=True))
    assert clean.documents.first().visible_text == f"{ENGLISH} a"


def test_quality_break_points(spark):
    schema = "t string, ti string, m string, e array<string>, k array<string>, i array<string>, x array<string>, l string, s boolean, ms long"
    nothing = ("", "", "", None, None, None, None, "fr", False, 3000)

    def score(**changes):
        row = dict(zip([c.split()[0] for c in schema.split(", ")], nothing)) | changes
        df = spark.createDataFrame([tuple(row.values())], schema)
        return df.select(quality_score("t", "ti", "m", "e", "k", "i", "x", "l", "s", "ms").alias("q")).first().q

    assert score() == 0
    assert score(t="x" * 100) == 0 and score(t="x" * 101) == 10 and score(t="é" * 51) == 10
    assert score(ti="x" * 5) == 0 and score(ti="x" * 6) == 10 and score(ti="x" * 149) == 10 and score(ti="x" * 150) == 0
    assert score(m="x" * 50) == 0 and score(m="x" * 51) == 5
    assert score(e=[]) == 0 and score(e=["a"]) == 10
    assert score(k=["a"] * 3) == 0 and score(k=["a"] * 4) == 10
    assert score(i=["a"]) == 5 and score(x=["a"]) == 5 and score(l="en") == 10 and score(s=True) == 25 and score(s=None) == 0
    assert [score(ms=v) for v in (None, 0, 999, 1000, 1999, 2000, 2999, 3000)] == [10, 10, 10, 5, 5, 2, 2, 0]
    best = dict(t="x" * 101, ti="x" * 6, m="x" * 51, e=["a"], k=["a"] * 4, i=["a"], x=["a"], l="en", s=True, ms=0)
    assert score(**best) == 100


def test_spam_penalty(spark):
    df = spark.createDataFrame([(50, 0), (50, 10), (50, 24), (50, 25), (50, 26), (0, 3)], "q int, s int")
    assert [r.p for r in df.select(penalized_quality("q", "s").alias("p")).collect()] == [50, 30, 2, 0, 0, 0]


def test_spam_histogram(spark):
    scores = [0, 0, 1, 3, 5, 14, 200]
    rows = spam_histogram(spark.createDataFrame([(s,) for s in scores], "spam_score int")).collect()
    bounds = [*map(float, SPAM_BUCKETS), float("inf")]
    assert [(r.bound, r.pages) for r in rows] == [(b, sum(s <= b for s in scores)) for b in bounds]
    assert {(r.n, r.score_sum) for r in rows} == {(7, 223)}


def test_observed_counters(spark, profile, tmp_path):
    from pyspark.sql import Observation

    run = curate(pages_df(spark, [page("a", 1), page("b", 2)]), {}, profile, None, enrichment_df(spark, []))
    seen = Observation("run")
    observe_outcomes(run.decisions, seen).write.format("noop").mode("overwrite").save()
    assert seen.get["pages_processed"] == 1 and seen.get["duplicates"] == 1


def test_latest_document_per_id(spark):
    docs = spark.createDataFrame(
        [("x", 1, "a", "old"), ("x", 3, "b", "new"), ("x", 2, "c", "mid"), ("y", 1, "d", "only")],
        "_id string, ingest_order int, key string, title string",
    )
    assert {(r._id, r.title) for r in latest_per_id(docs).collect()} == {("x", "new"), ("y", "only")}
    assert [(r._id, r.documents) for r in id_collisions(docs).collect()] == [("x", 3)]


def test_bulk_file(spark, tmp_path):
    """Two documents give four lines: an action line before each document line."""
    pages = pages_df(
        spark,
        [
            page("1", 1, url="http://example.com/page1", title="One", visible_text="a"),
            page("2", 2, url="https://example.com/page2", canonical_url="https://example.com/page2", title="Two", visible_text='q"\n'),
        ],
    ).withColumns({"norm_url": F.col("url"), "lang": F.lit("en"), "spam": F.lit(0)})
    found = enrichment_df(spark, [("1", [], []), ("2", [("Ada", "PERSON")], ["k"])])
    docs = to_documents(attach_enrichment(pages, found))
    write_bulk(docs, str(tmp_path / "bulk"), Options(index_name="test-index"))
    lines = [line for f in sorted((tmp_path / "bulk").glob("part-*")) for line in f.read_text().splitlines()]
    assert len(lines) == 4
    actions, bodies = [json.loads(x)["index"] for x in lines[::2]], [json.loads(x) for x in lines[1::2]]
    assert {a["_index"] for a in actions} == {"test-index"}
    assert {a["_id"]: b["title"] for a, b in zip(actions, bodies)} == {"example.com_page1": "One", "example.com_page2": "Two"}
    for body in bodies:
        assert list(body) == DOCUMENT.fieldNames()
        assert body["categories"] is None and body["open_graph"] == {"og:title": "", "og:description": "", "og:image": ""}
    assert all(r.value.count("\n") == 1 for r in bulk_lines(docs).collect())
    write_bulk(docs, str(tmp_path / "small"), documents_per_file=1)
    assert len(list((tmp_path / "small").glob("part-*"))) >= 2
