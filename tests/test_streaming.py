"""Sources, the signature store and the stream: stream equals batch, and a replayed batch changes nothing."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from pagesieve.operators.metrics import spam_histogram
from pagesieve.plans.curate import curate
from pagesieve.registry.params import DICTIONARY, OPTIONS
from pagesieve.registry.queries import document_pages, label_enrichment, language_profile
from pagesieve.schemas import ENRICHMENT, PAGE
from pagesieve.session import shared_folder
from pagesieve.sinks.current import committed_counters, committed_spam_scores, current_documents
from pagesieve.sinks.tables import latest_documents, rejected_table
from pagesieve.sources.dictionary import dictionary_table
from pagesieve.sources.enrichment import align_batches
from pagesieve.sources.membership import SignatureStore
from pagesieve.sources.pages import (
    assign_arrival, pages_from_kafka, read_pages_json, read_pages_parquet, split_undecodable, stream_pages_json,
)
from pagesieve.sources.signatures import (
    append_signature_table, append_signatures, compact_signature_table, compact_signatures, read_signature_table, read_signatures,
)
from pagesieve.streaming.first import first_seen, start_stateful
from pagesieve.streaming.pipeline import CurationJob

RECORD = {
    "url": "https://example.com", "headings": {"h1": ["Main"]}, "internal_links": ["/about"], "open_graph": {"og:title": "t"},
    "date_published": "2025-02-13T10:00:00Z", "visible_text": "text", "load_time": 15000000000, "is_secure": True,
}


def test_json_source(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RECORD) + "\n{broken\n")
    good, bad = split_undecodable(read_pages_json(spark, str(tmp_path)))
    row = good.first()
    assert good.columns == PAGE.fieldNames() and len(good.collect()) == 1
    assert (row.headings, row.load_time, row.is_secure, str(row.date_published)) == (
        {"h1": ["Main"]}, 15000000000, True, "2025-02-13 10:00:00",
    )
    assert [r._corrupt_record for r in bad.collect()] == ["{broken"]
    keyed = assign_arrival(good, prefix="a-")
    assert keyed.first().key == "a-0"
    keyed.drop("key", "ingest_order").write.parquet(str(tmp_path / "p"))
    assert read_pages_parquet(spark, str(tmp_path / "p")).first().url == "https://example.com"


def test_kafka_values(spark):
    rows = spark.createDataFrame(
        [("t", 0, 5, "2025-01-01 00:00:00", json.dumps(RECORD).encode()), ("t", 1, 6, "2025-01-01 00:00:01", b"{broken")],
        "topic string, partition int, offset long, timestamp string, value binary",
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    good, bad = split_undecodable(pages_from_kafka(rows))
    assert [r.key for r in good.collect()] == ["t-0-5"] and bad.count() == 1


def test_batches_align_by_position(spark):
    requests = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "d"]), (3, ["e"])], "batch int, keys array<string>")
    result = "array<struct<entities array<struct<text string, label string>>, keyphrases array<string>>>".replace(" array<", ": array<").replace("text string", "text: string").replace("label string", "label: string")
    responses = spark.createDataFrame(
        [(1, [([("x", "L")], ["k"]), ([], [])]), (2, [([], ["short"])])], f"batch int, results {result}"
    )
    aligned = align_batches(requests, responses)
    assert aligned.columns == ENRICHMENT.fieldNames()
    assert {r.key: (len(r.entities), r.keyphrases) for r in aligned.collect()} == {"a": (1, ["k"]), "b": (0, [])}


def test_signature_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert read_signatures(spark, path).count() == 0
    for batch, sigs in enumerate([["a", "b"], ["c"]]):
        append_signatures(spark.createDataFrame([(s, "k") for s in sigs], "sig string, key string"), path, batch)
    assert {r.sig for r in read_signatures(spark, path).collect()} == {"a", "b", "c"}
    assert {r.sig for r in read_signatures(spark, path, before=1).collect()} == {"a", "b"}
    append_signatures(spark.createDataFrame([("z", "k")], "sig string, key string"), path, 1)
    assert {r.sig for r in read_signatures(spark, path).collect()} == {"a", "b", "z"}


def test_compacted_store(spark, tmp_path):
    path, target = str(tmp_path / "store"), str(tmp_path / "compact")
    for batch, sigs in enumerate([["a", "b"], ["b", "c"], ["d"]]):
        append_signatures(spark.createDataFrame([(s, f"k{batch}") for s in sigs], "sig string, key string"), path, batch)
    compact_signatures(spark, path, target, before=2)
    rows = sorted(tuple(r) for r in read_signatures(spark, target).select("sig", "key", "batch_id").collect())
    assert rows == [("a", "k0", 1), ("b", "k0", 1), ("c", "k1", 1), ("d", "k2", 2)]


def test_compacted_table(spark):
    table = f"signatures_{uuid.uuid4().hex}"
    try:
        for batch, sigs in enumerate([["a", "b"], ["b", "c"], ["d"]]):
            append_signature_table(spark.createDataFrame([(s, f"k{batch}") for s in sigs], "sig string, key string"), table, batch, buckets=4)
        compact_signature_table(spark, table, f"{table}_2", before=2, buckets=4)
        rows = sorted(tuple(r) for r in read_signature_table(spark, f"{table}_2").select("sig", "key", "batch_id").collect())
        assert rows == [("a", "k0", 1), ("b", "k0", 1), ("c", "k1", 1), ("d", "k2", 2)]
    finally:
        for name in (table, f"{table}_2"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_bucketed_store_is_not_shuffled(spark, tmp_path):
    table = f"signatures_{uuid.uuid4().hex}"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    assert read_signature_table(spark, table).count() == 0
    for batch, sigs in [(0, ["a"]), (1, ["b", "c"]), (1, ["c"]), (0, ["a"])]:  # both batches are run again
        append_signature_table(spark.createDataFrame([(s, "k") for s in sigs], "sig string, key string"), table, batch, buckets=8)
    assert sorted((r.batch_id, r.sig) for r in read_signature_table(spark, table).collect()) == [(0, "a"), (1, "c")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        firsts = spark.createDataFrame([("a", 1), ("b", 2)], "sig string, n int").groupBy("sig").agg(F.min("n").alias("n"))
        left = firsts.join(read_signature_table(spark, table, before=1).select("sig"), "sig", "left_anti")
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert [r.sig for r in left.collect()] == ["b"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE IF EXISTS {table}")


@pytest.fixture(scope="module")
def job_parts(spark):
    sf_dir = "/root/testdata/sf0.001"
    return document_pages(spark, sf_dir), language_profile(spark, sf_dir), label_enrichment(spark, sf_dir)


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path, job_parts):
    pages, profile, enrichment = job_parts
    # three files in arrival order, one per micro-batch
    for i, (low, high) in enumerate([(0, 70), (70, 140), (140, 10_000)]):
        part = pages.where((F.col("ingest_order") >= low) & (F.col("ingest_order") < high)).coalesce(1)
        part.write.mode("append").json(str(tmp_path / "in"))
    job = CurationJob(str(tmp_path / "out"), DICTIONARY, profile, enrichment, OPTIONS)
    query = job.start(stream_pages_json(spark, str(tmp_path / "in"), OPTIONS, max_files_per_trigger=1), every=None)
    query.awaitTermination()
    batch = curate(pages, DICTIONARY, profile, None, enrichment, OPTIONS)

    def view():
        documents = spark.read.parquet(f"{job.root}/documents")
        signatures = SignatureStore(spark, f"{job.root}/signatures").read()
        return (
            sorted(r.key for r in documents.select("key").collect()),
            sorted((r.key, r.outcome) for r in rejected_table(spark, f"{job.root}/rejected").collect()),
            sorted((r.sig, r.key) for r in signatures.collect()),
            sorted((r._id, r.key) for r in latest_documents(spark, f"{job.root}/documents", OPTIONS).collect()),
            sorted((r._id, r.key) for r in current_documents(spark, job.root).collect()),
        )

    counted = committed_counters(spark, job.root)
    outcomes = [r.outcome for r in batch.decisions.collect()]
    total = counted.agg(*[F.sum(c).alias(c) for c in counted.columns if c != "batch_id"]).first()
    assert (total.pages_processed, total.duplicates, total.invalid_urls) == tuple(map(outcomes.count, ("indexed", "duplicate", "invalid_url")))
    assert total.claims == batch.new_signatures.count()
    shapes = [r["shape"] for r in batch.documents.select("shape").collect()]
    assert (total.nlp_requests, total.nlp_errors) == (len(shapes) - shapes.count("empty_text"), shapes.count("nlp_failed"))
    scored = committed_spam_scores(spark, job.root).groupBy("bound").agg(F.sum("pages").alias("pages"), F.sum("score_sum").alias("sum"))
    direct = spam_histogram(batch.decisions.where("outcome = 'indexed'"), "spam")
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, direct.select("bound", "pages", "score_sum").collect()))
    files = list((tmp_path / "out" / "bulk").glob("batch_id=*/part-*"))
    lines = sum(len(f.read_text().splitlines()) for f in files)
    assert (total.bulk_bytes, total.documents, total.bulk_files) == (sum(f.stat().st_size for f in files), lines // 2, len(files))
    assert not list((tmp_path / "out" / "scratch").glob("*"))  # what batches work with goes when they are committed

    streamed = view()
    assert [(r.first, r.last) for r in sorted(SignatureStore(spark, f"{job.root}/signatures").runs())] == [(0, 0), (1, 1), (2, 2)]
    assert streamed[3] == streamed[4]
    assert streamed[0] == sorted(r.key for r in batch.documents.collect())
    assert streamed[1] == sorted((r.key, r.outcome) for r in batch.rejected.collect())
    assert streamed[2] == sorted((r.sig, r.key) for r in batch.new_signatures.collect())
    job.run_batch(pages.where((F.col("ingest_order") >= 70) & (F.col("ingest_order") < 140)), 1)
    assert view() == streamed


def test_a_job_keeps_its_signatures_in_a_bucketed_table(spark, tmp_path, job_parts):
    pages, profile, enrichment = job_parts
    table = f"signatures_{uuid.uuid4().hex}"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    try:
        job = CurationJob(
            str(tmp_path / "out"), {}, profile, enrichment, OPTIONS, signature_table=table, signature_buckets=8
        )
        halves = [pages.where("ingest_order < 100"), pages.where("ingest_order >= 100")]
        for batch in (0, 1, 0):
            job.run_batch(halves[batch], batch)
        expected = curate(pages, {}, profile, None, enrichment, OPTIONS).new_signatures
        kept = spark.table(table).select("sig", "key").collect()
        assert sorted(map(tuple, kept)) == sorted((r.sig, r.key) for r in expected.collect())
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_stateful_first_seen(spark, tmp_path):
    records = [{**RECORD, "key": str(i), "ingest_order": i, "visible_text": text} for i, text in enumerate(["a", "b", " a", "c", "b"])]
    (tmp_path / "in").mkdir()
    for i, record in enumerate(records):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(record) + "\n")
    stream = first_seen(stream_pages_json(spark, str(tmp_path / "in"), max_files_per_trigger=2))
    writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True)
    start_stateful(spark, writer, str(tmp_path / "out")).awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["0", "1", "3"]


def test_records_without_key_or_order_are_indexed_and_counted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spaces = {**RECORD, "url": "https://example.com/blank", "visible_text": "   "}
    relative = {**RECORD, "url": "/rel", "visible_text": "claimed by nobody"}
    records = [RECORD, {**RECORD, "url": "https://example.com/2", "visible_text": "another text"}, spaces, relative]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, records)))
    job = CurationJob(str(tmp_path / "out"), {}, language_profile(spark, "/root/testdata/sf0.001"), spark.createDataFrame([], ENRICHMENT), OPTIONS)
    job.start(stream_pages_json(spark, str(tmp_path / "in"), OPTIONS), every=None).awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out/documents")).collect()
    assert {r.url for r in written} >= {"https://example.com", "https://example.com/2"} and len({r.key for r in written}) == len(written) == 3
    rejected = spark.read.parquet(str(tmp_path / "out/rejected")).collect()
    assert [(r.url, r.outcome) for r in rejected] == [("/rel", "invalid_url")]


def test_a_null_key_has_its_own_outcome(spark):
    pages = document_pages(spark, "/root/testdata/sf0.001").where("key IN (1, 2, 3)").withColumn("key", F.when(F.col("key") != "1", F.col("key")))
    outcomes = {r.key: r.outcome for r in curate(pages, {}, language_profile(spark, "/root/testdata/sf0.001")).decisions.collect()}
    assert outcomes[None] == "unkeyed" and "unkeyed" not in {v for k, v in outcomes.items() if k is not None}


def test_a_dictionary_table_scores_like_literals(spark):
    pages, profile = document_pages(spark, "/root/testdata/sf0.001"), language_profile(spark, "/root/testdata/sf0.001")
    words = {"the": 1, "tion": 3, "of the": 2}
    tables = [curate(pages, d, profile).decisions.select("key", "spam") for d in (words, dictionary_table(spark, words))]
    assert tables[0].exceptAll(tables[1]).isEmpty() and tables[1].exceptAll(tables[0]).isEmpty()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_folder(Session())
