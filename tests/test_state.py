"""What a stream keeps: signatures behind filters, current documents, commits, first pages, bulk bodies, late results, count tables."""

import json
import time

import pytest
from pyspark.sql import functions as F

from pagesieve.operators import counts
from pagesieve.operators.keyphrases import train_word_frequencies
from pagesieve.operators.language import count_trigrams, profile_from_counts, train_language_profile
from pagesieve.plans import curate as plans
from pagesieve.plans.curate import curate
from pagesieve.registry.params import OPTIONS, STOP_WORDS
from pagesieve.registry.queries import document_pages, label_enrichment, language_profile
from pagesieve.schemas import ENRICHMENT, Options
from pagesieve.sinks import current
from pagesieve.sources import membership
from pagesieve.sources.membership import SignatureStore
from pagesieve.sources.pages import stream_pages_json
from pagesieve.streaming import pipeline
from pagesieve.streaming.enrich import enrich_in_time
from pagesieve.streaming.first import first_seen, start_stateful
from pagesieve.streaming.flush import bulk_bodies

SF = "/root/testdata/sf0.001"


def signed(spark, numbers, key="k"):
    return spark.createDataFrame([(f"sig-{i}", f"{key}{i}") for i in numbers], "sig string, key string")


# --- signatures ----------------------------------------------------------------------------------------------------


def test_filters_pass_all_that_is_held_and_little_else(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(membership, "BUCKET_ROWS", 400)
    store = SignatureStore(spark, str(tmp_path / "s"))
    store.append(signed(spark, range(3000)), 0)
    store.append(signed(spark, range(3000, 3100)), 1)
    assert sorted((r.run, r.buckets) for r in store.runs()) == [("0-0", 8), ("1-1", 1)]
    asked = spark.range(0, 13_000).select(F.concat(F.lit("sig-"), F.col("id").cast("string")).alias("sig"))
    passed = store.candidates(asked).select("sig").distinct()
    assert store.held(asked).count() == 3100 <= passed.count() <= 3100 + 0.02 * 2 * 10_000
    assert {r.sig for r in store.held(asked, before=1).collect()} == {f"sig-{i}" for i in range(3000)}
    assert store.held(signed(spark, [99_999]).limit(0)).count() == 0


def test_only_buckets_that_may_hold_a_signature_are_read(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(membership, "BUCKET_ROWS", 100)
    store = SignatureStore(spark, str(tmp_path / "s"))
    for batch in range(3):
        store.append(signed(spark, range(batch * 1000, batch * 1000 + 1000)), batch)
    asked = signed(spark, [5, 2007])
    places = {(r.run, r.bucket) for r in store.candidates(asked).collect()}
    assert len(places) <= 3  # of 3 runs with 16 buckets each
    assert {r.sig for r in store.held(asked).collect()} == {"sig-5", "sig-2007"}
    read = {tuple(f.split("/")[-3:-1]) for f in store.held(asked).inputFiles() if "/data/run=" in f}
    assert read == {(f"run={run}", f"bucket={bucket}") for run, bucket in places}


def test_compaction_keeps_the_first_claim_and_replays_replace(spark, tmp_path):
    store = SignatureStore(spark, str(tmp_path / "s"))
    assert store.runs() == [] and store.read().count() == 0 and store.held(signed(spark, [1])).count() == 0
    for batch, numbers in [(0, [1, 2]), (1, [2, 3]), (1, [2, 4]), (2, [5])]:
        store.append(signed(spark, numbers, f"b{batch}-"), batch)
    store.compact(before=2)
    assert sorted((r.first, r.last) for r in store.runs()) == [(0, 1), (2, 2)]
    rows = sorted(tuple(r) for r in store.read().collect())
    assert rows == [("sig-1", "b0-1", 0), ("sig-2", "b0-2", 0), ("sig-4", "b1-4", 1), ("sig-5", "b2-5", 2)]
    assert {r.sig for r in store.held(signed(spark, range(9))).collect()} == {"sig-1", "sig-2", "sig-4", "sig-5"}
    assert [r.run for r in store.runs(before=2)] == ["0-1"]
    store.compact(before=2)  # nothing left to merge
    assert sorted((r.first, r.last) for r in store.runs()) == [(0, 1), (2, 2)]
    store.append(signed(spark, [], "b3-"), 3)
    assert store.read().count() == 4


# --- current documents and commits ---------------------------------------------------------------------------------


def documents(spark, rows):
    return spark.createDataFrame([(i, k, o, f"{i}-{k}") for i, k, o in rows], "_id string, key string, ingest_order long, title string")


def upsert(spark, root, batch, rows, buckets=16):
    versions = current.upsert_current(documents(spark, rows), root, batch, buckets)
    current.commit(spark, root, batch, versions, {"n": len(rows)})
    return versions


def state(spark, root):
    return {r._id: (r.key, r.version) for r in current.current_documents(spark, root).collect()}


def test_current_documents_are_replaced_in_place(spark, tmp_path):
    root = str(tmp_path)
    assert current.current_documents(spark, root) is None and current.committed_counters(spark, root) is None
    first = upsert(spark, root, 0, [(f"d{i}", f"a{i}", i) for i in range(60)])
    second = upsert(spark, root, 1, [("d1", "b1", 70), ("d1", "b0", 65), ("new", "b2", 71)])
    changed = [b for b in range(16) if first[b] != second[b]]
    assert 1 <= len(changed) <= 2 and all(second[b] == 1 for b in changed)
    expected = {f"d{i}": (f"a{i}", 0) for i in range(60)} | {"d1": ("b1", 1), "new": ("b2", 1)}
    assert state(spark, root) == expected
    read = {f.split("/")[-2] for f in current.current_documents(spark, root).inputFiles()}
    assert len(read) == len(current.current_documents(spark, root).inputFiles())  # one file a bucket, none of replaced versions
    assert upsert(spark, root, 1, [("d1", "b1", 70), ("d1", "b0", 65), ("new", "b2", 71)]) == second  # run again
    assert state(spark, root) == expected
    upsert(spark, root, 2, [])
    assert state(spark, root) == expected
    assert sorted(map(tuple, current.committed_counters(spark, root).collect())) == [(0, 60), (1, 3), (2, 0)]


def test_a_merge_reads_only_the_buckets_it_touches(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    upsert(spark, root, 0, [(f"d{i}", f"a{i}", i) for i in range(200)])
    asked = []
    whole = current._paths
    monkeypatch.setattr(current, "_paths", lambda *a: asked.append(whole(*a)) or asked[-1])
    upsert(spark, root, 1, [("d7", "b", 300)])
    assert len(asked[0]) == 1


@pytest.fixture(scope="module")
def parts(spark):
    return document_pages(spark, SF), language_profile(spark, SF), label_enrichment(spark, SF)


def test_a_batch_that_dies_between_its_outputs_is_invisible_until_it_is_run_again(spark, tmp_path, parts, monkeypatch):
    pages, profile, enrichment = parts
    job = pipeline.CurationJob(str(tmp_path / "out"), {}, profile, enrichment, OPTIONS)
    halves = [pages.where("ingest_order < 100"), pages.where("ingest_order >= 100")]
    job.run_batch(halves[0], 0)

    def seen():
        return [sorted((r._id, r.key) for r in df.collect()) for df in (current.read_committed(spark, job.root, "documents"), current.current_documents(spark, job.root))]

    before = seen()
    with monkeypatch.context() as patch:
        patch.setattr(pipeline, "write_bulk", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            job.run_batch(halves[1], 1)
    assert spark.read.parquet(f"{job.root}/documents").where("batch_id = 1").count() > 0
    assert seen() == before
    job.run_batch(halves[1], 1)
    whole = curate(pages, {}, profile, None, enrichment, OPTIONS).documents
    assert seen()[0] == sorted((r._id, r.key) for r in whole.collect())


def test_counters_take_no_reading_of_their_own(spark, tmp_path, parts, monkeypatch):
    from pagesieve.operators import metrics

    pages, profile, enrichment = parts
    for name in ("run_counters", "spam_histogram", "enrichment_counters", "sink_counters", "bulk_counters"):
        monkeypatch.setattr(metrics, name, lambda *a, **k: 1 / 0)
    job = pipeline.CurationJob(str(tmp_path / "out"), {}, profile, enrichment, OPTIONS)
    job.run_batch(pages, 0)
    row = current.committed_counters(spark, job.root).first()
    assert row.pages_processed == row.documents + row.pages_processed - current.current_documents(spark, job.root).count() > 0


def test_keyphrases_are_not_derived_from_a_batch_alone(spark, tmp_path, parts):
    pages, profile, _ = parts
    with pytest.raises(ValueError, match="frequencies"):
        pipeline.CurationJob(str(tmp_path), {}, profile)
    frequencies = train_word_frequencies(pages, stop_words=STOP_WORDS)
    job = pipeline.CurationJob(str(tmp_path / "out"), {}, profile, options=OPTIONS, frequencies=frequencies, stop_words=STOP_WORDS)
    for batch, half in enumerate([pages.where("ingest_order < 100"), pages.where("ingest_order >= 100")]):
        job.run_batch(half, batch)
    derive = lambda accepted: plans.derive_enrichment(accepted, OPTIONS, None, STOP_WORDS, frequencies)
    whole = curate(pages, {}, profile, None, derive, OPTIONS).documents
    assert sorted((r.key, r.keywords) for r in spark.read.parquet(f"{job.root}/documents").collect()) == sorted((r.key, r.keywords) for r in whole.collect())


# --- plans ---------------------------------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_decisions_go_to_the_pages_and_no_page_moves(spark, parts):
    pages, profile, enrichment = parts
    run = curate(pages, {}, profile, None, enrichment, OPTIONS, materialize=True)
    moved = [line for line in plan_of(run.documents).splitlines() if "Exchange hashpartitioning(ingest_order" in line]
    assert moved == [] and "BroadcastHashJoin [ingest_order" in plan_of(run.documents)


def test_pages_rejected_by_their_own_row_are_not_shuffled(spark, parts):
    pages, profile, _ = parts
    narrow = spark.createDataFrame([(1, "1")], "ingest_order long, key string")
    joined = plans.with_page_columns(pages, narrow, OPTIONS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan_of(plans.with_page_columns(pages, narrow, OPTIONS)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchange = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(ingest_order" in line)
    assert any("Filter" in line for line in lines[exchange:]) and joined.count() == 1


def test_invalid_pages_are_given_no_language(spark, parts):
    pages, profile, _ = parts
    rows = plans.decide(pages, {}, profile, None, OPTIONS).where("outcome = 'invalid_url'").select("lang", "en_conf").distinct().collect()
    assert [tuple(r) for r in rows] == [("unknown", None)]


# --- stateful streams ----------------------------------------------------------------------------------------------


def record(key, order, text, url="https://example.com"):
    return {"key": key, "ingest_order": order, "visible_text": text, "url": url}


def write(folder, number, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{number:03d}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    time.sleep(0.02)  # files are taken in the order of their times


def test_the_first_page_of_a_batch_wins_and_later_batches_lose(spark, tmp_path):
    write(tmp_path / "in", 0, [record("c", 5, "x"), record("b", 3, "x"), record("a", 3, "x"), record("d", 1, "y", "/invalid"), record(None, 0, "y")])
    write(tmp_path / "in", 1, [record("e", 1, "x"), record("f", 9, "y"), record("g", 8, "y")])
    write(tmp_path / "in", 2, [record(f"h{i}", 100 - i, "hot") for i in range(50)])
    stream = first_seen(stream_pages_json(spark, str(tmp_path / "in"), max_files_per_trigger=1))
    writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    start_stateful(spark, writer, str(tmp_path / "out")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.key, r.ingest_order) for r in found) == [("a", 3), ("g", 8), ("h49", 51)]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_a_signature_meets_the_state_once_a_micro_batch(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    from pagesieve.streaming import first

    rows = [("x", 3, "b"), ("y", 2, "q"), ("x", 3, "a"), ("x", 9, "c"), ("y", 1, "z"), ("z", 5, "k")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("sig", "o", "k"), r))]) for r in rows]
    for merged in (1, 2, 100):
        monkeypatch.setattr(first, "MERGED_ROWS", merged)
        found = [r for b in first._least_of_part(["o", "k"])(iter(batches)) for r in b.to_pylist()]
        assert sorted((r["sig"], r["o"], r["k"]) for r in found) == [("x", 3, "a"), ("y", 1, "z"), ("z", 5, "k")]
    assert list(first._least_of_part(["o", "k"])(iter([]))) == []
    (tmp_path / "in").mkdir()
    stream = first_seen(stream_pages_json(spark, str(tmp_path / "in"), max_files_per_trigger=1))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "TransformWithState" not in plan


def test_orders_may_be_structures_with_times(spark, tmp_path):
    schema = "key string, ingest_order struct<t: timestamp, part: int>, visible_text string, url string"
    rows = [("a", "2025-01-01 00:00:02", 0), ("b", "2025-01-01 00:00:01", 7), ("c", "2025-01-01 00:00:01", 3)]
    df = spark.createDataFrame(rows, "key string, t string, part int").select(
        "key", F.struct(F.col("t").cast("timestamp").alias("t"), "part").alias("ingest_order"), F.lit("x").alias("visible_text"), F.lit("https://a.b").alias("url")
    )
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = first_seen(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    start_stateful(spark, writer, str(tmp_path / "out")).awaitTermination()
    (row,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert row.key == "c" and row.ingest_order.part == 3 and str(row.ingest_order.t) == "2025-01-01 00:00:01"


def test_bulk_bodies_go_out_at_a_number_or_after_a_time(spark, tmp_path, parts):
    pages, profile, enrichment = parts
    curate(pages, {}, profile, None, enrichment, OPTIONS).documents.where("ingest_order < 30").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    n = docs.count()
    assert n >= 10
    keys = [r.key for r in docs.orderBy("ingest_order").collect()]
    (tmp_path / "in").mkdir()
    first, second = keys[:7], keys[7:8]
    for number, part in enumerate((first, second)):
        docs.where(F.col("key").isin(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    bodies = bulk_bodies(stream, most=3, seconds=4, shards=1, options=OPTIONS)
    writer = bodies.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second")
    query = start_stateful(spark, writer, str(tmp_path / "out"))
    try:
        found, until = [], time.time() + 60
        while time.time() < until and sum(r.documents for r in found) < 8:
            time.sleep(1)
            found = spark.read.schema(bodies.schema).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
    finally:
        query.stop()
    by_number = sorted(found, key=lambda r: r.number)
    assert [(r.number, r.documents, r.reason) for r in by_number] == [(0, 3, "count"), (1, 3, "count"), (2, 2, "time")]
    ids = [json.loads(line)["index"]["_id"] for r in by_number for line in r.body.splitlines()[::2]]
    assert ids == [r._id for r in docs.where(F.col("key").isin(keys[:8])).orderBy("ingest_order").collect()]


def test_results_that_are_late_or_missing_give_the_failed_shape(spark, tmp_path):
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    pages = spark.createDataFrame([("a", 0, True), ("b", 1, True), ("c", 2, True), ("d", 3, False), ("e", 4, True), ("end", 10_000, True)], "key string, s int, has_text boolean")
    pages = pages.select("key", at(F.col("s")).alias("arrived"), "has_text")
    results = spark.createDataFrame([("a", 10), ("b", 12), ("d", 4), ("e", 4), ("other", 10_000)], "key string, s int").select(
        "key", F.array().cast(ENRICHMENT["entities"].dataType).alias("entities"), F.array(F.lit("x")).alias("keyphrases"), at(F.col("s")).alias("answered")
    )
    pages.coalesce(1).write.parquet(str(tmp_path / "p"))
    results.coalesce(1).write.parquet(str(tmp_path / "r"))
    streams = [spark.readStream.schema(df.schema).parquet(str(tmp_path / name)) for df, name in ((pages, "p"), (results, "r"))]
    met = enrich_in_time(*streams, Options())
    writer = met.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    start_stateful(spark, writer, str(tmp_path / "out")).awaitTermination()
    found = {r.key: (r["shape"], r.keyphrases) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {"a": ("full", ["x"]), "b": ("nlp_failed", None), "c": ("nlp_failed", None), "d": ("empty_text", None), "e": ("full", ["x"])}


# --- models that grow ----------------------------------------------------------------------------------------------


def test_models_by_batch_equal_models_trained_at_once(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    halves = [docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")]
    assert counts.read_counts(spark, str(tmp_path / "none"), counts.WORDS) is None
    for batch in (0, 1, 0):  # one is run again
        counts.append_counts(count_trigrams(halves[batch]), str(tmp_path / "t"), batch)
        counts.append_counts(train_word_frequencies(halves[batch], "text"), str(tmp_path / "w"), batch)
    grown = profile_from_counts(counts.read_counts(spark, str(tmp_path / "t"), counts.TRIGRAMS))
    once = train_language_profile(docs)
    rounded = [sorted((r.lang, r.gram, round(r.logp, 9)) for r in df.collect()) for df in (grown, once)]
    assert rounded[0] == rounded[1]
    words = [sorted(map(tuple, df.collect())) for df in (counts.read_counts(spark, str(tmp_path / "w"), counts.WORDS), train_word_frequencies(docs, "text"))]
    assert words[0] == words[1]
    counts.compact_counts(spark, str(tmp_path / "w"), str(tmp_path / "w2"), counts.WORDS, before=1)
    assert sorted(map(tuple, counts.read_counts(spark, str(tmp_path / "w2"), counts.WORDS).collect())) == words[0]


def test_unkeyed_pages_are_counted_as_such_only(spark, parts):
    from pagesieve.operators.metrics import run_counters

    pages, profile, _ = parts
    rows = plans.decide(pages.withColumn("key", F.when(F.col("ingest_order") % 2 == 0, F.col("key"))), {}, profile, None, OPTIONS)
    row, outcomes = run_counters(rows, OPTIONS).first(), [r.outcome for r in rows.collect()]
    assert row.unkeyed == outcomes.count("unkeyed") > 50
    assert row.detection_failures == 0  # none of them counts as a failed detection
