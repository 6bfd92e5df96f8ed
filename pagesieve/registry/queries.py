"""One query per operator, over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.functions.quality import penalized_quality, quality_score
from pagesieve.functions.text import byte_length, clean_text, content_signature, load_time_ms
from pagesieve.functions.urls import doc_id, normalize_links, normalize_url
from pagesieve.operators.dedup import mark_duplicates, seen_signatures, survivors, first_per_signature
from pagesieve.operators.document import attach_enrichment, canonical_or_raw
from pagesieve.operators.entities import extract_entities, format_entities
from pagesieve.operators.keyphrases import extract_keyphrases, train_word_frequencies
from pagesieve.operators import counts, entities, language
from pagesieve.operators.language import (
    count_trigrams, detect_language, gate_language, is_rejected_language, profile_from_counts, train_language_profile,
)
from pagesieve.operators.metrics import (
    enrichment_counters, outcome_counts, run_counters, sink_counters, spam_histogram,
)
from pagesieve.operators.phrases import dictionary_matches
from pagesieve.operators.spam import is_high_spam, matched_phrases, spam_raw, spam_score, spam_scores_by_join
from pagesieve.operators.upsert import id_collisions, latest_per_id
from pagesieve.plans.curate import Curated, curate, decide, derive_enrichment
from pagesieve.registry.params import CRAWLED_AT, DICTIONARY, OPTIONS, STOP_WORDS
from pagesieve.schemas import ENTITIES
from pagesieve.session import cut_lineage, shared_folder
from pagesieve.sinks.bulk import bulk_lines
from pagesieve.sinks.current import committed_counters, current_documents, read_committed
from pagesieve.sources.adapters import pages_from_documents, pages_from_html
from pagesieve.sources.dictionary import EXPLICIT_WEIGHTS, dictionary_table, read_dictionary
from pagesieve.sources.enrichment import align_batches
from pagesieve.sources.pages import CORRUPT, read_pages_json, split_undecodable, stream_pages_json
from pagesieve.streaming.enrich import enrich_in_time
from pagesieve.streaming.first import first_seen, start_stateful
from pagesieve.streaming.pipeline import CurationJob

KEYS = ["ingest_order", "key"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when a table has fewer splits than there are cores, as one small file does.

    A split is at most ``spark.sql.files.maxPartitionBytes``, so less than that per core is moved, and text work per byte
    costs far more than moving it. A table with more splits is left where it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_from_documents(spread(read_table(spark, sf_dir, "documents")))


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_from_html(spread(read_table(spark, sf_dir, "pages")))


def language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_language_profile(spread(read_table(spark, sf_dir, "documents")))


def earlier_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signature store for the queries: what an earlier crawl of the documents labelled toxic would have left."""
    earlier = read_table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("key"))
    signed = document_pages(spark, sf_dir).select("key", content_signature("visible_text").alias("sig"))
    return signed.join(earlier, "key", "left_semi").select("sig", "key")


def label_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished enrichment table for the queries: one row per labelled document, so that the others count as failed."""
    good, quality = F.col("quality") == 1, F.col("quality").cast("string")
    mark = F.array(F.struct(quality.alias("text"), F.lit("QUALITY").alias("label")))
    return read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("key"),
        F.when(good, mark).otherwise(F.array().cast(ENTITIES)).alias("entities"),
        F.when(good, F.array(*[F.concat(F.lit(w), quality) for w in "abcd"])).otherwise(F.array(F.lit("low"))).alias(
            "keyphrases"
        ),
    )


def host_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for entity extraction: the site names of ``pages``."""
    name = F.regexp_extract("url", r"([a-z0-9\-]+)\.example\.", 1)
    return read_table(spark, sf_dir, "pages").select(name.alias("name"), F.lit("ORG").alias("label")).where("name <> ''")


def run(spark: SparkSession, sf_dir: str) -> Curated:
    """The whole pipeline with a signature store and a finished enrichment table."""
    return curate(
        document_pages(spark, sf_dir),
        DICTIONARY,
        language_profile(spark, sf_dir),
        earlier_signatures(spark, sf_dir),
        label_enrichment(spark, sf_dir),
        OPTIONS,
        F.lit(f"{CRAWLED_AT}Z").cast("timestamp"),
    )


def flat(documents: DataFrame) -> DataFrame:
    """Documents with arrays, structs and times as strings, to be compared across engines."""

    def one(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            value = F.array_join(value, " | ")
        elif isinstance(field.dataType, T.StructType):
            value = F.concat_ws(" | ", *[value[name] for name in field.dataType.fieldNames()])
        elif isinstance(field.dataType, T.TimestampType):
            value = F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
        return value.alias(field.name)

    return documents.select(*[one(field) for field in documents.schema.fields])


# --- text and URLs -------------------------------------------------------------------------------------------------


def q_clean_text(spark, sf_dir):
    texts = document_pages(spark, sf_dir).unionByName(html_pages(spark, sf_dir).withColumn("key", F.concat(F.lit("p"), "key")))
    return texts.select("key", clean_text("visible_text").alias("cleaned"), byte_length("visible_text").alias("n_bytes"))


def q_content_signature(spark, sf_dir):
    return document_pages(spark, sf_dir).select("key", content_signature("visible_text").alias("sig"))


def q_normalize_url(spark, sf_dir):
    raw = document_pages(spark, sf_dir).select("key", "url", "canonical_url").unionByName(
        html_pages(spark, sf_dir).select(F.concat(F.lit("p"), "key").alias("key"), "url", F.lit("").alias("canonical_url"))
    )
    return raw.select("key", normalize_url("url").alias("norm_url"), canonical_or_raw("canonical_url").alias("canonical"))


def q_normalize_links(spark, sf_dir):
    links = normalize_links("internal_links")
    return html_pages(spark, sf_dir).select("key", F.array_join(links, " | ").alias("links"), F.coalesce(F.size(links), F.lit(0)).alias("n_links"))


def q_doc_id(spark, sf_dir):
    return document_pages(spark, sf_dir).select(
        "key", doc_id("url", "canonical_url").alias("raw_id"),
        doc_id(F.coalesce(normalize_url("url"), "url"), canonical_or_raw("canonical_url")).alias("id"),
        load_time_ms("load_time").alias("load_ms"),
    )


# --- de-duplication ------------------------------------------------------------------------------------------------


def _signed(spark, sf_dir):
    return document_pages(spark, sf_dir).select(*KEYS, content_signature("visible_text").alias("sig"))


def q_dedup_first_wins(spark, sf_dir):
    return mark_duplicates(_signed(spark, sf_dir)).select("key", "sig", "is_duplicate")


def q_dedup_against_store(spark, sf_dir):
    return survivors(_signed(spark, sf_dir), earlier_signatures(spark, sf_dir)).select("key", "sig")


def q_dedup_seen_before(spark, sf_dir):
    firsts = first_per_signature(_signed(spark, sf_dir))
    return seen_signatures(firsts, earlier_signatures(spark, sf_dir)).select("key", "sig")


# --- spam ----------------------------------------------------------------------------------------------------------


def q_spam_score(spark, sf_dir):
    return document_pages(spark, sf_dir).select(
        "key", spam_raw("visible_text", DICTIONARY).alias("raw"), spam_score("visible_text", DICTIONARY).alias("spam_score")
    )


def q_spam_score_join(spark, sf_dir):
    return spam_scores_by_join(document_pages(spark, sf_dir), dictionary_table(spark, DICTIONARY))


def q_spam_phrases(spark, sf_dir):
    pages = document_pages(spark, sf_dir)
    return pages.select("key", F.explode(matched_phrases("visible_text", DICTIONARY)).alias("phrase"))


def q_dictionary_matches(spark, sf_dir):
    matches = dictionary_matches(document_pages(spark, sf_dir), dictionary_table(spark, DICTIONARY))
    return matches.groupBy("phrase", "weight").agg(F.count("*").alias("pages"))


def q_spam_gate(spark, sf_dir):
    scored = document_pages(spark, sf_dir).select("key", "visible_text", spam_score("visible_text", DICTIONARY).alias("spam_score"))
    blocked = is_high_spam("visible_text", "spam_score", OPTIONS.spam_threshold)
    return scored.select("key", "spam_score", blocked.alias("is_high_spam"))


def q_spam_histogram(spark, sf_dir):
    scored = document_pages(spark, sf_dir).select("visible_text", spam_score("visible_text", DICTIONARY).alias("spam_score"))
    # blocked pages get no score instead of being filtered: a pushed-down filter would score every text twice
    passed = scored.select(
        F.when(~is_high_spam("visible_text", "spam_score", OPTIONS.spam_threshold), F.col("spam_score")).alias("spam_score")
    )
    bound = F.when(F.col("bound") == float("inf"), "+Inf").otherwise(F.col("bound").cast("int").cast("string"))
    return spam_histogram(passed).withColumn("bound", bound)


# --- language ------------------------------------------------------------------------------------------------------


def q_language_profile(spark, sf_dir):
    return language_profile(spark, sf_dir).withColumn("logp", F.round("logp", 6))


def _detected(spark, sf_dir):
    pages = document_pages(spark, sf_dir)
    scores = detect_language(pages, language_profile(spark, sf_dir), KEYS)
    return pages.select(*KEYS, byte_length("visible_text").alias("n_bytes")).join(scores, KEYS, "left")


def q_language_detect(spark, sf_dir):
    return _detected(spark, sf_dir).select("key", "detected", F.round("en_conf", 6).alias("en_conf"))


def q_language_gate(spark, sf_dir):
    gated = _detected(spark, sf_dir).withColumn("lang", gate_language("detected", "n_bytes"))
    return gated.select("key", "lang", is_rejected_language("lang", "en_conf").alias("rejected"))


# --- enrichment ----------------------------------------------------------------------------------------------------


def q_entities(spark, sf_dir):
    found = extract_entities(document_pages(spark, sf_dir), host_gazetteer(spark, sf_dir))
    return found.select("key", F.array_join(format_entities("entities"), " | ").alias("entities"))


def q_keyphrase_relevance(spark, sf_dir):
    """The ten most relevant candidates of every page: no diversity asked for."""
    found = extract_keyphrases(document_pages(spark, sf_dir), replace(OPTIONS, diversity=0.0), stop_words=STOP_WORDS)
    return found.select("key", F.posexplode("keyphrases").alias("rank", "phrase"))


def q_word_frequencies(spark, sf_dir):
    return train_word_frequencies(document_pages(spark, sf_dir), stop_words=STOP_WORDS)


def q_keyphrases(spark, sf_dir):
    found = extract_keyphrases(document_pages(spark, sf_dir), stop_words=STOP_WORDS)
    return found.select("key", F.array_join("keyphrases", " | ").alias("keyphrases"))


def q_enrichment_join(spark, sf_dir):
    return attach_enrichment(document_pages(spark, sf_dir), label_enrichment(spark, sf_dir)).select(
        "key", "shape", F.array_join(format_entities("entities"), " | ").alias("entities"), F.array_join("keyphrases", " | ").alias("keyphrases")
    )


def q_batch_results(spark, sf_dir):
    """Results answered in batches of two documents; a batch with an unlabelled document has too few and fails whole."""
    batch = F.floor(F.col("key").cast("long") / 2).alias("batch")
    in_order = F.array_sort(F.collect_list(F.struct(F.col("key").cast("long").alias("i"), "row"))).alias("rows")

    def batched(df: DataFrame, row: Column, name: str) -> DataFrame:
        grouped = df.select(batch, "key", row.alias("row")).groupBy("batch").agg(in_order)
        return grouped.select("batch", F.transform("rows", lambda r: r["row"]).alias(name))

    requests = batched(document_pages(spark, sf_dir), F.col("key"), "keys")
    responses = batched(label_enrichment(spark, sf_dir), F.struct("entities", "keyphrases"), "results")
    return align_batches(requests, responses).select(
        "key", F.array_join(format_entities("entities"), " | ").alias("entities"), F.array_join("keyphrases", " | ").alias("keyphrases")
    )


def q_enrichment_counters(spark, sf_dir):
    return enrichment_counters(attach_enrichment(document_pages(spark, sf_dir), label_enrichment(spark, sf_dir)))


def q_quality_score(spark, sf_dir):
    pages = attach_enrichment(document_pages(spark, sf_dir), label_enrichment(spark, sf_dir))
    scored = pages.select(
        "key",
        quality_score(
            "visible_text", "title", "meta_description", "entities", "keyphrases", normalize_links("internal_links"),
            normalize_links("external_links"), "language", "is_secure", load_time_ms("load_time"),
        ).alias("quality"),
        spam_score("visible_text", DICTIONARY).alias("spam"),
    )
    return scored.select("key", "quality", penalized_quality("quality", "spam").alias("penalized"))


# --- the pipeline --------------------------------------------------------------------------------------------------


def q_decisions(spark, sf_dir):
    return run(spark, sf_dir).decisions.select("key", "outcome", "claims", "lang", "spam", "norm_url")


def q_rejected(spark, sf_dir):
    return run(spark, sf_dir).rejected


def q_new_signatures(spark, sf_dir):
    return run(spark, sf_dir).new_signatures


def q_outcome_counts(spark, sf_dir):
    return outcome_counts(run(spark, sf_dir).decisions)


def q_run_counters(spark, sf_dir):
    return run_counters(run(spark, sf_dir).decisions, OPTIONS)


def q_documents(spark, sf_dir):
    return flat(run(spark, sf_dir).documents.drop("ingest_order"))


def q_upsert_latest(spark, sf_dir):
    latest = latest_per_id(run(spark, sf_dir).documents, OPTIONS)
    return latest.select("_id", "key", "url", "title", "quality_score", "spam_score")


def q_id_collisions(spark, sf_dir):
    return id_collisions(run(spark, sf_dir).documents)


def q_bulk_ndjson(spark, sf_dir):
    return bulk_lines(run(spark, sf_dir).documents, OPTIONS)


def q_curate_derived(spark, sf_dir):
    """The whole pipeline with entities and keyphrases derived from the accepted texts: the flagship."""
    curated = curate(
        document_pages(spark, sf_dir),
        DICTIONARY,
        language_profile(spark, sf_dir),
        None,
        lambda accepted: derive_enrichment(accepted, OPTIONS, host_gazetteer(spark, sf_dir), STOP_WORDS),
        OPTIONS,
        F.lit(f"{CRAWLED_AT}Z").cast("timestamp"),
        materialize=True,
    )
    return flat(curated.documents.drop("ingest_order")).select(
        "key", "_id", "shape", "url", "title", "language", "entities", "keywords", "internal_links", "external_links",
        "quality_score", "spam_score",
    )


def _arriving(spark, sf_dir) -> tuple[str, int]:
    """The documents as JSON files that arrive in three parts: a new folder, and the number of files of a part."""
    root = f"{shared_folder(spark)}/stream/{uuid.uuid4().hex}"
    pages, files = document_pages(spark, sf_dir), spark.sparkContext.defaultParallelism
    last = pages.agg(F.max("ingest_order")).first()[0] or 0
    third = F.least(F.floor(F.col("ingest_order") * 3 / (last + 1)), F.lit(2))
    for i in range(3):  # a copy may arrive batches after the first of its kind
        pages.where(third == i).repartition(files).write.mode("append").json(f"{root}/in")
    return root, files


def _streamed(spark, sf_dir) -> str:
    """Run the documents through the stream in three micro-batches, and give the output folder."""
    root, files = _arriving(spark, sf_dir)
    job = CurationJob(f"{root}/out", DICTIONARY, language_profile(spark, sf_dir), label_enrichment(spark, sf_dir), OPTIONS)
    query = job.start(stream_pages_json(spark, f"{root}/in", OPTIONS, max_files_per_trigger=files), every=None)
    query.awaitTermination()
    return f"{root}/out"


def q_stream_upsert(spark, sf_dir):
    """The current documents after three micro-batches, as the table of their buckets holds them."""
    latest = current_documents(spark, _streamed(spark, sf_dir))
    return latest.select("_id", "key", "url", "title", "quality_score", "spam_score")


def q_stream_sink_counters(spark, sf_dir):
    written = read_committed(spark, _streamed(spark, sf_dir), "documents")
    return sink_counters(written).select(F.col("documents_indexed"), "distinct_ids")


def q_stream_counters(spark, sf_dir):
    """What each micro-batch observed while it wrote its tables."""
    return committed_counters(spark, _streamed(spark, sf_dir)).select("batch_id", "pages_processed", "invalid_urls", "duplicates", "claims", "nlp_requests", "nlp_errors")


def q_stream_first_seen(spark, sf_dir):
    """The stateful stream in three micro-batches: the first page of every signature."""
    root, files = _arriving(spark, sf_dir)
    firsts = first_seen(stream_pages_json(spark, f"{root}/in", OPTIONS, max_files_per_trigger=files), OPTIONS)
    writer = firsts.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    start_stateful(spark, writer, f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("sig", "key")


def q_stream_enrichment(spark, sf_dir):
    """Pages and their results as two streams in three micro-batches; a result comes up to 15 seconds after its page, 10 are waited for.

    A last page and a last result, long after, move the watermark past all limits and are left out.
    """
    root, begin = f"{shared_folder(spark)}/stream/{uuid.uuid4().hex}", F.lit(1_700_000_000)
    arrived = F.timestamp_seconds(begin + F.col("ingest_order"))
    pages = document_pages(spark, sf_dir).select("ingest_order", "key", arrived.alias("arrived"), (F.col("visible_text") != "").alias("has_text"))
    late = F.timestamp_seconds(begin + F.col("key").cast("long") + F.col("key").cast("long") % 16)
    results = label_enrichment(spark, sf_dir).withColumn("answered", late)
    last = pages.agg(F.max("ingest_order")).first()[0] or 0
    files = spark.sparkContext.defaultParallelism
    after = F.timestamp_seconds(begin + last + 1_000_000)
    for i in range(3):
        for name, rows, order in (("pages", pages, F.col("ingest_order")), ("results", results, F.col("key").cast("long"))):
            third = F.least(F.floor(order * 3 / (last + 1)), F.lit(2))
            rows.where(third == i).repartition(files).write.mode("append").parquet(f"{root}/{name}")
    end = spark.range(1)
    end.select(F.lit(-1).cast("long").alias("ingest_order"), F.lit("-1").alias("key"), after.alias("arrived"), F.lit(True).alias("has_text")).write.mode("append").parquet(f"{root}/pages")
    end.select(F.lit("-2").alias("key"), F.array().cast(ENTITIES).alias("entities"), F.array().cast("array<string>").alias("keyphrases"), after.alias("answered")).write.mode("append").parquet(f"{root}/results")

    def stream(name: str, schema: T.StructType) -> DataFrame:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{root}/{name}")

    met = enrich_in_time(stream("pages", pages.schema), stream("results", results.schema), OPTIONS)
    writer = met.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    start_stateful(spark, writer, f"{root}/out").awaitTermination()
    found = spark.read.schema(met.schema).parquet(f"{root}/out").where("key <> '-1'")
    return found.select("key", "shape", F.when(F.col("shape") == "full", F.size("keyphrases")).alias("n_keyphrases"))


# --- further forms of the operators --------------------------------------------------------------------------------


def q_run_counters_unkeyed(spark, sf_dir):
    """The counters of a run in which every eleventh page has no key."""
    pages = document_pages(spark, sf_dir).withColumn("key", F.when(F.col("ingest_order") % 11 != 0, F.col("key")))
    return run_counters(decide(pages, DICTIONARY, language_profile(spark, sf_dir), None, OPTIONS), OPTIONS)


def q_blank_texts(spark, sf_dir):
    """Derived enrichment where three pages of four have an empty, blank or null text: empty arrays, not failures."""
    kind, text = F.col("ingest_order") % 4, F.col("visible_text")
    pages = document_pages(spark, sf_dir).withColumn("visible_text", F.when(kind == 0, "").when(kind == 1, " \t\n ").when(kind == 3, text))
    enrichment = derive_enrichment(pages, OPTIONS, host_gazetteer(spark, sf_dir), STOP_WORDS)
    return attach_enrichment(pages, enrichment, OPTIONS).select(
        "key", "shape", F.when(kind != 3, F.size("entities")).alias("n_entities"), (F.size("keyphrases") > 0).alias("has_keyphrases")
    )


def q_pages_from_files(spark, sf_dir):
    """Page records read from JSON files, with one broken record for each label among them."""
    folder = f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"
    document_pages(spark, sf_dir).drop("key", "ingest_order").write.json(folder)
    read_table(spark, sf_dir, "labels").select(F.concat(F.lit('{"url": '), F.col("doc_id").cast("string")).alias("value")).write.mode("append").text(folder)
    good, bad = split_undecodable(cut_lineage(read_pages_json(spark, folder)))
    facts = ["url", "canonical_url", "title", "load_time", "is_secure"]
    read = good.select(*facts, byte_length("visible_text").alias("n_bytes"), F.lit(False).alias("undecodable"))
    return read.unionByName(bad.select(F.col(CORRUPT).isNotNull().alias("undecodable")), allowMissingColumns=True)


def q_dictionary_from_files(spark, sf_dir):
    """A dictionary read from a file of phrases: the titles of the documents, some listed twice or in two spellings, and those with weights of their own."""
    folder = f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"
    titles = document_pages(spark, sf_dir).select(F.explode(F.array("title", F.lower("title"), "title")).alias("value"))
    given = dictionary_table(spark, EXPLICIT_WEIGHTS).select(F.col("phrase").alias("value"))
    titles.union(given).write.text(folder)
    return read_dictionary(spark, folder)


def _by_batches(spark, sf_dir, count: Callable[[DataFrame], DataFrame], kind) -> DataFrame:
    """What three batches of documents count, added up."""
    path, documents = f"{shared_folder(spark)}/counts/{uuid.uuid4().hex}", spread(read_table(spark, sf_dir, "documents"))
    for i in range(3):
        counts.append_counts(count(documents.where(F.col("doc_id") % 3 == i)), path, i)
    return cut_lineage(counts.read_counts(spark, path, kind))


def q_profile_by_batches(spark, sf_dir):
    summed = _by_batches(spark, sf_dir, count_trigrams, counts.TRIGRAMS)
    return profile_from_counts(summed).withColumn("logp", F.round("logp", 6))


def q_frequencies_by_batches(spark, sf_dir):
    count = lambda docs: train_word_frequencies(docs, "text", STOP_WORDS)
    return _by_batches(spark, sf_dir, count, counts.WORDS)


def q_entities_by_anchors(spark, sf_dir):
    """Entities with names that are not broadcast: words of the texts meet the names anchored at them."""
    found = entities.extract_entities(document_pages(spark, sf_dir), host_gazetteer(spark, sf_dir), broadcast_bytes=0)
    return found.select("key", F.array_join(format_entities("entities"), " | ").alias("entities"))


def q_language_detect_rest(spark, sf_dir):
    """Detection by a profile of which 40,000 bytes are broadcast; all other trigrams meet the rest of it by a join."""
    pages = document_pages(spark, sf_dir)
    few = pages.where(byte_length("visible_text") >= OPTIONS.min_detect_bytes)
    scores = language.language_scores(few, language.prepare_profile(language_profile(spark, sf_dir), broadcast_bytes=40_000), KEYS)
    return pages.select(*KEYS).join(scores, KEYS, "left").select("key", "detected", F.round("en_conf", 6).alias("en_conf"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: query for name, query in globals().items() if name.startswith("q_")}
