"""Enrichment join and projection of accepted pages to search documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.quality import penalized_quality, quality_score
from pagesieve.functions.text import clean_text, load_time_ms, text_or_empty
from pagesieve.functions.urls import doc_id, normalize_links, normalize_url
from pagesieve.operators.entities import format_entities
from pagesieve.schemas import DOCUMENT, Options

FULL, NLP_FAILED, EMPTY_TEXT = "full", "nlp_failed", "empty_text"


def canonical_or_raw(canonical_url: Column | str) -> Column:
    """The canonical URL normalised where it is valid, else as given."""
    return F.coalesce(normalize_url(canonical_url), text_or_empty(canonical_url))


def attach_enrichment(
    pages: DataFrame, enrichment: DataFrame, options: Options = Options(), has_text: Column | None = None
) -> DataFrame:
    """Left-join ``(key, entities, keyphrases)`` and name each page's ``shape``; a page without a result is kept.

    ``has_text`` stands in for the text where ``pages`` does not carry it.
    """
    found = enrichment.select(options.key, "entities", "keyphrases", F.lit(True).alias("_enriched"))
    has_text = text_or_empty("visible_text") != "" if has_text is None else has_text
    return (
        pages.join(found, options.key, "left")
        .withColumn(
            "shape",
            F.when(~has_text, EMPTY_TEXT).when(F.col("_enriched").isNull(), NLP_FAILED).otherwise(FULL),
        )
        .drop("_enriched")
    )


def to_documents(enriched: DataFrame, options: Options = Options(), crawled_at: Column | None = None) -> DataFrame:
    """``key``, the order column, ``_id``, ``shape`` and every DOCUMENT field.

    ``enriched`` holds the page columns with ``norm_url``, ``lang`` and ``spam``. Only the full shape carries the copied
    fields; the other two hold the URL, the cleaned text and the spam score.
    """
    full = F.col("shape") == FULL
    crawled_at = F.current_timestamp() if crawled_at is None else crawled_at

    def string(value: Column) -> Column:
        return F.when(full, value).otherwise("")

    staged = enriched.select(
        options.key,
        options.order_by,
        "shape",
        F.when(full & F.lit(not options.emit_clean), text_or_empty("url")).otherwise(F.col("norm_url")).alias("url"),
        string(canonical_or_raw("canonical_url")).alias("canonical_url"),
        string(text_or_empty("title")).alias("title"),
        string(text_or_empty("meta_description")).alias("meta_description"),
        F.when(full & F.lit(not options.emit_clean), text_or_empty("visible_text"))
        .otherwise(clean_text("visible_text"))
        .alias("visible_text"),
        F.when(full, format_entities("entities")).alias("entities"),
        F.when(full, F.col("keyphrases")).alias("keywords"),
        string(F.col("lang")).alias("language"),
        F.when(full, normalize_links("internal_links")).alias("internal_links"),
        F.when(full, normalize_links("external_links")).alias("external_links"),
        F.when(full, F.col("date_published")).alias("date_published"),
        F.when(full, F.col("date_modified")).alias("date_modified"),
        F.when(full, F.col("social_links")).alias("social_links"),
        F.when(full, load_time_ms(F.coalesce("load_time", F.lit(0).cast("long")))).otherwise(0).alias("load_time"),
        F.when(full, F.coalesce("is_secure", F.lit(False))).otherwise(False).alias("is_secure"),
        F.col("spam").alias("spam_score"),
        F.when(full, crawled_at).alias("last_crawled"),
    )
    quality = penalized_quality(
        quality_score(
            "visible_text", "title", "meta_description", "entities", "keywords", "internal_links", "external_links",
            "language", "is_secure", "load_time",
        ),
        "spam_score",
    )
    computed = {
        "quality_score": F.when(full, quality).otherwise(0),
        "structured_data": F.struct(F.lit("").alias("@context"), F.lit("").alias("@type")),
        "open_graph": F.struct(*[F.lit("").alias(f"og:{name}") for name in ("title", "description", "image")]),
        "categories": F.lit(None),
        "tags": F.lit(None),
        "inbound_link_count": F.lit(0),
    }
    fields = [computed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in DOCUMENT.fields]
    return staged.select(options.key, options.order_by, doc_id("url", "canonical_url").alias("_id"), "shape", *fields)
