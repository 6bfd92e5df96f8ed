"""The batch pipeline: page records in; documents, rejects and new signatures out.

Gate order is part of the result. A page with an invalid URL never claims its signature; a page rejected for its
language or spam score has already claimed it, so a later copy is a duplicate.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.text import byte_length, content_signature
from pagesieve.functions.urls import normalize_url
from pagesieve.operators.dedup import Seen, first_per_signature, new_signatures
from pagesieve.operators.document import attach_enrichment, to_documents
from pagesieve.operators.entities import extract_entities
from pagesieve.operators.keyphrases import extract_keyphrases
from pagesieve.operators.language import LanguageModel, detect_language, gate_language, is_rejected_language
from pagesieve.operators.spam import spam_score, spam_scores_by_join
from pagesieve.schemas import PAGE_COLUMNS_READ, Options
from pagesieve.session import cut_lineage, within

#: Narrow rows that meet whole pages by broadcast, at most; beyond, pages are shuffled.
BROADCAST_ROWS = 500_000

Enricher = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Curated:
    """What one run yields. ``decisions`` has one narrow row per page."""

    documents: DataFrame
    rejected: DataFrame
    new_signatures: DataFrame
    decisions: DataFrame
    enriched: DataFrame


def page_facts(pages: DataFrame, dictionary: Mapping[str, int] | DataFrame, options: Options = Options()) -> DataFrame:
    """Everything a gate needs that one page alone decides, as one narrow row per page.

    A dictionary table, of any size, is matched by a join; its scores meet the other facts on the page key.
    """
    by_join = isinstance(dictionary, DataFrame)
    facts = pages.select(
        options.order_by,
        options.key,
        "url",
        normalize_url("url").alias("norm_url"),
        content_signature("visible_text").alias("sig"),
        byte_length("visible_text").alias("n_bytes"),
        *([] if by_join else [spam_score("visible_text", dictionary, options.dilution_length).alias("spam")]),
    )
    if not by_join:
        return facts
    scores = spam_scores_by_join(pages, dictionary, options).withColumnRenamed("spam_score", "spam")
    return facts.join(scores, options.key, "left").withColumn("spam", F.coalesce("spam", F.lit(0)))


def valid_pages(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """The pages that no gate rejects by what their own row says at little cost: a valid URL, a key and an order."""
    return pages.where(normalize_url("url").isNotNull() & F.col(options.key).isNotNull() & F.col(options.order_by).isNotNull())


def decide(
    pages: DataFrame,
    dictionary: Mapping[str, int] | DataFrame,
    profile: DataFrame | LanguageModel,
    seen: Seen | None = None,
    options: Options = Options(),
    materialize: bool = False,
) -> DataFrame:
    """``(order, key, url, norm_url, sig, n_bytes, spam, lang, en_conf, claims, outcome)`` for every page.

    Texts are read where they lie and never shuffled here: what travels to be joined on (order, key) are hashes, scores
    and lengths. With ``materialize`` these facts are written first, so that finding the first pages hashes no text again.
    Pages that the URL alone rejects get no language: ``lang`` is unknown there.
    """
    on = [options.order_by, options.key]
    facts = page_facts(pages, dictionary, options)
    if materialize:
        facts = cut_lineage(facts)
    keyed = F.col(options.key).isNotNull() & F.col(options.order_by).isNotNull()
    firsts = first_per_signature(facts.where(F.col("norm_url").isNotNull() & keyed), options)
    firsts = cut_lineage(firsts) if materialize and seen is not None and not isinstance(seen, DataFrame) else firsts
    firsts = new_signatures(firsts, seen).select(*on, F.lit(True).alias("claims"))
    languages = detect_language(valid_pages(pages, options), profile, on, options)
    return (
        facts.join(firsts, on, "left")
        .join(languages, on, "left")
        .withColumn("claims", F.coalesce("claims", F.lit(False)))
        .withColumn("lang", gate_language("detected", "n_bytes", options))
        .withColumn("outcome", _outcome(options))
        .drop("detected")
    )


def _outcome(options: Options) -> Column:
    """The first gate a page fails."""
    return (
        F.when(F.col("norm_url").isNull(), "invalid_url")
        .when(F.col(options.key).isNull() | F.col(options.order_by).isNull(), "unkeyed")
        .when(~F.col("claims"), "duplicate")
        .when(is_rejected_language("lang", "en_conf", options), "non_english")
        .when((F.col("n_bytes") > 0) & (F.col("spam") >= options.spam_threshold), "high_spam")
        .otherwise("indexed")
    )


def rejected_pages(decisions: DataFrame, options: Options = Options()) -> DataFrame:
    """``(key, url, outcome, detected_language, spam_score)``; a gate's value is null where the page never reached it."""
    reached_language = F.col("outcome").isin("non_english", "high_spam")
    return decisions.where("outcome <> 'indexed'").select(
        options.key,
        "url",
        "outcome",
        F.when(reached_language, F.col("lang")).alias("detected_language"),
        F.when(F.col("outcome") == "high_spam", F.col("spam")).alias("spam_score"),
    )


def passed_gates(decisions: DataFrame, options: Options = Options()) -> DataFrame:
    """The narrow rows of the pages to index."""
    return decisions.where("outcome = 'indexed'").select(
        options.order_by, options.key, "norm_url", "lang", "spam", "n_bytes"
    )


def with_page_columns(pages: DataFrame, narrow: DataFrame, options: Options = Options(), few: bool = False) -> DataFrame:
    """``narrow`` with the page columns: the join that moves whole pages, and only on their unique (order, key).

    With ``few`` the narrow rows, counted to be so, are broadcast and no page moves. Else pages are shuffled, but for those whose own
    row shows that they were rejected.
    """
    on = [options.order_by, options.key]
    page = [*on, *PAGE_COLUMNS_READ]
    return pages.select(page).join(F.broadcast(narrow), on) if few else valid_pages(pages, options).select(page).join(narrow, on)


def derive_enrichment(
    accepted: DataFrame,
    options: Options = Options(),
    gazetteer: DataFrame | None = None,
    stop_words: list[str] | None = None,
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """``(key, entities, keyphrases)`` computed from the accepted texts.

    For micro-batches pass the saved word ``frequencies`` of a large corpus; a small batch is no corpus of its own.
    """
    texts = accepted.select(options.key, "visible_text")
    return extract_entities(texts, gazetteer, options.key).join(
        extract_keyphrases(texts, options, stop_words=stop_words, frequencies=frequencies), options.key
    )


def curate(
    pages: DataFrame,
    dictionary: Mapping[str, int] | DataFrame,
    profile: DataFrame | LanguageModel,
    seen: Seen | None = None,
    enrichment: DataFrame | Enricher | None = None,
    options: Options = Options(),
    crawled_at: Column | None = None,
    materialize: bool = False,
    observe: Callable[[DataFrame], DataFrame] | None = None,
) -> Curated:
    """Run every gate and build the documents.

    ``enrichment`` is a finished table, a function from accepted pages to one, or None to derive it here. With
    ``materialize`` the decisions, and the accepted pages with their enrichment when it is derived from them, are written once for
    all outputs, instead of each output reading and hashing the pages again. ``observe`` may attach an observation to the decisions
    before they are written.
    """
    keep = cut_lineage if materialize else (lambda df: df)
    decisions = decide(pages, dictionary, profile, seen, options, materialize)
    decisions = keep(observe(decisions) if observe else decisions)
    passed = passed_gates(decisions, options)
    few = materialize and within(passed, BROADCAST_ROWS)
    if isinstance(enrichment, DataFrame):
        # results meet the narrow rows first, so that whole pages are shuffled once
        narrow = attach_enrichment(passed, enrichment, options, F.col("n_bytes") > 0)
        enriched = with_page_columns(pages, narrow, options, few)
    else:
        accepted = keep(with_page_columns(pages, passed, options, few))
        enrichment = keep(enrichment(accepted) if enrichment else derive_enrichment(accepted, options))
        enriched = attach_enrichment(accepted, enrichment, options)
    return Curated(
        documents=to_documents(enriched, options, crawled_at),
        rejected=rejected_pages(decisions, options),
        new_signatures=decisions.where("claims").select("sig", options.key),
        decisions=decisions,
        enriched=enriched,
    )
