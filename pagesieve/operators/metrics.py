"""Outcome metrics of a run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pagesieve.operators.language import UNKNOWN
from pagesieve.schemas import Options

# Upper bounds of the spam-score histogram; the last bucket is unbounded.
SPAM_BUCKETS = (0, 1, 2, 5, 10, 15, 20, 30, 50, 100)


def outcome_counts(decisions: DataFrame) -> DataFrame:
    """``(outcome, pages)``."""
    return decisions.groupBy("outcome").agg(F.count("*").alias("pages"))


def _counters(options: Options) -> dict[str, Column]:
    def n(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    outcome = F.col("outcome")
    # a detection failure: long enough to be detected, yet no language found
    failed = (F.col("lang") == UNKNOWN) & (F.col("n_bytes") >= options.min_detect_bytes)
    return {
        "pages_processed": n(outcome == "indexed"),
        "invalid_urls": n(outcome == "invalid_url"),
        "unkeyed": n(outcome == "unkeyed"),
        "duplicates": n(outcome == "duplicate"),
        "non_english": n(outcome == "non_english"),
        "high_spam": n(outcome == "high_spam"),
        "detection_failures": n(failed & ~outcome.isin("invalid_url", "unkeyed", "duplicate")),
    }


def run_counters(decisions: DataFrame, options: Options = Options()) -> DataFrame:
    """One row of counters over the decisions of a run."""
    return decisions.agg(*[c.alias(name) for name, c in _counters(options).items()])


def observe_outcomes(decisions: DataFrame, name: str, options: Options = Options()) -> DataFrame:
    """``decisions`` unchanged, with the same counters observed while it is written (batch or stream)."""
    return decisions.observe(name, *[c.alias(label) for label, c in _counters(options).items()])


_BOUNDS = [float(b) for b in SPAM_BUCKETS] + [float("inf")]


def _spam_buckets(value: Column) -> dict[str, Column]:
    return {
        "buckets": F.array(*[F.count(F.when(value <= b, 1)) for b in _BOUNDS]),
        "n": F.count(value),
        "score_sum": F.coalesce(F.sum(value), F.lit(0)).cast("long"),
    }


def spam_histogram(passed: DataFrame, score: str = "spam_score") -> DataFrame:
    """Cumulative ``(bound, pages)`` buckets with the total ``n`` and ``score_sum``, over pages that pass the spam gate.

    One pass: all buckets are one aggregate row, turned to rows afterwards.
    """
    bounds = _BOUNDS
    one = passed.agg(*[c.alias(name) for name, c in _spam_buckets(F.col(score)).items()])
    return one.select(F.posexplode("buckets").alias("i", "pages"), "n", "score_sum").select(
        F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("i") + 1).alias("bound"), "pages", "n", "score_sum"
    )


def _enrichment() -> dict[str, Column]:
    asked = F.col("shape") != "empty_text"  # by shape: a document's text is cleaned, a page's is not
    return {
        "nlp_requests": F.count(F.when(asked, 1)),
        "nlp_errors": F.count(F.when(asked & (F.col("shape") == "nlp_failed"), 1)),
    }


def enrichment_counters(enriched: DataFrame) -> DataFrame:
    """``nlp_requests`` and ``nlp_errors``: once per page that reached enrichment with text."""
    return enriched.agg(*[c.alias(name) for name, c in _enrichment().items()])


def sink_counters(documents: DataFrame, batch: str = "batch_id") -> DataFrame:
    """``documents_indexed`` and ``distinct_ids`` per batch of a written document table."""
    return documents.groupBy(batch).agg(
        F.count("*").alias("documents_indexed"), F.countDistinct("_id").alias("distinct_ids")
    )


def bulk_counters(lines: DataFrame) -> DataFrame:
    """``documents``, ``bulk_bytes`` (uncompressed) and ``bulk_files`` of written bulk files, read back as ``value`` lines."""
    sized = lines.select(F.octet_length("value").alias("n"), F.input_file_name().alias("file"))
    return sized.agg(
        F.call_function("div", F.count("*"), F.lit(2)).alias("documents"),
        F.coalesce(F.sum(F.col("n") + 1), F.lit(0)).cast("long").alias("bulk_bytes"),
        F.countDistinct("file").alias("bulk_files"),
    )


@dataclass
class BatchCounters:
    """All counters of a batch, gathered while its tables are written: no table is read again to be counted.

    Pass each table through its method before it is written; ``values`` has the numbers once all are.
    """

    options: Options = Options()
    decided: Observation = field(default_factory=Observation)
    documented: Observation = field(default_factory=Observation)
    sunk: Observation = field(default_factory=Observation)

    def decisions(self, decisions: DataFrame) -> DataFrame:
        spam = F.when(F.col("outcome") == "indexed", F.col("spam"))
        found = _counters(self.options) | _spam_buckets(spam) | {"claims": F.count_if("claims")}
        return decisions.observe(self.decided, *[c.alias(name) for name, c in found.items()])

    def documents(self, documents: DataFrame) -> DataFrame:
        return documents.observe(self.documented, *[c.alias(name) for name, c in _enrichment().items()])

    def bulk(self, lines: DataFrame) -> DataFrame:
        """``lines`` with one row per document that holds both of its lines."""
        size = F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).cast("long")
        return lines.observe(self.sunk, F.count("*").alias("documents"), size.alias("bulk_bytes"))

    def values(self) -> dict[str, int]:
        found = self.decided.get | self.documented.get | self.sunk.get
        return {name: value for name, value in found.items() if name not in ("buckets", "n", "score_sum")}

    def histogram(self) -> list[tuple[float, int, int, int]]:
        """``(bound, pages, n, score_sum)`` like ``spam_histogram``."""
        found = self.decided.get
        return [(bound, pages, found["n"], found["score_sum"]) for bound, pages in zip(_BOUNDS, found["buckets"])]
