"""Enrichment that arrives as a stream of its own: a page waits for its result up to a limit, then goes on without."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.operators.document import EMPTY_TEXT, FULL, NLP_FAILED
from pagesieve.schemas import Options

#: How long a page waits for its result.
WAIT = "10 seconds"


def enrich_in_time(
    pages: DataFrame, results: DataFrame, options: Options = Options(), wait: str = WAIT, lateness: str = "0 seconds",
    arrived: str = "arrived", answered: str = "answered", has_text: str = "has_text",
) -> DataFrame:
    """``pages`` (a stream) with ``entities``, ``keyphrases`` and ``shape`` from ``results`` (key, answered, entities, keyphrases).

    A result counts when it is answered no earlier than its page arrived and at most ``wait`` later; a page whose result is later or
    never comes has the failed shape, given out once the watermark has passed its limit. Pages without text wait for nothing and
    have the empty shape. Both streams may be late by ``lateness``. Give narrow pages (key, arrived, has_text and what decides
    routing): all they carry is held as state until their limit; whole pages are met on the key afterwards. Results are one a page.
    """
    waiting = pages.withWatermark(arrived, lateness).alias("p")
    found = (
        results.select(F.col(options.key).alias("_key"), F.col(answered).alias("_answered"), "entities", "keyphrases", F.lit(True).alias("_found"))
        .withWatermark("_answered", lateness).alias("r")
    )
    in_time = (F.col(options.key) == F.col("_key")) & (F.col("_answered") >= F.col(arrived)) & (
        F.col("_answered") <= F.col(arrived) + F.expr(f"INTERVAL {wait}")
    ) & F.col(has_text)
    shape = F.when(~F.col(has_text), EMPTY_TEXT).when(F.col("_found"), FULL).otherwise(NLP_FAILED)
    return waiting.join(found, in_time, "leftOuter").withColumn("shape", shape).drop("_key", "_answered", "_found")
