"""Exact de-duplication by content signature: first page wins, within a run and against all earlier runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.schemas import Options

#: The signatures of earlier runs: a table, or what answers which of some signatures it holds.
Seen = DataFrame | Callable[[DataFrame], DataFrame]


def first_per_signature(signed: DataFrame, options: Options = Options()) -> DataFrame:
    """``(sig, order, key)`` of the first page of every signature.

    A min over a narrow struct: copies collapse before the shuffle, so a signature shared by a third of all pages
    costs one row per map task.
    """
    order, key = options.order_by, options.key
    first = F.min(F.struct(F.col(order), F.col(key)))
    return signed.groupBy("sig").agg(first.alias("first")).select("sig", f"first.{order}", f"first.{key}")


def _held(firsts: DataFrame, seen: Seen) -> DataFrame:
    return seen.select("sig") if isinstance(seen, DataFrame) else seen(firsts)


def new_signatures(firsts: DataFrame, seen: Seen | None) -> DataFrame:
    """Firsts whose signature is not in the store. Both sides hold a signature at most a few times: no skew."""
    return firsts if seen is None else firsts.join(_held(firsts, seen), "sig", "left_anti")


def seen_signatures(firsts: DataFrame, seen: Seen) -> DataFrame:
    """Firsts whose signature the store already holds."""
    return firsts.join(_held(firsts, seen), "sig", "left_semi")


def survivors(signed: DataFrame, seen: Seen | None = None, options: Options = Options()) -> DataFrame:
    """``(sig, order, key)`` of the pages that are no duplicates."""
    return new_signatures(first_per_signature(signed, options), seen)


def mark_duplicates(signed: DataFrame, seen: Seen | None = None, options: Options = Options()) -> DataFrame:
    """``signed`` with a boolean ``is_duplicate``; joined on the unique (order, key), never on the skewed signature."""
    on = [options.order_by, options.key]
    kept = survivors(signed, seen, options).select(*on, F.lit(True).alias("_first"))
    return signed.join(kept, on, "left").withColumn("is_duplicate", F.col("_first").isNull()).drop("_first")
