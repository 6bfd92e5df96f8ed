"""Quality score: additive signals out of 100, then a spam penalty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesieve.functions.text import byte_length


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def _size(array: Column | str) -> Column:
    return F.coalesce(F.size(array), F.lit(0))


def quality_score(
    text: Column | str,
    title: Column | str,
    meta_description: Column | str,
    entities: Column | str,
    keywords: Column | str,
    internal_links: Column | str,
    external_links: Column | str,
    language: Column | str,
    is_secure: Column | str,
    load_time_ms: Column | str,
) -> Column:
    """Text lengths are in bytes; an unset load time is 0 and earns the full speed points."""
    language = F.col(language) if isinstance(language, str) else language
    is_secure = F.col(is_secure) if isinstance(is_secure, str) else is_secure
    ms = F.coalesce(load_time_ms, F.lit(0).cast("long"))
    total = (
        _points(byte_length(text) > 100, 10)
        + _points((byte_length(title) > 5) & (byte_length(title) < 150), 10)
        + _points(byte_length(meta_description) > 50, 5)
        + _points(_size(entities) >= 1, 10)
        + _points(_size(keywords) > 3, 10)
        + _points(_size(internal_links) > 0, 5)
        + _points(_size(external_links) > 0, 5)
        + _points(language == "en", 10)
        + _points(is_secure, 25)
        + F.when(ms < 1000, 10).when(ms < 2000, 5).when(ms < 3000, 2).otherwise(0)
    )
    return F.least(total, F.lit(100)).cast("int")


def penalized_quality(quality: Column | str, spam: Column | str) -> Column:
    """Twice the spam score off, never below 0."""
    quality = F.col(quality) if isinstance(quality, str) else quality
    spam = F.col(spam) if isinstance(spam, str) else spam
    return F.greatest(quality - 2 * F.greatest(spam, F.lit(0)), F.lit(0)).cast("int")
