"""Fixed schemas of the page record, the output document and the auxiliary tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_STR = T.StringType()
_STRS = T.ArrayType(T.StringType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# One crawled page.
PAGE = _struct(
    ("url", _STR),
    ("canonical_url", _STR),
    ("title", _STR),
    ("charset", _STR),
    ("meta_description", _STR),
    ("meta_keywords", _STR),
    ("language", _STR),
    ("headings", T.MapType(_STR, _STRS)),
    ("alt_texts", _STRS),
    ("anchor_texts", _STRS),
    ("internal_links", _STRS),
    ("external_links", _STRS),
    ("structured_data", _STRS),
    ("open_graph", T.MapType(_STR, _STR)),
    ("date_published", T.TimestampType()),
    ("date_modified", T.TimestampType()),
    ("social_links", _STRS),
    ("visible_text", _STR),
    ("load_time", T.LongType()),  # nanoseconds
    ("is_secure", T.BooleanType()),
    ("fetch_error", _STR),
)

# One search document, in the field order of the bulk file.
DOCUMENT = _struct(
    ("url", _STR),
    ("canonical_url", _STR),
    ("title", _STR),
    ("meta_description", _STR),
    ("visible_text", _STR),
    ("entities", _STRS),
    ("keywords", _STRS),
    ("language", _STR),
    ("internal_links", _STRS),
    ("external_links", _STRS),
    ("structured_data", _struct(("@context", _STR), ("@type", _STR))),
    ("open_graph", _struct(("og:title", _STR), ("og:description", _STR), ("og:image", _STR))),
    ("date_published", T.TimestampType()),
    ("date_modified", T.TimestampType()),
    ("categories", _STRS),
    ("tags", _STRS),
    ("social_links", _STRS),
    ("load_time", T.LongType()),  # milliseconds
    ("is_secure", T.BooleanType()),
    ("quality_score", T.IntegerType()),
    ("spam_score", T.IntegerType()),
    ("inbound_link_count", T.IntegerType()),
    ("last_crawled", T.TimestampType()),
)

ENTITIES = T.ArrayType(_struct(("text", _STR), ("label", _STR)))
ENRICHMENT = _struct(("key", _STR), ("entities", ENTITIES), ("keyphrases", _STRS))
SIGNATURES = _struct(("sig", _STR), ("key", _STR), ("batch_id", T.LongType()))
DICTIONARY = _struct(("phrase", _STR), ("weight", T.IntegerType()))
LANGUAGE_PROFILE = _struct(("lang", _STR), ("gram", _STR), ("logp", T.DoubleType()))

# The columns of PAGE the pipeline reads; the others are pruned from every scan.
PAGE_COLUMNS_READ = (
    "url", "canonical_url", "title", "meta_description", "internal_links", "external_links",
    "date_published", "date_modified", "social_links", "visible_text", "load_time", "is_secure",
)


@dataclass(frozen=True)
class Options:
    """Settings that change results.

    ``key`` names the page's unique key and ``order_by`` the arrival order that decides which of several
    identical pages is the first; the pair (``order_by``, ``key``) must be unique.
    """

    key: str = "key"
    order_by: str = "ingest_order"
    spam_threshold: int = 15
    english_floor: float = 0.33
    min_detect_bytes: int = 20
    dilution_length: int = 5000
    index_name: str = "search_engine_index"
    top_keyphrases: int = 10
    diversity: float = 0.5
    emit_clean: bool = False  # full documents carry the cleaned text and normalised URL instead of the raw ones
