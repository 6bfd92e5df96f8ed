"""Adapters from the given tables to the page record, for the registered queries, tests and the bench."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.schemas import PAGE


def _as_pages(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``key``, ``ingest_order`` and every PAGE field; fields not given are null."""
    fields = [columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PAGE.fields]
    return df.select(columns["key"].cast("string").alias("key"), columns["ingest_order"].alias("ingest_order"), *fields)


def pages_from_documents(documents: DataFrame) -> DataFrame:
    """Page records from ``documents``. One in fifty has a relative URL, one in seven shares its canonical URL."""
    i = F.col("doc_id")
    host = F.concat("source", F.lit(".example.com"))
    path = F.concat(F.lit("/"), "lang", F.lit("/"), i.cast("string"))
    mixed_case = F.concat(F.lit(" HTTPS://"), F.upper(host), path)
    plain = F.concat(F.lit("https://"), host, path)
    shared = F.concat(F.lit("//Example.com/"), "source", F.lit("?p="), (i % 97).cast("string"))
    return _as_pages(
        documents,
        {
            "key": i,
            "ingest_order": i,
            "url": F.when(i % 50 == 0, path).when(i % 3 == 0, mixed_case).otherwise(plain),
            "canonical_url": F.when(i % 7 == 1, shared).when(i % 7 == 2, F.lit("/relative")).otherwise(F.lit("")),
            "title": F.regexp_extract("text", r"^[^.\n]*", 0),
            "meta_description": F.regexp_extract("text", r"\n([^\n]*)", 1),
            "language": F.col("lang"),
            "internal_links": F.when(
                i % 2 == 0, F.array(F.lit("/about"), F.concat(F.lit("//"), host, F.lit("/x")), plain)
            ).otherwise(F.array(F.lit("/about"))),
            "external_links": F.when(i % 3 != 0, F.array(F.lit("HTTPS://Other.Example.org/Ä?b=C#"), F.lit("mailto:a@b"))),
            "date_published": F.timestamp_seconds(F.lit(1_700_000_000) + i * 3600),
            "social_links": F.array(F.lit("https://Social.example.com/a")),
            "visible_text": F.col("text"),
            "load_time": (i % 4) * 1_000_000_000 + i,
            "is_secure": i % 2 == 0,
        },
    )


# Parts of an HTML page that hold no visible text.
HIDDEN_HTML = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<title.*?</title>|<[^>]*>"


def pages_from_html(pages: DataFrame) -> DataFrame:
    """Page records from the raw ``pages``. On even ids the links also come as absolute and scheme-relative URLs."""
    i = F.col("page_id")
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    host = F.upper(F.regexp_extract("url", "^[^/]*//([^/?#]*)", 1))
    variants = F.flatten(
        F.transform(
            hrefs,
            lambda h: F.array(h, F.concat(F.lit("https://"), host, h), F.concat(F.lit("//"), host, h)),
        )
    )
    return _as_pages(
        pages,
        {
            "key": i,
            "ingest_order": i,
            "url": F.col("url"),
            "title": F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1),
            "language": F.regexp_extract("html", '<html lang="([^"]*)"', 1),
            "internal_links": F.when(i % 2 == 0, variants).otherwise(hrefs),
            "visible_text": F.regexp_replace("html", HIDDEN_HTML, " "),
            "is_secure": F.col("url").startswith("https:"),
        },
    )
