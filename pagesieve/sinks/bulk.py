"""Bulk NDJSON for a search index: an action line and a document line per document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.operators.upsert import latest_per_id
from pagesieve.schemas import DOCUMENT, Options


def action_line(index_name: str, doc_id: Column | str = "_id") -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.to_json(F.struct(F.struct(F.lit(index_name).alias("_index"), doc_id.alias("_id")).alias("index")))


def document_line() -> Column:
    """The document as JSON, null fields kept, times in UTC."""
    fields = F.struct(*[F.col(f"`{f.name}`") for f in DOCUMENT.fields])
    return F.to_json(fields, {"ignoreNullFields": "false", "timeZone": "UTC"})


def bulk_lines(documents: DataFrame, options: Options = Options(), *beside: Column) -> DataFrame:
    """One ``value`` per document holding both lines, so that no split can part them, after the columns ``beside``."""
    return documents.select(*beside, F.concat(action_line(options.index_name), F.lit("\n"), document_line()).alias("value"))


def write_bulk(
    documents: DataFrame, path: str, options: Options = Options(), documents_per_file: int = 0, compression: str | None = None,
    observe: Callable[[DataFrame], DataFrame] = lambda lines: lines,
) -> None:
    """Write the latest document per id as bulk files of at most ``documents_per_file`` documents (0: no limit).

    ``observe`` may attach an observation to the lines.
    """
    writer = observe(bulk_lines(latest_per_id(documents, options), options)).write.mode("overwrite")
    writer = writer.option("maxRecordsPerFile", documents_per_file)
    (writer.option("compression", compression) if compression else writer).text(path)
