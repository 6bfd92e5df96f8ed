"""Web-page curation as Spark jobs: clean, de-duplicate, gate, enrich, score and index page records."""

from pagesieve.schemas import DOCUMENT, PAGE, Options

__all__ = ["DOCUMENT", "PAGE", "Options"]
