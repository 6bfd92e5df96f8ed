"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from itertools import islice

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagesieve.operators.spam import spam_score  # noqa: E402
from pagesieve.registry.params import DICTIONARY, STOP_WORDS  # noqa: E402
from pagesieve.registry.queries import all_queries, document_pages  # noqa: E402
from pagesieve.session import local_session  # noqa: E402

HEADLINE = (
    "clean_text", "content_signature", "normalize_links", "dedup_first_wins", "dedup_against_store", "spam_score",
    "spam_histogram", "language_profile", "language_detect", "entities", "keyphrases", "decisions", "documents",
    "bulk_ndjson", "curate_derived", "spam_258_phrases", "spam_score_join", "dictionary_matches", "upsert_latest", "stream_upsert",
)


def spam_258_phrases(spark, sf_dir):
    """Spam scores by a dictionary of 258 phrases: those of the queries, filled up with pairs of function words."""
    pairs = (f"{a} {b}" for a in STOP_WORDS for b in STOP_WORDS if f"{a} {b}" not in DICTIONARY)
    phrases = DICTIONARY | dict.fromkeys(islice(pairs, 258 - len(DICTIONARY)), 1)
    return document_pages(spark, sf_dir).select("key", spam_score("visible_text", phrases).alias("spam_score"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start-up is not a query
    queries, seconds = all_queries() | {"spam_258_phrases": spam_258_phrases}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))


if __name__ == "__main__":
    main()
