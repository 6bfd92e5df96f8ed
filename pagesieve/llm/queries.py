"""The registered queries of the operators and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.llm.decontaminate import contaminated
from pagesieve.llm.divergence import source_divergence
from pagesieve.llm.language_model import cross_entropy_difference
from pagesieve.llm.minhash import near_duplicates
from pagesieve.llm.packing import pack
from pagesieve.llm.passages import repeated_passages
from pagesieve.llm.pii import find_pii, pii_digest
from pagesieve.llm.quality import score_quality
from pagesieve.llm.secrets import scan_secrets, secret_digest
from pagesieve.llm.toxicity import score_toxicity
from pagesieve.llm.vectors import near_vectors
from pagesieve.llm.warc import archive_round_trip
from pagesieve.llm.whitening import whiten


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def item_digest(found: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), *tokenizer_files()).drop("ids")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(read_table(spark, sf_dir, "documents")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(read_table(spark, sf_dir, "documents")))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").where("quality = 1"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_digest(contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read_table(spark, sf_dir, "pages")).drop("url")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_quality_classifier, op2_packing, op3_substring_dedup, op4_embedding_dedup, op5_minhash_dedup, op6_secret_scan, op7_pii,
        op8_lm_scoring, op9_toxicity, op10_decontamination, op11_warc, op12_whitening, op13_divergence, pipeline,
    )
    return {f.__name__: f for f in own}


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

REACHABLE = """
, edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links)
, reach AS (SELECT a AS id, a AS least FROM edges UNION SELECT e.b, r.least FROM reach r JOIN edges e ON e.a = r.id)
, components AS (SELECT id, min(least) AS component FROM reach GROUP BY id)
"""

OP4 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), usable AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y
  ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.98
){REACHABLE}
SELECT v.vec_id, (SELECT count(*) FROM edges WHERE edges.a = v.vec_id) AS n_links,
  coalesce(c.component, v.vec_id) AS component_id, coalesce(c.component, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN components c ON c.id = v.vec_id
"""

OP5 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS shingles FROM w
), one AS (SELECT doc_id, unnest(shingles) AS shingle FROM s)
, common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM one x JOIN one y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b
  WHERE 100 * n >= 85 * (len(p.shingles) + len(q.shingles) - n)
){REACHABLE}
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(c.component, s.doc_id) AS component_id,
  coalesce(c.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN components c ON c.id = s.doc_id
"""

OP10 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS text
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS text
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
), found AS (SELECT doc_id, k, n, item_id FROM doc_windows JOIN item_windows USING (n, text))
, words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id)
, items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP11 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), shared AS (SELECT html, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT p.page_id, payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN p.page_id IS DISTINCT FROM holder AND holder IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM p LEFT JOIN shared ON shared.html = p.html
"""

OP13 = f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
    regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), words AS (SELECT lang, source, doc, unnest(w) AS term FROM d)
, kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 3)
, langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang)
, counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL)
, sizes AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL)
, groups AS (SELECT DISTINCT lang, source FROM d)
, shares AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (coalesce(s.n, 0) + l.v) AS p, 1 + (1000000000 * (k.n + 1)::HUGEINT) // (l.n + l.v) AS q
  FROM groups JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sizes s USING (lang, source) LEFT JOIN counts c USING (lang, source, term)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def all_oracles() -> dict[str, str]:
    """The others train models, carry state from window to window or aggregate votes by iteration: SQL cannot express them."""
    return {"op4_embedding_dedup": OP4, "op5_minhash_dedup": OP5, "op10_decontamination": OP10, "op11_warc": OP11, "op13_divergence": OP13}
