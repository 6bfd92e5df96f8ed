"""A training corpus from documents: quality, near-duplicates, benchmark contamination, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of documents. Rows and columns that a stage does not
decide about pass unchanged. Null, empty and very long texts, repeated rows, ties and empty tables are as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesieve.llm.decontaminate import contaminated
from pagesieve.llm.minhash import near_duplicates
from pagesieve.llm.packing import pack
from pagesieve.llm.pii import redact
from pagesieve.llm.quality import score_quality
from pagesieve.llm.queries import read_table, tokenizer_files
from pagesieve.session import cut_lineage

#: Near-duplicates of the corpus: similarity of five-word shingle sets, in percent.
SIMILAR_PERCENT = 80


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` less the documents whose ids are in ``dropped``; rows with a null id stay."""
    return docs.join(dropped.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return without(docs, cut_lineage(score_quality(docs, read_table(spark, sf_dir, "labels")).where("predicted = 0")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id; of repeated rows of it, one."""
    groups = near_duplicates(docs, SIMILAR_PERCENT)
    kept = without(docs, groups.where("NOT kept"))
    known = kept.where("doc_id IS NOT NULL")
    repeated = cut_lineage(known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    # a row is carried as one value, so that columns may have any name and type; equal rows are alike whichever stays
    rows = known.join(repeated, "doc_id", "left_semi").select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    order = Window.partitionBy("doc_id").orderBy(F.to_json("row"))
    one = rows.withColumn("at", F.row_number().over(order)).where("at = 1").select("row.*")
    return without(kept, repeated).union(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark text go."""
    return without(docs, cut_lineage(contaminated(docs, read_table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes tags; n_chars follows the text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens in which every source keeps its share, as pieces."""
    return pack(docs, *tokenizer_files()).drop("ids")


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the packing and the votes are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None
