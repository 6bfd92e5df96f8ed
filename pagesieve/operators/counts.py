"""Count tables that grow by batch: what a model is made of adds up, so no batch trains it anew."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key and value columns of the tables that models are made of.
TRIGRAMS = (["lang", "gram"], "n")
WORDS = (["word"], "df")


def merged(tables: list[DataFrame], kind: tuple[list[str], str]) -> DataFrame:
    """The sum of several count tables."""
    keys, value = kind
    together = tables[0].select(*keys, value)
    for table in tables[1:]:
        together = together.unionByName(table.select(*keys, value))
    return together.groupBy(*keys).agg(F.sum(value).alias(value))


def append_counts(counts: DataFrame, path: str, batch_id: int) -> None:
    """Write what one batch counted; writing a batch again replaces what it wrote before."""
    counts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_counts(spark: SparkSession, path: str, kind: tuple[list[str], str], before: int | None = None) -> DataFrame | None:
    """The sum over all batches, or those before ``before``; None when none is written."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return merged([stored if before is None else stored.where(F.col("batch_id") < before)], kind)


def compact_counts(spark: SparkSession, path: str, target: str, kind: tuple[list[str], str], before: int) -> None:
    """Copy the table to ``target`` with the batches before ``before`` summed into one, so that a sum reads few files."""
    append_counts(read_counts(spark, path, kind, before), target, before - 1)
    stored = spark.read.parquet(path)
    stored.where(F.col("batch_id") >= before).write.mode("append").partitionBy("batch_id").parquet(target)
