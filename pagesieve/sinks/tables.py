"""Parquet tables of a run: documents and rejects, one folder per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.operators.upsert import latest_per_id
from pagesieve.schemas import Options


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch; writing it again replaces what it wrote before."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def latest_documents(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """The upserted view: per id the document of the latest batch, and within it the last in arrival order."""
    return latest_per_id(spark.read.parquet(path), options, version=["batch_id", options.order_by, options.key])


def rejected_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("long"))
