"""Finished enrichment results, one row per page key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.schemas import ENRICHMENT


def read_enrichment(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENRICHMENT).parquet(path)


def align_batches(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Results of a service that answers batches by position, as an enrichment table.

    ``requests`` is ``(batch, keys)`` and ``responses`` ``(batch, results)``, two arrays aligned by position. A batch
    whose counts differ, or that has no response, gives no rows: all its pages count as failed.
    """
    whole = requests.join(responses, "batch").where(F.size("keys") == F.size("results"))
    pairs = whole.select(F.explode(F.arrays_zip("keys", "results")).alias("pair"))
    return pairs.select(
        F.col("pair.keys").alias("key"), F.col("pair.results.entities"), F.col("pair.results.keyphrases")
    )
