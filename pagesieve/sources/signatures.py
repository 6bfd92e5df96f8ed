"""The signature store: every signature ever claimed, with the page and the batch that claimed it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.schemas import SIGNATURES


def read_signatures(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The store, or only what batches before ``before`` added; a store not yet written is empty.

    ``batch_id`` is the partition column, so the restriction prunes folders.
    """
    try:
        stored = spark.read.schema(SIGNATURES).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SIGNATURES)
    return stored if before is None else stored.where(F.col("batch_id") < before)


def append_signatures(new: DataFrame, path: str, batch_id: int) -> None:
    """Write the ``(sig, key)`` rows of one batch; writing a batch again replaces what it wrote before."""
    new.select("sig", "key").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_signature_table(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """The store kept in a catalog table, restricted like ``read_signatures``; a table not yet made is empty."""
    if not spark.catalog.tableExists(table):
        return spark.createDataFrame([], SIGNATURES)
    stored = spark.table(table)
    return stored if before is None else stored.where(F.col("batch_id") < before)


def append_signature_table(new: DataFrame, table: str, batch_id: int, buckets: int) -> None:
    """The same in a catalog table with a partition per batch, bucketed by signature: later runs join it without shuffling the store.

    Writing a batch again replaces its partition. Make ``buckets`` no fewer than ``spark.sql.shuffle.partitions``, or Spark may choose
    to shuffle the store instead; the number is fixed when the table is first written.
    """
    spark, rows = new.sparkSession, new.select("sig", "key").repartition(buckets, "sig")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (sig STRING, key STRING, batch_id BIGINT) USING parquet "
        f"PARTITIONED BY (batch_id) CLUSTERED BY (sig) SORTED BY (sig) INTO {buckets:d} BUCKETS"
    )
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (batch_id = {batch_id:d}) SELECT sig, key FROM {{rows}}", rows=rows)


def _merged(stored: DataFrame, before: int) -> DataFrame:
    """Each signature of the batches before ``before`` once, with the key that claimed it first."""
    first = F.min(F.struct("batch_id", "key")).alias("first")
    return stored.where(F.col("batch_id") < before).groupBy("sig").agg(first).select("sig", "first.key")


def compact_signature_table(spark: SparkSession, table: str, target: str, before: int, buckets: int) -> None:
    """Copy a catalog table to ``target`` with the batches before ``before`` merged into one partition: a file for each bucket.

    Only merge batches that will not be replayed; point the next run at ``target``.
    """
    stored = read_signature_table(spark, table)
    append_signature_table(_merged(stored, before), target, before - 1, buckets)
    later = stored.where(F.col("batch_id") >= before)
    for row in later.select("batch_id").distinct().orderBy("batch_id").collect():  # the few batches since
        append_signature_table(later.where(F.col("batch_id") == row.batch_id), target, row.batch_id, buckets)


def compact_signatures(spark: SparkSession, path: str, target: str, before: int) -> None:
    """Copy the store to ``target`` with the batches before ``before`` merged into one folder, each signature once.

    Only merge batches that will not be replayed; point the next run at ``target``.
    """
    stored = read_signatures(spark, path)
    merged = _merged(stored, before)
    append_signatures(merged, target, before - 1)
    stored.where(F.col("batch_id") >= before).write.mode("append").partitionBy("batch_id").parquet(target)
