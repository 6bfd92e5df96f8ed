"""Page-record sources: JSON or Parquet files, a file stream, and Kafka values."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.schemas import PAGE, Options

CORRUPT = "_corrupt_record"
_PAGE_OR_CORRUPT = T.StructType([*PAGE.fields, T.StructField(CORRUPT, T.StringType(), True)])


def _keyed(options: Options, order_type: T.DataType) -> T.StructType:
    """PAGE plus the key and order columns, for sources whose records carry them."""
    fields = [T.StructField(options.key, T.StringType()), T.StructField(options.order_by, order_type)]
    return T.StructType([*fields, *_PAGE_OR_CORRUPT.fields])


def read_pages_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON records; an undecodable one is a row with only ``_corrupt_record`` set."""
    reader = spark.read.schema(_PAGE_OR_CORRUPT).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", multi_line).json(path)


def read_pages_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).parquet(path)


def stream_pages_json(
    spark: SparkSession,
    path: str,
    options: Options = Options(),
    order_type: T.DataType | None = None,
    max_files_per_trigger: int = 1000,
) -> DataFrame:
    """A stream over a folder of JSON records; records without key or order get theirs when their batch is run.

    Nothing is refused when load is high: files wait, at most ``max_files_per_trigger`` are taken at once.
    """
    return (
        spark.readStream.schema(_keyed(options, order_type or T.LongType()))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(path)
    )


def stream_kafka(spark: SparkSession, servers: str, topic: str, max_offsets_per_trigger: int = 1_000_000) -> DataFrame:
    """Raw Kafka rows for ``pages_from_kafka``; needs Spark's Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_offsets_per_trigger)
        .load()
    )


def pages_from_kafka(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Decode Kafka values; the record's place in the topic is its key, its arrival time and place its order."""
    decoded = F.from_json(
        F.col("value").cast("string"), _PAGE_OR_CORRUPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    return rows.select(
        F.concat_ws("-", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")).alias(options.key),
        F.struct("timestamp", "partition", "offset").alias(options.order_by),
        decoded.alias("page"),
    ).select(options.key, options.order_by, "page.*")


def complete_keys(pages: DataFrame, batch_id: int, options: Options = Options()) -> DataFrame:
    """Give every record without a key or an order one from its place in the batch; a page is never lost for want of either.

    The place is only fixed once the result is written, so write it before it is read twice.
    """
    place = F.monotonically_increasing_id()
    made_up = F.concat(F.lit(f"batch-{batch_id}-"), place.cast("string"))
    key = F.coalesce(F.col(options.key), made_up) if options.key in pages.columns else made_up
    order = place
    if options.order_by in pages.columns:
        kind = pages.schema[options.order_by].dataType
        order = F.coalesce(F.col(options.order_by), place.cast(kind)) if isinstance(kind, T.NumericType) else F.col(options.order_by)
    return pages.withColumns({options.key: key, options.order_by: order})


def split_undecodable(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decoded pages, undecodable records).

    On a raw JSON file Spark refuses a query that reads nothing but the corrupt column, a bare count for one.
    """
    bad = F.col(CORRUPT).isNotNull()
    return pages.where(~bad).drop(CORRUPT), pages.where(bad).select("url", CORRUPT)


def assign_arrival(pages: DataFrame, options: Options = Options(), prefix: str | None = None) -> DataFrame:
    """Add key and order columns from the position in the input files, for records that have none.

    Call it directly on a file scan: positions are stable because the same files give the same splits on every attempt. Keys begin
    with ``prefix``; None makes one up, so that keys of different runs differ. The order is that of the scan, which packs files
    by size; records that carry an arrival time should be given that as order instead.
    """
    prefix = f"{uuid.uuid4().hex[:12]}-" if prefix is None else prefix
    position = F.monotonically_increasing_id()
    return pages.withColumn(options.order_by, position).withColumn(
        options.key, F.concat(F.lit(prefix), F.col(options.order_by).cast("string"))
    )
