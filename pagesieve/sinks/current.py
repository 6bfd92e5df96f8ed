"""The current document of every ``_id``, kept as a table in hash buckets, and the manifest that makes a batch's outputs visible.

A batch reads and rewrites only the buckets its ids fall into, under a folder of its own; the manifest, written last, says which
version of each bucket counts. A batch that was not committed is seen by no reader, and running it again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.operators.upsert import latest_per_id
from pagesieve.schemas import Options

COMMIT = "versions array<long>, counters map<string,long>, spam array<struct<bound: double, pages: long, n: long, score_sum: long>>"
#: The version of a bucket that no batch has written.
NEVER = -1


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("_id"), F.lit(buckets)).cast("int")


def _commits(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{COMMIT}, batch_id long").json(f"{root}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def last_commit(spark: SparkSession, root: str, before: int | None = None):
    """The manifest of the last committed batch (before batch ``before``), or None.

    Batches are committed in their order, so all up to this one count. ``versions`` has the batch that wrote each bucket.
    """
    rows = _commits(spark, root)
    if rows is None:
        return None
    rows = rows if before is None else rows.where(F.col("batch_id") < before)
    return rows.orderBy(F.desc("batch_id")).first()


def commit(
    spark: SparkSession, root: str, batch_id: int, versions: list[int], counters: dict[str, int] | None = None,
    spam: list[tuple[float, int, int, int]] = (),
) -> None:
    """Make all outputs of a batch visible at once: one small file, which also has what the batch counted."""
    pairs = [F.lit(x) for pair in (counters or {}).items() for x in (pair[0], int(pair[1]))]
    bounds = [F.struct(F.lit(b).alias("bound"), F.lit(p).alias("pages"), F.lit(n).alias("n"), F.lit(s).alias("score_sum")) for b, p, n, s in spam]
    row = spark.range(0, 1, 1, 1).select(
        F.array(*map(F.lit, versions)).alias("versions"), F.create_map(*pairs).alias("counters"), F.array(*bounds).alias("spam")
    )
    row.write.mode("overwrite").json(f"{root}/commits/batch_id={batch_id}")


def committed_counters(spark: SparkSession, root: str) -> DataFrame | None:
    """A row for every committed batch with its counters; None when nothing is committed."""
    rows, last = _commits(spark, root), last_commit(spark, root)
    if last is None:
        return None
    return rows.select("batch_id", *[F.col("counters")[name].alias(name) for name in last.counters])


def committed_spam_scores(spark: SparkSession, root: str) -> DataFrame | None:
    """``(batch_id, bound, pages, n, score_sum)``: the spam histogram of every committed batch."""
    rows = _commits(spark, root)
    return None if rows is None else rows.select("batch_id", F.explode("spam").alias("s")).select("batch_id", "s.*")


def read_committed(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """A batch table without the batches that are not committed; None when nothing is."""
    last = last_commit(spark, root)
    if last is None:
        return None
    written = spark.read.parquet(f"{root}/{table}")
    return written.where(F.col("batch_id") <= last.batch_id).withColumn("batch_id", F.col("batch_id").cast("long"))


def _paths(root: str, versions: list[int], buckets: set[int] | None = None) -> list[str]:
    return [f"{root}/current/batch_id={v}/bucket={b}" for b, v in enumerate(versions) if v != NEVER and (buckets is None or b in buckets)]


def current_documents(spark: SparkSession, root: str) -> DataFrame | None:
    """The upserted view as of the last committed batch: per ``_id`` the last document. No earlier batch is read for it."""
    last = last_commit(spark, root)
    paths = [] if last is None else _paths(root, last.versions)
    if not paths:
        return None
    schema = spark.read.parquet(paths[0]).schema
    return spark.read.schema(schema).parquet(*paths)


def upsert_current(documents: DataFrame, root: str, batch_id: int, buckets: int, options: Options = Options()) -> list[int]:
    """Merge a batch's documents into the buckets they fall into; returns the versions to commit.

    Of documents with one ``_id`` the latest batch's counts, within it the last in arrival order; so a batch run again, even on a
    state that holds it, changes nothing. The number of buckets is fixed by the first batch.
    """
    spark = documents.sparkSession
    last = last_commit(spark, root, before=batch_id)
    versions = list(last.versions) if last else [NEVER] * buckets
    incoming = documents.withColumn("version", F.lit(batch_id).cast("long")).withColumn("bucket", bucket_of(len(versions)))
    touched = {r.bucket for r in incoming.select("bucket").distinct().collect()}  # at most the number of buckets
    if not touched:
        return versions
    paths = _paths(root, versions, touched)
    merged = incoming
    if paths:
        kept = spark.read.schema(incoming.drop("bucket").schema).parquet(*paths).withColumn("bucket", bucket_of(len(versions)))
        merged = incoming.unionByName(kept)
    latest = latest_per_id(merged, options, version=["version", options.order_by, options.key])
    parts = min(len(touched), max(1, spark.sparkContext.defaultParallelism))
    latest.repartition(parts, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/current/batch_id={batch_id}")
    return [batch_id if b in touched else v for b, v in enumerate(versions)]
