"""A signature store that a batch probes by Bloom filters: only the files that may hold one of its signatures are read.

Signatures lie in runs. A batch writes one run, in as many hash buckets as its size asks for, so a small batch is one file; compaction
merges runs into one. Every bucket of a run has a Bloom filter, cut into chunks of 4,096 bits and built by bit_or over its
signatures. A batch's signatures meet the chunks, about two bytes for each stored signature, and what a filter lets through meets the
stored signatures of those buckets alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.schemas import SIGNATURES
from pagesieve.session import broadcast_within, cut_lineage

#: Signatures of a bucket, and of a chunk of a filter, at most on average; both numbers of parts are powers of two.
BUCKET_ROWS, CHUNK_ROWS = 1_000_000, 256
#: A chunk has so many words of 64 bits; a signature sets so many bits in it. At 256 signatures, 0.2 % of others pass.
WORDS, HASHES = 64, 7
#: Candidate rows (a signature and its place) that are broadcast at most.
BROADCAST_ROWS = 500_000

RUN = "first long, last long, rows long, buckets int, chunks int"


def _parts(rows: int, each: int) -> int:
    return 1 << max(0, -(-rows // each) - 1).bit_length()


def bucket_of(buckets: Column | int) -> Column:
    return F.pmod(F.xxhash64("sig"), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")


def chunk_of(chunks: Column | int) -> Column:
    return F.pmod(F.xxhash64("sig", F.lit("chunk")), F.lit(chunks) if isinstance(chunks, int) else chunks).cast("int")


def _bits() -> Column:
    """The bits of its chunk that a signature sets."""
    return F.array(*[F.pmod(F.xxhash64("sig", F.lit(i)), F.lit(64 * WORDS)).cast("int") for i in range(HASHES)])


def build_filters(signatures: DataFrame, buckets: int, chunks: int) -> DataFrame:
    """``(bucket, chunk, words)`` of the distinct signatures; bits are combined before the shuffle."""
    placed = signatures.select(bucket_of(buckets).alias("bucket"), chunk_of(chunks).alias("chunk"), F.explode(_bits()).alias("bit"))
    word, bit = (F.col("bit") / 64).cast("int"), F.pmod("bit", F.lit(64))
    words = placed.groupBy("bucket", "chunk", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pmod(bit, 64))")).alias("bits"))
    by_word = F.map_from_entries(F.collect_list(F.struct("word", "bits")))  # at most WORDS entries
    filled = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.col("found")[i], F.lit(0).cast("long")))
    return words.groupBy("bucket", "chunk").agg(by_word.alias("found")).select("bucket", "chunk", filled.alias("words"))


def _all_set() -> Column:
    """Whether ``words`` has every bit of ``bits``."""
    return F.expr("forall(bits, b -> (shiftrightunsigned(words[cast(b / 64 AS int)], pmod(b, 64)) & 1L) = 1L)")


@dataclass(frozen=True)
class SignatureStore:
    """The store below ``root``: ``data/run=`` by bucket, ``filters/run=`` and, written last, ``runs/run=`` with one row for each run."""

    spark: SparkSession
    root: str

    def runs(self, before: int | None = None) -> list:
        """The runs that count, those of batches before ``before``: one inside a wider one has been merged into it."""
        try:
            rows = self.spark.read.schema(f"{RUN}, run string").json(f"{self.root}/runs").collect()  # compaction keeps them few
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        rows = [r for r in rows if before is None or r.last < before]
        return [r for r in rows if not any(o != r and o.first <= r.first and r.last <= o.last for o in rows)]

    def read(self, before: int | None = None) -> DataFrame:
        """``(sig, key, batch_id)`` of all signatures."""
        runs = self.runs(before)
        if not runs:
            return self.spark.createDataFrame([], SIGNATURES)
        return self._stored([f"{self.root}/data/run={r.run}" for r in runs])

    def _stored(self, paths: list[str]) -> DataFrame:
        read = self.spark.read.schema(SIGNATURES).option("basePath", f"{self.root}/data").parquet(*paths)
        return read.select(SIGNATURES.fieldNames())

    def _write(self, rows: DataFrame, first: int, last: int, n: int) -> None:
        buckets = _parts(n, BUCKET_ROWS)
        chunks = _parts(n // buckets, CHUNK_ROWS)
        run = f"{first}-{last}"
        placed = rows.withColumn("bucket", bucket_of(buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "sig")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/run={run}")
        build_filters(rows, buckets, chunks).write.mode("overwrite").parquet(f"{self.root}/filters/run={run}")
        facts = {"first": first, "last": last, "rows": n, "buckets": buckets, "chunks": chunks}
        entry = self.spark.range(0, 1, 1, 1).select(*[F.lit(value).alias(name) for name, value in facts.items()])
        entry.write.mode("overwrite").json(f"{self.root}/runs/run={run}")

    def append(self, new: DataFrame, batch_id: int, rows: int | None = None) -> None:
        """Write the ``(sig, key)`` rows of one batch as a run; writing a batch again replaces its run.

        ``new`` should be a written table; ``rows`` is how many it has, where that is known.
        """
        signed = new.select("sig", "key", F.lit(batch_id).cast("long").alias("batch_id"))
        self._write(signed, batch_id, batch_id, new.count() if rows is None else rows)

    def compact(self, before: int) -> None:
        """Merge the runs of batches before ``before``, each signature once with its first batch and key.

        The merged run counts from when its entry is written; the runs within it are then read by nobody who starts later. Only
        merge batches that will not be run again.
        """
        runs = self.runs(before)
        if len(runs) < 2:
            return
        first = F.min(F.struct("batch_id", "key")).alias("first")
        merged = self.read(before).groupBy("sig").agg(first).select("sig", "first.key", "first.batch_id")
        merged = cut_lineage(merged)
        self._write(merged, min(r.first for r in runs), max(r.last for r in runs), merged.count())

    def candidates(self, signatures: DataFrame, before: int | None = None) -> DataFrame:
        """``(sig, run, bucket)``: where the distinct ``signatures`` may be stored, by the filters alone."""
        shapes: dict[tuple[int, int], list[str]] = {}
        for r in self.runs(before):
            shapes.setdefault((r.buckets, r.chunks), []).append(r.run)
        found = self.spark.createDataFrame([], "sig string, run string, bucket int")
        for (buckets, chunks), runs in shapes.items():  # powers of two: few shapes, whatever the number of runs
            paths = [f"{self.root}/filters/run={run}" for run in runs]
            read = self.spark.read.schema("bucket int, chunk int, words array<long>, run string").option("basePath", f"{self.root}/filters")
            asked = signatures.select("sig", bucket_of(buckets).alias("bucket"), chunk_of(chunks).alias("chunk"), _bits().alias("bits"))
            met = asked.join(read.parquet(*paths), ["bucket", "chunk"]).where(_all_set())
            found = found.union(met.select("sig", "run", "bucket"))
        return found

    def held(self, signatures: DataFrame, before: int | None = None) -> DataFrame:
        """Those of the distinct ``signatures`` (a ``sig`` column) that the store holds; reads only buckets that may hold one."""
        near = cut_lineage(self.candidates(signatures.select("sig"), before))
        places = near.select("run", "bucket").distinct().collect()  # a row for each file that has to be read
        if not places:
            return self.spark.createDataFrame([], "sig string")
        paths = [f"{self.root}/data/run={p.run}/bucket={p.bucket}" for p in places]
        stored = self._stored(paths).select("sig")
        return stored.join(broadcast_within(near.select("sig").distinct(), BROADCAST_ROWS), "sig", "left_semi").distinct()
