"""Helpers shared by the operators: text in bounded slices, word hashes, hashed shingles, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.session import cut_lineage

#: Bytes of text that a task turns into words at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Words whose hash a task remembers.
CACHED_WORDS = 500_000
#: Ids that are broadcast at most: 8 bytes each.
BROADCAST_IDS = 1_000_000
#: Iterations after which the component search gives up; each at least halves the depth of every tree.
MAX_ROUNDS = 50

WORD_WEIGHT = np.uint64(0x9E3779B97F4A7C15)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", times: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``times`` ``SLICE_BYTES`` of ``column``, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + times * SLICE_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of every text; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, remembered; equal on every machine."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose every output bit depends on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words, in order; a shorter sequence is one run, an empty one none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    width = min(size, n)
    with np.errstate(over="ignore"):
        total = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            total = total * WORD_WEIGHT + words[k : n - width + 1 + k]
    return mix(total)


def hashed_sample(rows: DataFrame, by: str, most: int, n: int | None = None) -> DataFrame:
    """The ``most`` rows with the smallest hash of the column ``by``, the same whatever the partitioning; all rows if there are no more.

    Rows are counted (``n``, if known) and those beyond a threshold on the hash dropped where they lie, so tasks together send little
    more than the sample, however many they are. The threshold leaves six standard deviations of room.
    """
    n = rows.count() if n is None else n
    rows = rows.withColumn("_hash", F.xxhash64(by))
    share = most / max(n, 1) * (1 + 6 / max(most, 1) ** 0.5)
    if share < 1:
        rows = rows.where(F.col("_hash") < int(share * (1 << 64)) - (1 << 63))
    return (rows.orderBy("_hash", by).limit(most) if n > most else rows).drop("_hash")


def few_ids(ids: DataFrame) -> DataFrame:
    """``ids`` (a written table) marked for broadcast when its counted rows are within ``BROADCAST_IDS``; else joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)``: the smallest id reachable from every end of ``edges`` (columns ``a`` and ``b``).

    Alternates two steps until nothing changes: every node hands its smallest neighbour to its larger neighbours, then to its
    smaller ones. Each is a min per node and a join on the node; a node's neighbours are never gathered, so a node with very many
    neighbours is only many rows of a join. Every round is written to the shared folder. No edges give no rows.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = _fingerprint(edges)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("x"), F.col("b").alias("y")).union(small.select(F.col("m").alias("x"), F.col("a").alias("y")))
        edges = cut_lineage(small.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(
        edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    )
