"""Near-duplicate documents: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import WordHashes, connected_components, few_ids, mix, shingle_hashes, slices, texts_of
from pagesieve.session import cut_lineage

SHINGLE_WORDS = 5
#: 32 bands of 6 bins: two texts of similarity 0.85 share no band with probability 3e-7, of 0.8 with 6e-5, of 0.95 with 1e-18.
BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
#: Lower ends of equal ranges of the hash values: the ranges are the bins, so one sorted set of hashes fills all of them.
EDGES = np.array([k * 2**64 // BINS for k in range(BINS)], np.uint64)

SIGNED = "doc_id long, n_shingles long, set_id binary, bands array<long>"
SETS = "doc_id long, shingles array<long>"


def document_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes: A-Z lower-cased, words parted by space, tab, line feed, vertical tab, form feed, return."""
    return np.unique(shingle_hashes(hashes.of(text.lower().split()), SHINGLE_WORDS))


def donors() -> np.ndarray:
    """For every bin, all bins in an order of its own: an empty bin copies the first filled one (optimal densification)."""
    with np.errstate(over="ignore"):
        order = mix(np.arange(BINS * BINS, dtype=np.uint64).reshape(BINS, BINS) + np.uint64(0xD1B54A32D192ED03))
    return np.argsort(order, axis=1)


def band_keys(shingles: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A 64-bit key per band for a sorted non-empty set: the smallest hash of each bin, empty bins filled, six bins a key."""
    first = np.searchsorted(shingles, EDGES)
    filled = np.append(first[1:], len(shingles)) > first
    source = np.arange(BINS)
    empty = np.flatnonzero(~filled)
    if len(empty):
        source[empty] = order[empty, np.argmax(filled[order[empty]], axis=1)]
    with np.errstate(over="ignore"):
        values = mix(shingles[first[source]] + np.arange(BINS, dtype=np.uint64)).reshape(BANDS, ROWS)
        key = np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            key = mix(key ^ values[:, k])
    return key


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, order = WordHashes(), donors()
    for batch in slices(batches):
        sizes, ids, keys = [], [], []
        for text in texts_of(batch):
            shingles = document_set(text, hashes)
            sizes.append(len(shingles))
            ids.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            keys.append(band_keys(shingles, order).view(np.int64) if len(shingles) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "set_id", "bands"],
        )


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches):
        sets = [document_set(text, hashes).view(np.int64) for text in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])


def alike(low, high, percent: int):
    """Whether sizes allow the similarity at all: the smaller set is the largest possible intersection, the larger the union."""
    return 100 * F.least(low, high) >= percent * F.greatest(low, high)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the similarity, written to the shared folder."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("left", "right")))
    links = both.where(100 * F.col("common") >= percent * (F.size("left") + F.size("right") - F.col("common")))
    return cut_lineage(links.select("a", "b"))


def cross_component_pairs(residual: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``residual`` (rep, n, component) in different components that can reach the similarity: none is missed.

    Sets of n shingles that are alike share one of their n - ceil(t n) + 1 rarest, and the first one they share leaves enough
    shingles behind it in either order to reach the overlap. What sets a copy apart is rare and comes first, so a copy with many
    changes of its own meets no other, however large its group; shingles of one component only are no key at all.
    """
    shingles = sets.join(residual.withColumnRenamed("rep", "doc_id"), "doc_id").select(
        F.col("doc_id").alias("rep"), "n", "component", F.explode("shingles").alias("shingle")
    )
    spread = shingles.groupBy("shingle").agg(F.count("*").alias("f"), (F.min("component") < F.max("component")).alias("mixed"))
    rarest = F.slice(F.sort_array(F.collect_list(F.struct("f", "shingle", "mixed"))), 1, F.expr(f"int(n - (n * {percent} + 99) div 100 + 1)"))
    keys = (
        shingles.join(spread, "shingle").groupBy("rep", "n", "component").agg(rarest.alias("rarest"))
        .select("rep", "n", "component", F.posexplode("rarest").alias("at", "r")).where("r.mixed")
        .select("rep", "component", "n", (F.col("n") - F.col("at")).alias("left"), "r.shingle")
    )
    other = keys.select("shingle", *[F.col(c).alias(f"b_{c}") for c in ("component", "n", "left")], F.col("rep").alias("b"))
    overlap = (100 + percent) * F.least("left", "b_left") >= percent * (F.col("n") + F.col("b_n"))
    met = keys.join(other, "shingle").where(
        (F.col("rep") < F.col("b")) & (F.col("component") != F.col("b_component")) & alike(F.col("n"), F.col("b_n"), percent) & overlap
    )
    return cut_lineage(met.select(F.col("rep").alias("a"), "b").distinct())


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs`` (needs ``doc_id`` and ``text``; other columns are ignored).

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of five-word shingles; a component's id is
    its smallest doc_id, and only that document is kept.

    Copies with equal sets are one class, represented by its smallest doc_id, so a text that a third of all rows repeat is one
    candidate. In each bucket every class is paired with two others only, the smallest and the most central one: stars. What stars
    can miss, a link between two members that both differ from the centre, is searched next among members of buckets that still
    hold several components. Both rounds confirm on full sets, recomputed from the texts of candidates only.

    Null, empty and blank texts have no shingles (n_shingles 0) and are linked with nothing. Repeated rows are each returned. A
    doc_id with several texts is one vertex, linked by any of them. A null doc_id gives component null and kept true. An empty
    table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut_lineage(docs.mapInArrow(sign, SIGNED))
    alone = F.col("set_id").isNull() | F.col("doc_id").isNull()
    classes = signed.where(~alone).groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    # One row of each class carries its bands: the one whose doc_id is the representative.
    bands = (
        signed.where(~alone).groupBy("set_id").agg(F.min_by(F.struct("doc_id", "n_shingles", "bands"), "doc_id").alias("r"))
        .select(F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), F.posexplode("r.bands").alias("band", "key"))
        .select("rep", "n", F.xxhash64("band", "key").alias("bucket"))
    )
    hubs = bands.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    members = cut_lineage(bands.join(hubs, "bucket").select("bucket", "rep", "n", "members", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")))
    # The second centre of a bucket is the member that meets most others in all its buckets: in a group of edited copies, the text
    # nearest to what they were copied from.
    density = members.groupBy("rep").agg(F.sum("members").alias("density"))
    dense = members.join(density, "rep").groupBy("bucket").agg(F.max(F.struct("density", (-F.col("rep")).alias("rep"), "n")).alias("hub"))
    stars = members.select("rep", "n", "hub", "hub_n").union(
        members.join(dense.select("bucket", (-F.col("hub.rep")).alias("dense"), F.col("hub.n").alias("dense_n")), "bucket").select("rep", "n", "dense", "dense_n")
    )
    stars = cut_lineage(
        stars.where((F.col("rep") != F.col("hub")) & alike(F.col("n"), F.col("hub_n"), percent))
        .select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    )
    ids = cut_lineage(members.select(F.col("rep").alias("doc_id")).distinct())
    sets = cut_lineage(docs.join(few_ids(ids), "doc_id", "left_semi").mapInArrow(shingle_sets, SETS))
    links = verified(stars, sets, percent)
    labels = cut_lineage(connected_components(links))

    placed = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = cut_lineage(placed.select("bucket", "rep", "n", "component"))
    parted = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    residual = cut_lineage(placed.join(parted, "bucket", "left_semi").select("rep", "n", "component").distinct())
    rest = cross_component_pairs(residual, sets, percent)
    if not rest.isEmpty():
        labels = cut_lineage(connected_components(links.union(verified(rest, sets, percent))))

    labels = labels.withColumnRenamed("id", "rep")
    placed = classes.join(labels, "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component_id"))
    found = signed.drop("bands").join(placed, "set_id", "left")
    component = F.when(F.col("set_id").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
