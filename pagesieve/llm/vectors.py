"""Embedding near-duplicates: product quantisation over coarse inverted lists, table-lookup distances, exact cosine rerank."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import connected_components, hashed_sample
from pagesieve.session import cut_lineage

#: Rows that the quantisers are fitted on, chosen by the hash of the id; every row is indexed.
SAMPLE_ROWS = 8192
#: Rows of either side that one task compares at a time; larger lists are split.
BLOCK_ROWS = 4096
SUBSPACES, CODEWORDS = 8, 64
#: Slack of the bounds, for rounding.
SLACK = 1e-5


@dataclass(frozen=True)
class Index:
    """Unit centroids of the inverted lists, and for each subspace the codewords of the residuals."""

    centroids: np.ndarray
    codewords: list[np.ndarray]
    cuts: list[slice]

    def own_list(self, unit: np.ndarray) -> np.ndarray:
        return np.argmax(unit @ self.centroids.T, axis=1)

    def probes(self, unit: np.ndarray, reach: float) -> np.ndarray:
        """Which lists can hold a vector within ``reach``: those whose border to the own list is no farther away.

        The set of points nearer to one centroid than to another is a half-space, so this is exact: no link is lost.
        """
        near = unit @ self.centroids.T
        own = np.argmax(near, axis=1)
        gap = np.sqrt(np.maximum(2 - 2 * self.centroids @ self.centroids.T, 0))
        return near[np.arange(len(unit)), own][:, None] - near <= (reach + SLACK) * gap[own] + SLACK

    def codes(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest codeword in every subspace, and how far the residual is from what they stand for."""
        codes = np.empty((len(residual), len(self.cuts)), np.uint8)
        error = np.zeros(len(residual))
        for m, cut in enumerate(self.cuts):
            far = ((residual[:, None, cut] - self.codewords[m][None]) ** 2).sum(2)
            codes[:, m] = far.argmin(1)
            error += far.min(1)
        return codes, np.sqrt(error)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances: exact queries (rows) against coded vectors (columns), by table look-up."""
        total = np.zeros((len(residual), len(codes)), np.float32)
        for m, cut in enumerate(self.cuts):
            table = ((residual[:, None, cut] - self.codewords[m][None]) ** 2).sum(2).astype(np.float32)
            total += table[:, codes[:, m]]
        return np.sqrt(total)


def k_means(points: np.ndarray, k: int, rounds: int = 8, unit: bool = False) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; a centre that loses all its points stays where it was."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmax(points @ centres.T - (0 if unit else 0.5 * (centres**2).sum(1)), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(sample: np.ndarray, lists: int) -> Index:
    """``sample``: distinct unit rows."""
    centroids = np.unique(k_means(sample, min(lists, len(sample)), unit=True), axis=0)
    residual = sample - centroids[np.argmax(sample @ centroids.T, axis=1)]
    width = -(-sample.shape[1] // SUBSPACES)
    cuts = [slice(a, min(a + width, sample.shape[1])) for a in range(0, sample.shape[1], width)]
    return Index(centroids, [k_means(np.ascontiguousarray(residual[:, c]), min(CODEWORDS, len(sample))) for c in cuts], cuts)


def unit_rows(vectors: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def pack_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; null where nothing can be linked: null, empty, zero, or null or non-finite components."""
    for batch in batches:
        packed = []
        for row in batch.column("embedding").to_pylist():
            x = np.array([np.nan if v is None else v for v in row or ()], np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                good = len(x) and np.isfinite(x).all() and x.any()
                # A power of two keeps every bit of the components and their squares in range.
                x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) if good else x
            packed.append(x.tobytes() if good else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(packed, pa.binary())], ["vec_id", "label", "vector"]
        )


ENTRY = "rep long, label string, dims int, copies long, vector binary, list int, stored boolean"


def place(index: dict[int, Index], reach: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each vector once as stored in its own list, and as a query to its own list and to all later lists in reach.

    A pair of lists is met once, from the earlier to the later one: the bound holds from either side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)):
                frame = batch.to_pandas()
                for dims, group in frame.groupby("dims"):
                    unit = unit_rows(list(group["vector"]))
                    own, probes = index[dims].own_list(unit), index[dims].probes(unit, reach)
                    probes &= np.arange(probes.shape[1]) >= own[:, None]
                    row, target = np.nonzero(probes)
                    row, target = np.append(np.arange(len(group)), row), np.append(own, target)
                    out = group.iloc[row].assign(list=target, stored=np.arange(len(row)) < len(group))
                    yield pa.RecordBatch.from_pandas(
                        out[["rep", "label", "dims", "copies", "vector", "list", "stored"]], preserve_index=False,
                        schema=pa.schema([("rep", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("copies", pa.int64()),
                                          ("vector", pa.binary()), ("list", pa.int32()), ("stored", pa.bool_())]),
                    )

    return run


LINKED = "rep long, n long, root long"


def compare(index: dict[int, Index], least: float, reach: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Within one block of queries and one of stored vectors: link counts, and for each linked vector its group's smallest id here."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        stored, queries = group[group["stored"]], group[~group["stored"]]
        if stored.empty or queries.empty:
            return pd.DataFrame({"rep": [], "n": [], "root": []}, dtype=np.int64)
        own = index[int(group["dims"].iat[0])]
        number = int(group["list"].iat[0])
        centroid = own.centroids[number]
        unit = unit_rows(list(stored["vector"]))
        codes, error = own.codes(unit - centroid)
        ids, copies = stored["rep"].to_numpy(), stored["copies"].to_numpy()
        query_ids, query_copies = queries["rep"].to_numpy(), queries["copies"].to_numpy()
        query_unit = unit_rows(list(queries["vector"]))
        inside = own.own_list(query_unit) == number  # a pair of one list is met from both sides: count it from the smaller id
        counts: dict[int, int] = {}
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for start in range(0, len(queries), 256):
            part = slice(start, start + 256)
            # The true distance is at least the table's less the coding error, so this drops no link.
            row, column = np.nonzero(own.distances(query_unit[part] - centroid, codes) <= reach + error + 1e-3)
            same = inside[part][row]
            keep = np.where(same, query_ids[part][row] < ids[column], query_ids[part][row] != ids[column])
            row, column = row[keep] + start, column[keep]
            for chunk in range(0, len(row), 1 << 16):
                r, c = row[chunk : chunk + (1 << 16)], column[chunk : chunk + (1 << 16)]
                good = np.einsum("ij,ij->i", query_unit[r], unit[c]) >= least
                r, c = r[good], c[good]
                for keys, weights in ((query_ids[r], copies[c]), (ids[c], query_copies[r])):
                    found, at = np.unique(keys, return_inverse=True)
                    for k, w in zip(found.tolist(), np.bincount(at, weights, len(found)).astype(np.int64).tolist()):
                        counts[k] = counts.get(k, 0) + w
                for a, b in zip(query_ids[r].tolist(), ids[c].tolist()):
                    a, b = find(a), find(b)
                    if a != b:
                        root[max(a, b)] = min(a, b)
        return pd.DataFrame({"rep": list(counts), "n": list(counts.values()), "root": [find(k) for k in counts]}, dtype=np.int64)

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors`` (``vec_id``, ``embedding``, ``label``; others ignored).

    Vectors of equal, non-null labels are linked when their cosine, in double precision, is at least ``least``. ``n_links`` counts
    the other rows linked directly, ``component_id`` is the smallest vec_id reachable, ``kept`` whether that is the row's own.

    Equal vectors of a label are one class, so a vector that a third of all rows repeat is compared once and its copies are only
    counted. The quantisers are fitted on at most 8,192 classes; every class is indexed. Lists are probed as far as the half-space
    bound reaches, and table distances are widened by each vector's coding error, so the search has full recall. Lists larger
    than a block are split on both sides. Tasks return one row per linked vector, not pairs.

    A row with a null label or a vector that is null, empty, zero or holds null or non-finite components has no link: n_links 0,
    its own component. Vectors of different lengths are not comparable and not linked. A repeated vec_id counts as another row; a
    null vec_id gives n_links 0, component null and kept true. An empty table gives no rows.
    """
    raw = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    packed = cut_lineage(raw.mapInArrow(pack_vectors, "vec_id long, label string, vector binary"))
    alone = F.col("label").isNull() | F.col("vector").isNull() | F.col("vec_id").isNull()
    usable = packed.where(~alone)
    classes = cut_lineage(
        usable.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("dims", (F.octet_length("vector") / 8).cast("int"))
    )
    # One class of lists for each length of vector; there are few, and a corpus normally has one.
    index, reach = {}, float(np.sqrt(2 - 2 * least))
    for row in classes.groupBy("dims").agg(F.count("*").alias("n")).collect():
        sample = hashed_sample(classes.where(F.col("dims") == row["dims"]), "rep", SAMPLE_ROWS, row["n"]).orderBy(F.xxhash64("rep")).select("vector")
        rows = unit_rows([bytes(r["vector"]) for r in sample.collect()])
        index[row["dims"]] = fit(rows, max(1, round(row["n"] ** 0.5 / 8)))
    entries = classes.select("rep", "label", "dims", "copies", "vector").mapInArrow(place(index, reach), ENTRY)
    key = ["label", "dims", "list"]
    sizes = entries.groupBy(*key).agg(F.count_if("stored").alias("n_stored"), F.count_if(~F.col("stored")).alias("n_queries"))
    blocks = sizes.select(
        *key, F.ceil(F.col("n_stored") / BLOCK_ROWS).cast("int").alias("stored_blocks"), F.ceil(F.col("n_queries") / BLOCK_ROWS).cast("int").alias("query_blocks")
    ).where("stored_blocks > 0 AND query_blocks > 0")
    dealt = entries.join(blocks, key)
    own = F.when(F.col("stored"), F.pmod(F.xxhash64("rep"), F.col("stored_blocks"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("query_blocks")))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("stored"), F.col("query_blocks")).otherwise(F.col("stored_blocks")) - 1))
    dealt = dealt.withColumn("own", own.cast("int")).withColumn("other", other)
    dealt = dealt.select(
        *key, "rep", "copies", "vector", "stored",
        F.when(F.col("stored"), F.col("own")).otherwise(F.col("other")).alias("stored_block"),
        F.when(F.col("stored"), F.col("other")).otherwise(F.col("own")).alias("query_block"),
    )
    linked = cut_lineage(dealt.groupBy(*key, "stored_block", "query_block").applyInPandas(compare(index, least, reach), LINKED))
    labels = connected_components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    counts = linked.groupBy("rep").agg(F.sum("n").alias("n"))
    placed = classes.join(counts, "rep", "left").join(labels, "rep", "left").select(
        "label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    found = usable.join(placed, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    rest = packed.where(alone).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
