"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated by temperature."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import CACHED_WORDS, hashed_sample, mix, slices
from pagesieve.session import cut_lineage

#: Word vectors: words share this many rows by their hash, so that the table is of one size whatever the corpus.
BUCKETS, DIMS = 8192, 32
#: Words to either side that make up a word's context.
REACH = 2
#: Labelled documents that the network is fitted on at most, chosen by the hash of their id.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 48, 60, 256, 3e-3, 1e-4
#: The part of the labelled rows that is kept for the temperature, and from which score on a document counts as good.
CALIBRATION_PART, GOOD = 0.2, 0.7
#: Weight of a frequent word against a rare one when vectors are pooled.
SMOOTH = 1e-3

#: Words, and runs of anything else that is not white space: what junk is made of stays visible.
TOKEN = re.compile(r"\w+|[^\w\s]+")
PROFILE = 10
#: Tokens whose contexts are summed at a time.
CHUNK = 1 << 17
UPPER = bytes(range(0x41, 0x5B))


class TokenRows(dict):
    """The row of the vector table of each token: letters in one case, with a mark for capitals."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        shape = 2 if len(token) > 1 and token.isupper() else 0
        value = self[token] = (xxhash.xxh3_64_intdigest(token.lower()) + shape) % BUCKETS
        return value

    def of(self, text: str) -> np.ndarray:
        tokens = TOKEN.findall(text)
        return np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))


def index_vectors() -> np.ndarray:
    """The random index of each row: entries -1, 0 and 1, a quarter of them not 0, equal on every machine."""
    draw = mix(np.arange(BUCKETS * DIMS, dtype=np.uint64) + np.uint64(0xA5A5A5A5)) % np.uint64(8)
    return np.where(draw == 0, 1, np.where(draw == 1, -1, 0)).astype(np.int8).reshape(BUCKETS, DIMS)


VECTOR_ROWS = "word int, n long, " + ", ".join(f"d{k} long" for k in range(DIMS))


def count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's sums: for every row of the table how often it occurs, and the sum of the random indexes of its neighbours."""
    rows, index = TokenRows(), np.vstack([index_vectors(), np.zeros((1, DIMS), np.int8)])
    seen, sums = np.zeros(BUCKETS, np.int64), np.zeros((BUCKETS, DIMS), np.int64)
    gap = np.full(REACH, BUCKETS, np.int16)  # between texts; its index is zero
    for batch in slices(batches):
        tokens = np.concatenate([gap, *(x for text in batch.column("text").to_pylist() for x in (rows.of(text or "").astype(np.int16), gap))])
        for start in range(REACH, len(tokens) - REACH, CHUNK):
            stop = min(start + CHUNK, len(tokens) - REACH)
            words, context = tokens[start:stop], np.zeros((stop - start, DIMS), np.int8)
            for k in range(1, REACH + 1):
                context += index[tokens[start - k : stop - k]]
                context += index[tokens[start + k : stop + k]]
            order = np.argsort(words, kind="stable")
            words = words[order]
            cuts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            real = words[cuts] < BUCKETS
            sums[words[cuts][real]] += np.add.reduceat(context[order].astype(np.int32), cuts, axis=0)[real]
            seen[words[cuts][real]] += np.diff(np.append(cuts, len(words)))[real]
    used = np.flatnonzero(seen)
    columns = [pa.array(used, pa.int32()), pa.array(seen[used], pa.int64()), *(pa.array(sums[used, k], pa.int64()) for k in range(DIMS))]
    yield pa.RecordBatch.from_arrays(columns, ["word", "n", *(f"d{k}" for k in range(DIMS))])


@dataclass(frozen=True)
class WordVectors:
    vectors: np.ndarray  # unit rows, one for each bucket
    weights: np.ndarray  # of a token when pooled


def word_vectors(docs: DataFrame) -> WordVectors:
    """Random indexing over all documents. The sums of all tasks are added by a group-by; the table that comes back has one size."""
    partial = docs.select("text").mapInArrow(count_contexts, VECTOR_ROWS)
    total = partial.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIMS)])
    counts, sums = np.zeros(BUCKETS), np.zeros((BUCKETS, DIMS))
    for row in cut_lineage(total).toLocalIterator():
        counts[row[0]], sums[row[0]] = row[1], row[2:]
    vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return WordVectors(vectors.astype(np.float32), (SMOOTH / (SMOOTH + counts / max(counts.sum(), 1))).astype(np.float32))


def pool(rows: np.ndarray, text: str, table: WordVectors) -> np.ndarray:
    """Weighted mean and spread of the token vectors, plain mean, and how the tokens follow and repeat one another."""
    if not len(rows):
        return np.zeros(3 * DIMS + PROFILE, np.float32)
    n, vectors, weights = len(rows), table.vectors[rows], table.weights[rows]
    weights /= weights.sum()
    mean, plain = np.stack([weights, np.full(n, 1 / n, np.float32)]) @ vectors
    spread = np.sqrt(np.maximum(weights @ (vectors * vectors) - mean**2, 0))
    following = np.einsum("ij,ij->i", vectors[1:], vectors[:-1]) if n > 1 else np.zeros(1, np.float32)
    pairs = np.sort(rows[1:] * np.int32(BUCKETS) + rows[:-1])
    counts, letters = np.bincount(rows), text.encode()
    profile = [
        np.log1p(n) / 10, np.count_nonzero(counts) / n, counts.max() / n, following.mean(), following.std(),
        (np.count_nonzero(pairs[1:] != pairs[:-1]) + 1) / n, float((rows[1:] == rows[:-1]).mean()) if n > 1 else 0.0,
        float(np.linalg.norm(mean)), n / max(len(text), 1) * 4, 1 - len(letters.translate(None, UPPER)) / max(len(letters), 1),
    ]
    return np.concatenate([mean, spread, plain, np.array(profile, np.float32)]).astype(np.float32)


def pooled(table: WordVectors) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = TokenRows()
        for batch in slices(batches):
            features = [pool(rows.of(t or ""), t or "", table).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(features, pa.binary())], ["doc_id", "features"])

    return run


@dataclass(frozen=True)
class Network:
    """Two layers with a temperature; features are scaled first. Without both labels to learn from, a constant."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def log_loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit_network(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the cross-entropy, from a fixed start and in a fixed order; then the temperature on rows kept back for it."""
    width = x.shape[1] if x.ndim == 2 else 3 * DIMS + PROFILE
    if len(y) == 0 or y.min() == y.max():
        logit = 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), logit)
    random = np.random.default_rng(7)
    order = random.permutation(len(y))
    back, kept = order[: int(len(y) * CALIBRATION_PART)], order[int(len(y) * CALIBRATION_PART) :]
    centre, scale = x[kept].mean(0), x[kept].std(0) + 1e-3
    z, t = ((x[kept] - centre) / scale).astype(np.float32), y[kept].astype(np.float32)
    parameters = [
        (random.standard_normal((width, HIDDEN)) / np.sqrt(width)).astype(np.float32), np.zeros(HIDDEN, np.float32),
        (random.standard_normal(HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32), np.zeros(1, np.float32),
    ]
    first, second, step = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
    for _ in range(EPOCHS):
        shuffled = random.permutation(len(t))
        for start in range(0, len(t), BATCH):
            rows = shuffled[start : start + BATCH]
            w1, b1, w2, b2 = parameters
            hidden = np.tanh(z[rows] @ w1 + b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -60, 60))) - t[rows]) / len(rows)
            inner = np.outer(error, w2) * (1 - hidden**2)
            gradients = [z[rows].T @ inner + DECAY * w1, inner.sum(0), hidden.T @ error + DECAY * w2, error.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(gradients):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                parameters[k] = parameters[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    w1, b1, w2, b2 = parameters
    network = Network(centre, scale, w1, b1, w2, float(b2[0]))
    if not len(back):
        return network
    # Targets a little inside 0 and 1, as many rows allow: where no row is wrong the temperature would fall without end.
    logits, good = network.logits(x[back]), y[back].sum()
    targets = np.where(y[back] == 1, (good + 1) / (good + 2), 1 / (len(back) - good + 2))
    best = min(np.geomspace(0.25, 8, 61), key=lambda temperature: log_loss(logits / temperature, targets))
    return Network(centre, scale, w1, b1, w2, float(b2[0]), float(best))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(network: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("features").to_pylist()), np.float32).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(network.scores(x).astype(np.float64), pa.float64())], ["doc_id", "score"]
            )

    return run


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``quality`` (1 good, 0 not); other columns are ignored, and only
    the text is an input. Word vectors are summed over all documents, the network is fitted on at most ``train_rows`` labelled
    documents outside the held-out quarter. Texts are read twice and never shuffled; what is joined to labels are short vectors.

    Null and empty texts are pooled to zeros and get the network's score for them. Labels other than 0 and 1, and labels of a
    null doc_id, are ignored; of several labels of a document the largest counts. Repeated rows are each scored, alike. Without
    labels of both kinds every score is one constant (0.5 without any). An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = word_vectors(docs)
    features = cut_lineage(docs.mapInArrow(pooled(table), "doc_id long, features binary"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    examples = hashed_sample(features.join(known, "doc_id"), "doc_id", train_rows).orderBy(F.xxhash64("doc_id"), "doc_id").select("features", "quality").collect()
    x = np.array([np.frombuffer(bytes(r["features"]), np.float32) for r in examples], np.float32)
    network = fit_network(x, np.array([r["quality"] for r in examples], np.float64))
    result = features.mapInArrow(scored(network), "doc_id long, score double")
    return result.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
