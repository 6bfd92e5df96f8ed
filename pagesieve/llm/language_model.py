"""Language-model scoring: cross-entropy difference between a target and a background n-gram model of one vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import WORD_WEIGHT, few_ids, mix, slices
from pagesieve.llm.quality import TOKEN
from pagesieve.session import cut_lineage

#: Weight of the bigram against the unigram estimate where the first token has been seen.
BIGRAM_WEIGHT = 0.75
#: What is counted: pairs of successive tokens, tokens with one behind them, tokens. The two low bits of a key say which.
PAIR, FIRST, WORD = 0, 1, 2
#: Keys are dealt to so many buckets at least; to more where a bucket would hold more than ``BUCKET_KEYS`` keys of all blocks.
LEAST_BUCKETS, BUCKET_KEYS = 64, 8_000_000

#: Slices of text in a block: the larger it is, the fewer keys two blocks have in common, each of which is sent once for either.
BLOCK_SLICES = 2

BLOCKS = "block long, doc_ids array<long>, sizes array<int>, targets array<boolean>, tokens binary, hashes binary, n_tokens long, n_target long, n_keys long"
ASKED = "block long, bucket int, keys binary, n binary, n_target binary"
ANSWERED = "block long, bucket int, n binary, n_target binary, n_words long"
LOSSES = "doc_id long, n_tokens long, target_loss double, background_loss double"


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def rows_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def squeezed(data: bytes) -> bytes:
    """The length, and the data compressed: its bytes have few values, so it takes far less room in shuffles and tables."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def restored(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def packed(counts: np.ndarray) -> bytes:
    """A byte for each count; those from 255 on follow in full."""
    return squeezed(np.minimum(counts, 255).astype("u1").tobytes() + counts[counts >= 255].astype("<i8").tobytes())


def unpacked(data: bytes, size: int) -> np.ndarray:
    data = restored(data)
    counts = np.frombuffer(data, "u1", size).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=size)
    return counts


def planes(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers, first all their low bytes, then the next: the high ones are nearly all 0 and take no room when compressed."""
    return squeezed(numbers.astype(kind).view("u1").reshape(-1, np.dtype(kind).itemsize).T.tobytes())


def from_planes(data: bytes, kind: str = "<u4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(restored(data), "u1").reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def gaps(keys: np.ndarray) -> bytes:
    """Rising keys as the steps between them: the more keys, the fewer bytes a step has."""
    return planes(np.diff(keys, prepend=np.uint64(0)), "<u8")


def from_gaps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "<u8"), dtype=np.uint64)


def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each slice of documents: every token as its number within the slice, and the hashes of these numbers; 0 is the start."""
    block = TaskContext.get().partitionId() << 33
    for batch in slices(batches, times=BLOCK_SLICES):
        numbers: dict[str, int] = {}
        tokens = [np.fromiter((numbers.setdefault(t, len(numbers) + 1) for t in x), "<u4", len(x)) for x in map(tokens_of, batch.column("text").to_pylist())]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in numbers), "<u8", len(numbers))
        targets = [bool(t) for t in batch.column("target").to_pylist()]
        sizes = [len(x) for x in tokens]
        n, n_target = sum(sizes), sum(s for s, t in zip(sizes, targets) if t)
        data = planes(np.concatenate([*tokens, np.empty(0, "<u4")])), np.append(np.uint64(0), hashes).astype("<u8").tobytes()
        yield rows_of([(block, batch.column("doc_id").to_pylist(), sizes, targets, *data, n, n_target, n + 2 * len(numbers))], BLOCKS)
        block += 1


class Block:
    """What one block counts: its distinct keys in an order that only the block decides, and where each position's keys are."""

    def __init__(self, sizes: list[int], tokens: bytes, hashes: bytes):
        self.sizes = np.array(sizes, np.int64)
        after, hashes = from_planes(tokens).astype(np.int64), np.frombuffer(hashes, "<u8")
        before = np.append(0, after[:-1]) if len(after) else after
        before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = 0
        pairs, self.pair = np.unique(before * len(hashes) + after, return_inverse=True)
        firsts, self.first = np.unique(before, return_inverse=True)
        words, self.word = np.unique(after, return_inverse=True)
        a, b = pairs // len(hashes), pairs % len(hashes)
        with np.errstate(over="ignore"):
            made = [mix(mix(hashes[a]) * WORD_WEIGHT + hashes[b]), mix(hashes[firsts] + np.uint64(1)), mix(hashes[words])]
        self.keys = np.concatenate([(x & ~np.uint64(3)) | np.uint64(kind) for kind, x in zip((PAIR, FIRST, WORD), made)])
        self.ends = np.cumsum([len(x) for x in made])
        self.first_of, self.word_of = np.searchsorted(firsts, a), np.searchsorted(words, b)

    def counts(self, weights: np.ndarray | None = None) -> np.ndarray:
        """How often each key occurs, or only at positions of weight 1."""
        parts = ((self.pair, self.ends[0]), (self.first, self.ends[1] - self.ends[0]), (self.word, self.ends[2] - self.ends[1]))
        return np.concatenate([np.bincount(at, weights, n) for at, n in parts]).astype(np.int64)

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The rising order of the keys, and where each bucket, a range of equal size, begins and ends in it."""
        bucket = ((self.keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        return np.argsort(self.keys, kind="stable"), np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))

    def losses(self, n: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
        """Each document's sum of losses by a model whose counts of the keys are ``n``: bigram estimates, mixed with unigram
        estimates to which one observation of each token is added."""
        pair, first, word = np.split(n, self.ends[:-1])
        first, word = first[self.first_of], (word[self.word_of] + 1.0) / (total + vocabulary)
        weight = np.where(first > 0, BIGRAM_WEIGHT, 0.0)
        each = -np.log(weight * pair / np.maximum(first, 1) + (1 - weight) * word)
        return np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes), each[self.pair], len(self.sizes))


def ask(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The keys of each block and its own counts of them, a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = Block(row["sizes"], row["tokens"], row["hashes"])
                n, n_target = block.counts(), block.counts(np.repeat(np.array(row["targets"], float), block.sizes))
                order, at = block.by_bucket(buckets)
                parts = ((p, order[at[p] : at[p + 1]]) for p in range(buckets) if at[p] < at[p + 1])
                rows = [(row["block"], p, gaps(block.keys[x]), packed(n[x]), packed(n_target[x])) for p, x in parts]
                yield rows_of(rows, ASKED)

    return run


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts over all blocks, to each block in its own order; and with block -1 how many tokens the bucket has. Rows come by bucket."""

    def answered(bucket: int, asked: list[tuple]) -> pa.RecordBatch:
        own_keys = [from_gaps(x[1]) for x in asked]
        sizes = [len(x) for x in own_keys]
        keys, at = np.unique(np.concatenate(own_keys), return_inverse=True)
        ends, counts = np.cumsum(sizes)[:-1], []
        for k in (2, 3):
            own = np.concatenate([unpacked(x[k], size) for x, size in zip(asked, sizes)])
            counts.append(np.split(np.bincount(at, own, len(keys)).astype(np.int64)[at], ends))
        rows = [(x[0], bucket, packed(n), packed(t), None) for x, n, t in zip(asked, *counts)]
        return rows_of([*rows, (-1, bucket, None, None, int(((keys & np.uint64(3)) == WORD).sum()))], ANSWERED)

    bucket, asked = None, []
    for batch in batches:
        for block, which, keys, n, n_target in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "keys", "n", "n_target"))):
            if which != bucket and asked:
                yield answered(bucket, asked)
                asked = []
            bucket = which
            asked.append((block, keys, n, n_target))
    if asked:
        yield answered(bucket, asked)


def score(buckets: int, totals: tuple[int, int], vocabulary: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Losses of each block's documents. Rows come by block, the block itself (bucket -1) before its answers."""

    def scored(row: dict, answers: dict[int, tuple[bytes, bytes]]) -> pa.RecordBatch:
        block = Block(row["sizes"], row["tokens"], row["hashes"])
        order, at = block.by_bucket(buckets)
        sums = []
        for k in (1, 0):
            n = np.empty(len(order), np.int64)
            for p in np.flatnonzero(np.diff(at)):
                n[order[at[p] : at[p + 1]]] = unpacked(answers[int(p)][k], int(at[p + 1] - at[p]))
            sums.append(block.losses(n, totals[k], vocabulary))
        rows = [(d, s, t / s if s else None, b / s if s else None) for d, s, t, b in zip(row["doc_ids"], row["sizes"], *(x.tolist() for x in sums))]
        return rows_of(rows, LOSSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, answers = None, {}
        for batch in batches:
            buckets_of = batch.column("bucket").to_pylist()
            for k, bucket in enumerate(buckets_of):
                if bucket < 0:
                    if row is not None:
                        yield scored(row, answers)
                    row, answers = batch.slice(k, 1).to_pylist()[0], {}
                else:
                    answers[bucket] = tuple(batch.column(c)[k].as_py() for c in ("n", "n_target"))
        if row is not None:
            yield scored(row, answers)

    return run


def cross_entropy_difference(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, target_loss, background_loss, difference)`` for every row of ``docs``, losses per token in nats.

    ``docs`` needs ``doc_id`` and ``text``; the documents whose ``doc_id`` is in ``targets`` are the target, all documents are the
    background. Both models are interpolated bigram models over one vocabulary, all tokens of all documents.
    ``difference`` is target_loss - background_loss: the lower, the more a text is like the target.

    No token and no pair is left out. Texts become blocks, a few MB of text each, written as numbers to the shared folder. Each
    block sends its distinct tokens and pairs, with its own counts, to buckets by hash, and gets back the counts over all blocks in
    its own order, without the keys. A frequent pair is one entry of a block, however often it occurs, so no bucket is uneven. The
    number of buckets grows with the corpus; a task holds one bucket or one block. Only sums come to the driver. Tokens and pairs
    are told apart by 62 bits of hash.

    Null, empty and blank texts have n_tokens 0 and null losses. Repeated rows count as often as they occur. Without targets the
    target model knows nothing and its loss is that of a uniform choice. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = cut_lineage(targets.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("target")).distinct())
    marked = docs.join(few_ids(ids), "doc_id", "left").select("doc_id", "text", "target")
    blocks = cut_lineage(marked.mapInArrow(to_blocks, BLOCKS))
    sums = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_target", "n_keys"))).first()
    buckets = max(LEAST_BUCKETS, -(-sums["n_keys"] // BUCKET_KEYS))
    asked = blocks.select("block", "sizes", "targets", "tokens", "hashes").mapInArrow(ask(buckets), ASKED)
    answers = cut_lineage(asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, ANSWERED))
    vocabulary = answers.where("block = -1").agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    narrow = blocks.select("block", F.lit(-1).alias("bucket"), "doc_ids", "sizes", "tokens", "hashes")
    both = narrow.unionByName(answers.where("block <> -1").select("block", "bucket", "n", "n_target"), allowMissingColumns=True)
    scored = both.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(score(buckets, (sums["n_tokens"], sums["n_target"]), vocabulary), LOSSES)
    return scored.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
