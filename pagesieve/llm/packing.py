"""Packing: documents become fixed-length sequences in which every source keeps its share of the tokens."""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.llm.common import slices
from pagesieve.session import broadcast_within, cut_lineage

SEQUENCE_TOKENS = 2048
END_ID = 1
#: A source is served in a window once it is owed so many tokens, or the rest of a document; until then the window owes it.
LEAST_PIECE = 256
#: Characters that all Unicode versions class alike; other texts, and texts with the special token, take the slower way.
PLAIN = regex.compile(r"[^\x00-ɏ]")
SPECIAL = "<|endoftext|>"
#: Sources with a queue of their own; all others share one queue, so that the number of sources is not limited.
OWN_QUEUES = 1000
JOINT = "\0joint"
#: Rows of (task, source) that are broadcast at most.
FEW_CELLS = 500_000

TOKENS = "task int, before long, doc_id long, source string, n_tokens long, ids binary"
PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str, ranks_file: str | None) -> Callable[[list[str]], list]:
    """Token ids of texts by the tokenizer file. With the same vocabulary as ranks, plain texts are encoded several times faster."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_file)

    def slow(text: str) -> list[int]:
        return exact.encode(text, add_special_tokens=False).ids

    if ranks_file is None:
        return lambda texts: [slow(t) for t in texts]
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [slow(t) if SPECIAL in t or PLAIN.search(t) else fast.encode_ordinary(t) for t in texts]


def tokenize(tokenizer_file: str, ranks_file: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, held = encoder(tokenizer_file, ranks_file), TaskContext.get().partitionId(), {}
        for batch in slices(batches):
            ids = [np.array([*x, END_ID], "<u4") for x in encode([t or "" for t in batch.column("text").to_pylist()])]
            small = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"\0" + x.tobytes() for x in ids]
            before = []
            for source, x in zip(batch.column("source").to_pylist(), ids):
                before.append(held.get(source, 0))
                held[source] = before[-1] + len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task] * batch.num_rows, pa.int32()), pa.array(before, pa.int64()), batch.column("doc_id"), batch.column("source"),
                    pa.array([len(x) for x in ids], pa.int64()), pa.array(small, pa.binary()),
                ],
                ["task", "before", "doc_id", "source", "n_tokens", "ids"],
            )

    return run


def unpacked(ids: bytes, n: int) -> np.ndarray:
    """Ids as unsigned 32-bit: stored in 16 bits each, or in 32 behind a zero byte."""
    return np.frombuffer(ids, "<u2").astype("<u4") if len(ids) == 2 * n else np.frombuffer(ids, "<u4", offset=1)


class Packer:
    """Deficit round-robin over one shard's source queues.

    Every window earns each source with documents its share of the window; what a source is owed or has taken in advance is carried
    to the next window. ``owed`` is what the shards before this one left over.
    """

    def __init__(self, shares: dict[str, float], owed: dict[str, float], length: int):
        self.shares, self.length = shares, length
        self.owed = dict(owed)
        self.queues: dict[str, deque] = {}
        self.waiting = 0

    def add(self, source: str, doc_id: int | None, ids: np.ndarray) -> None:
        self.queues.setdefault(source if source in self.shares else JOINT, deque()).append([doc_id, source, ids, 0])
        self.waiting += len(ids)

    def _take(self, name: str, most: int) -> tuple:
        queue = self.queues[name]
        doc_id, source, ids, start = queue[0]
        n = min(most, len(ids) - start)
        if start + n == len(ids):
            queue.popleft()
        else:
            queue[0][3] += n
        self.waiting -= n
        self.owed[name] = self.owed.get(name, 0.0) - n
        return doc_id, source, start, ids[start : start + n], len(ids)

    def window(self, length: int) -> list[tuple]:
        """The pieces of the next window; the queues hold at least ``length`` tokens."""
        pieces, room = [], length
        active = [s for s, q in self.queues.items() if q]
        total = sum(self.shares.get(s, 0.0) for s in active)
        for s in active:
            part = self.shares.get(s, 0.0) / total if total > 0 else 1 / len(active)
            self.owed[s] = self.owed.get(s, 0.0) + length * part
        for source in sorted(active, key=lambda s: (-self.owed[s], s)):
            while room and self.queues[source]:
                _, _, ids, start = self.queues[source][0]
                due = int(min(self.owed[source], room))
                if due < min(LEAST_PIECE, len(ids) - start, room):
                    break
                pieces.append(self._take(source, due))
                room -= len(pieces[-1][3])
        while room:  # what no source is due goes to the one that is owed most, in advance
            source = max((s for s, q in self.queues.items() if q), key=lambda s: (self.owed[s], s))
            pieces.append(self._take(source, room))
            room -= len(pieces[-1][3])
        return pieces

    def rest(self) -> Iterator[list[tuple]]:
        """All remaining windows; the last tokens, fewer than a window, as sequences of powers of two, which need no padding."""
        while self.waiting:
            yield self.window(min(self.length, 1 << (self.waiting.bit_length() - 1)))


def pack_rows(shares: dict[str, float], length: int, ahead: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fill windows as soon as ``ahead`` tokens wait, so that a task holds no more than that and its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        packer, shard, out = None, None, []

        def emit(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc_id, source, start, ids, doc_tokens in pieces:
                data = ids.tobytes()
                out.append((doc_id, source, start, len(ids), zlib.crc32(data), doc_tokens, sequence, offset, data))
                offset += len(ids)
            sequence += 1

        def flushed() -> pa.RecordBatch:
            names = [field.split(" ")[0] for field in PIECES.split(", ")]
            columns = zip(*out) if out else [[] for _ in names]
            kinds = {"source": pa.string(), "ids": pa.binary()}
            made = pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.int64())) for n, c in zip(names, columns)], names)
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "source", "n_tokens", "ids", "owed"))):
                if packer is None or row[0] != shard:
                    for pieces in packer.rest() if packer else ():
                        emit(pieces)
                    packer, shard = Packer(shares, dict(row[5] or ()), length), row[0]
                packer.add(row[2], row[1], unpacked(row[4], row[3]))
                while packer.waiting >= ahead:
                    emit(packer.window(length))
                if len(out) >= 10_000:
                    yield flushed()
        for pieces in packer.rest() if packer else ():
            emit(pieces)
            if len(out) >= 10_000:
                yield flushed()
        yield flushed()

    return run


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    ranks_file: str | None = None,
    targets: dict[str, float] | None = None,
    length: int = SEQUENCE_TOKENS,
    ahead: int = 512 * SEQUENCE_TOKENS,
) -> DataFrame:
    """``(doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids)``, a row for each piece of a document.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; other columns are ignored. A document is its token ids and then id 1. Every
    id lies in exactly one piece. ``targets`` are the wanted shares of the sources by name; None means their shares of all tokens,
    at which no source runs out early. Sources beyond the largest thousand share one
    queue, as do sources without a target; they and whatever is left when others have run out are packed like the rest.

    Tokens are made once, where the text lies, and written to the shared folder. Documents are dealt to as many shards as tasks made
    them, by where they lie among the tokens of their own source: every shard has the same part of each source, in the same mixture
    from its first row to its last, however the table is sorted. Each shard is packed by deficit round-robin. What a source is owed when a shard begins is its target share of all tokens before less what those
    shards held of it: one small row per shard. Every shard fills whole windows; only its last tokens form shorter sequences, of
    powers of two, so nothing is padded. A task holds at most ``ahead`` tokens besides the current batch.

    Null and empty texts are the single id 1. Null sources form a source of their own. Repeated rows are packed each. An empty
    table gives no rows.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")
    ).withColumn("source", F.coalesce("source", F.lit("")))
    tokens = cut_lineage(docs.mapInArrow(tokenize(tokenizer_file, ranks_file), TOKENS))
    places = dealt(tokens)
    counts = cut_lineage(places.groupBy("shard", "source").agg(F.sum("n_tokens").alias("n")))
    if targets is None:
        top = counts.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(OWN_QUEUES)
        targets = {row["source"]: float(row["n"]) for row in top.collect()}
        everything = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        targets[JOINT] = everything - sum(targets.values())
    total = sum(targets.values()) or 1.0
    shares = {source: n / total for source, n in targets.items()}
    owed = carried(counts, shares)
    rows = places.repartition("shard").join(owed, "shard", "left").sortWithinPartitions("shard", "at", "source", "doc_id")
    return rows.select("shard", "doc_id", "source", "n_tokens", "ids", "owed").mapInArrow(pack_rows(shares, length, ahead), PIECES)


def dealt(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``at``, where in its source, from 0 to 1, the middle of the document lies, and the ``shard`` of that place.

    Sources begin at different places of the circle of shards, by their hash, so that small ones do not all lie in the first. What the
    tasks before held of a source is a sum over one small row per task and source.
    """
    cells = cut_lineage(tokens.groupBy("task", "source").agg(F.sum("n_tokens").alias("n"), F.max("task").alias("last")))
    shards = (cells.agg(F.max("last").alias("last")).first()["last"] or 0) + 1
    cells = cells.select("task", "source", "n", F.floor(F.col("task") / 1000).alias("block"))
    inside = Window.partitionBy("source", "block").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy("source", "block").agg(F.sum("n").alias("of_block"))
    blocks = blocks.select("source", "block", F.coalesce(F.sum("of_block").over(earlier), F.lit(0)).alias("blocks_before"))
    totals = cells.groupBy("source").agg(F.sum("n").alias("total"))
    offsets = cells.withColumn("tasks_before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, ["source", "block"]).join(totals, "source")
    offsets = cut_lineage(offsets.select("task", "source", (F.col("tasks_before") + F.col("blocks_before")).alias("offset"), "total"))
    phase = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / float(1 << 20)
    at = (F.col("offset") + F.col("before") + F.col("n_tokens") / 2) / F.col("total") + phase
    placed = tokens.join(broadcast_within(offsets, FEW_CELLS), ["task", "source"]).withColumn("at", at - F.floor(at))
    return placed.withColumn("shard", F.least(F.floor(F.col("at") * shards), F.lit(shards - 1)).cast("int")).select(
        "shard", "at", "doc_id", "source", "n_tokens", "ids"
    )


def queue_of(shares: dict[str, float]) -> Column:
    """The source itself where it has a share of its own, else the joint queue."""
    return F.when(F.col("source").isin(list(shares)), F.col("source")).otherwise(JOINT) if shares else F.lit(JOINT)


def carried(counts: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``(shard, owed)``: for each shard a map from queue to what all shards before it left owed: its share of their tokens less
    the tokens of it that they held.

    Sums run within blocks of 1,000 shards and over the totals of blocks, so no task sees more than a block or the block totals.
    """
    cells = counts.withColumn("queue", queue_of(shares)).groupBy("shard", "queue").agg(F.sum("n").alias("n"))
    cells = cells.withColumn("block", F.floor(F.col("shard") / 1000))
    everything = cells.groupBy("shard", "block").agg(F.sum("n").alias("n")).withColumn("queue", F.lit(None).cast("string"))
    both = cells.select("shard", "block", "queue", "n").union(everything.select("shard", "block", "queue", "n"))
    unbounded = Window.unboundedPreceding
    inside = Window.partitionBy("queue", "block").orderBy("shard").rowsBetween(unbounded, -1)
    earlier = Window.partitionBy("queue").orderBy("block").rowsBetween(unbounded, -1)
    blocks = both.groupBy("queue", "block").agg(F.sum("n").alias("of_block"))
    blocks = blocks.select("queue", "block", F.coalesce(F.sum("of_block").over(earlier), F.lit(0)).alias("blocks_before"))
    before = both.withColumn("shards_before", F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("s").join(
        blocks.alias("b"), (F.col("s.block") == F.col("b.block")) & F.col("s.queue").eqNullSafe(F.col("b.queue"))
    )
    before = before.select("s.shard", "s.queue", (F.col("shards_before") + F.col("blocks_before")).alias("n"))
    held = before.where("queue IS NOT NULL")
    total = before.where("queue IS NULL").select("shard", F.col("n").alias("all"))
    share = F.coalesce(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("queue")], F.lit(0.0)) if shares else F.lit(0.0)
    owed = F.struct("queue", (share * F.col("all") - F.col("n")).alias("owed"))
    return held.join(total, "shard").groupBy("shard").agg(F.map_from_entries(F.collect_list(owed)).alias("owed"))
