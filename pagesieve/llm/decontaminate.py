"""Benchmark decontamination: suffix arrays over shards of the training texts, searched with every test suffix."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import slices, texts_of

WINDOW_WORDS = 13
#: A document is contaminated when at least one word in this many is hit.
CONTAMINATED_PART = 20
#: Benchmark text that is searched at a time, as arrays of some 60 bytes for each word in the driver and in each task, beside the
#: dictionary of its distinct words; a larger benchmark is searched block by block.
BLOCK_BYTES = 16 << 20

#: Lower-cases A-Z and turns every byte that is no part of a word into a space.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)

STATE = "hits array<struct<start:int,end:int>>, matches array<struct<item_id:long,item_start:int,doc_start:int,length:int>>"
HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass(frozen=True)
class Tests:
    """A block of benchmark items as word numbers, and its distinct windows, each a prefix of a test suffix."""

    vocabulary: dict[bytes, int]
    tokens: np.ndarray  # all items, each followed by a 0
    starts: np.ndarray  # of the distinct windows, in tokens
    lengths: np.ndarray
    first_owner: np.ndarray  # of each distinct window, and behind the last one the number of owners
    owner_items: np.ndarray
    owner_places: np.ndarray  # in their items

    def owners(self, window: int) -> Iterator[tuple[int, int]]:
        """(item, position in it) of a distinct window."""
        own = slice(self.first_owner[window], self.first_owner[window + 1])
        return zip(self.owner_items[own].tolist(), self.owner_places[own].tolist())


def window_numbers(tokens: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A number for each position: equal where the next 13 words are, or all that the item has ``left``, if these are fewer."""

    def joined(first: np.ndarray, rest: np.ndarray, far: int) -> np.ndarray:
        following, inside = np.zeros(len(rest), np.int64), np.flatnonzero(left > far)
        following[inside] = rest[inside + far]
        following += first * (int(following.max(initial=0)) + 1)
        return np.unique(following, return_inverse=True)[1] + 1

    part, whole, covered, size = tokens.astype(np.int64), tokens.astype(np.int64), 1, 1
    while 2 * size <= WINDOW_WORDS:
        part, size = joined(part, part, size), 2 * size
        if WINDOW_WORDS - 1 & size:
            whole, covered = joined(whole, part, covered), covered + size
    return whole


def prepare(items: Iterable[tuple[int, bytes]]) -> Tests:
    """Number the words; a window is 13 consecutive words of an item, or the whole of a shorter one; none of an empty one."""
    vocabulary: dict[bytes, int] = {}
    numbers, ids, counts = array("i"), array("q"), array("q")
    for item, text in items:
        words = words_of(text)
        numbers.extend(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words)
        numbers.append(0)
        ids.append(item)
        counts.append(len(words))
    tokens, sizes = np.array(numbers, np.int32), np.array(counts, np.int64)
    item = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    place = np.arange(len(tokens)) - (np.cumsum(sizes + 1) - sizes - 1)[item]
    left = sizes[item] - place
    windows = np.flatnonzero((left >= WINDOW_WORDS) | ((place == 0) & (left > 0)))
    number = window_numbers(tokens, left)[windows]
    order = np.argsort(number, kind="stable")
    windows, number = windows[order], number[order]
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1])[: len(number)])
    starts = windows[first]
    return Tests(
        vocabulary, tokens, starts, np.minimum(left[starts], WINDOW_WORDS), np.append(first, len(windows)),
        np.array(ids, np.int64)[item[windows]], place[windows].astype(np.int32),
    )


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Start positions ordered by their first ``depth`` words at least, by prefix doubling; 0 ends a text and sorts first."""
    rank, k = tokens.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        following = np.zeros_like(rank)
        following[:-k or None] = rank[k:] if k < len(rank) else 0
        pair = rank * (int(rank.max(initial=0)) + 1) + following
        order = np.argsort(pair, kind="stable")
        rank = np.empty_like(pair)
        rank[order] = np.cumsum(np.append(1, pair[order][1:] != pair[order][:-1]))
        rank[tokens == 0] = 0
        k *= 2
    return order


def search(tokens: np.ndarray, order: np.ndarray, tests: Tests, upper: bool) -> np.ndarray:
    """By binary search, how many suffixes sort before every window (``upper``: before or with it as prefix)."""
    low, high = np.zeros(len(tests.starts), np.int64), np.full(len(tests.starts), len(order))
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        position, start, length = order[middle], tests.starts[open_], tests.lengths[open_]
        sign, active = np.zeros(len(open_), np.int8), np.arange(len(open_))
        for k in range(WINDOW_WORDS):
            active = active[(sign[active] == 0) & (k < length[active])]
            if not len(active):
                break
            at = position[active] + k
            have = np.where(at < len(tokens), tokens[np.minimum(at, len(tokens) - 1)], 0)
            sign[active] = np.sign(have - tests.tokens[start[active] + k])
        after = (sign <= 0) if upper else (sign < 0)
        low[open_[after]] = middle[after] + 1
        high[open_[~after]] = middle[~after]
    return low


def occurrences(numbers: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(position in the shard, window) of every occurrence. ``numbers``: the shard's words, 0 for words of no test and between texts.

    A suffix that can start no window is left out of the suffix array: its run of known words is shorter than the shortest
    window, so no test window is a prefix of it.
    """
    if not len(numbers) or not len(tests.starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    stops = np.append(np.flatnonzero(numbers == 0), len(numbers))
    runs = np.diff(np.append(-1, stops)) - 1
    long = np.flatnonzero(runs >= tests.lengths.min())
    if not len(long):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keep = np.concatenate([np.arange(stops[k] - runs[k], stops[k] + 1) for k in long])
    tokens = np.append(numbers, 0)[keep]
    order = suffix_array(tokens, WINDOW_WORDS)
    first, last = search(tokens, order, tests, False), search(tokens, order, tests, True)
    found = np.flatnonzero(last > first)
    spans = [order[first[k] : last[k]] for k in found]
    return keep[np.concatenate(spans)] if spans else np.empty(0, np.int64), np.repeat(found, (last - first)[found])


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of half-open intervals as disjoint ones."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return list(zip(starts[new].tolist(), ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)].tolist()))


def longest(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(item, position in it, position in the document, length): windows that continue one another become one match."""
    matches: list[list[int]] = []
    for item, _, at, in_doc, width in sorted((item, in_doc - at, at, in_doc, width) for item, at, in_doc, width in found):
        last = matches[-1] if matches else None
        if last and last[0] == item and last[2] - last[1] == in_doc - at and at <= last[1] + last[3]:
            last[3] = max(last[3], at + width - last[1])
        else:
            matches.append([item, at, in_doc, width])
    return [tuple(m) for m in matches]


def scan(tests: Tests, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's slices of documents are its shards: build the suffix array of each and look all windows up in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            numbers, sizes = [], []
            for text in texts_of(batch):
                words = words_of(text)
                sizes.append(len(words))
                numbers += [tests.vocabulary.get(w, 0) for w in words]
                numbers.append(0)
            bounds = np.cumsum([0, *(n + 1 for n in sizes)])
            position, window = occurrences(np.array(numbers, np.int32), tests)
            order = np.argsort(position, kind="stable")
            position, window = position[order], window[order]
            cuts = np.searchsorted(position, bounds)
            hits, matches = [], []
            for k in range(batch.num_rows):
                at, which = position[cuts[k] : cuts[k + 1]] - bounds[k], window[cuts[k] : cuts[k + 1]]
                hits.append(merged(at, at + tests.lengths[which]))
                matches.append(longest([
                    (item, where, p, int(tests.lengths[w])) for p, w in zip(at.tolist(), which.tolist()) for item, where in tests.owners(w)
                ]))
            if not first:
                for k, (old_hits, old_matches) in enumerate(zip(batch.column("hits").to_pylist(), batch.column("matches").to_pylist())):
                    spans = np.array([*hits[k], *((h["start"], h["end"]) for h in old_hits)], np.int64).reshape(-1, 2)
                    hits[k] = merged(spans[:, 0], spans[:, 1])
                    matches[k] += [(m["item_id"], m["item_start"], m["doc_start"], m["length"]) for m in old_matches]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text"), pa.array(sizes, pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in h] for h in hits], HITS),
                    pa.array([[dict(zip(("item_id", "item_start", "doc_start", "length"), m)) for m in ms] for ms in matches], MATCHES),
                ],
                ["doc_id", "text", "n_words", "hits", "matches"],
            )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, item_ids, matches, contaminated)`` for every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``; other columns are ignored. ``matches`` holds the
    longest verbatim matches: (item_id, item_start, doc_start, length), in words. A document is contaminated when
    n_hit > 0 and 20 * n_hit >= n_words.

    Nothing is shuffled: every task searches its own shards. The benchmark is taken in blocks of about ``block_bytes`` of text,
    the only data that is sent to all tasks, so neither its size nor that of the corpus is limited; each block is one more scan.

    Null, empty and wordless texts have no words: n_words 0, not contaminated; such items have no windows and match nothing.
    Items with a null id are ignored. Repeated rows are each judged; items with equal windows are all found. Empty tables give no
    rows, or documents that are all clean.
    """
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = max(1, -(-size // block_bytes))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        tests = prepare((row["item_id"], row["text"].encode()) for row in block.orderBy("item_id", "text").toLocalIterator())
        found = found.mapInArrow(scan(tests, k == 0), f"doc_id long, text string, n_words long, {STATE}")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, h: total + h["end"] - h["start"])
    found = found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.array_distinct(F.transform("matches", lambda m: m["item_id"])).alias("item_ids"), "matches",
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", "matches",
        ((F.col("n_hit") > 0) & (CONTAMINATED_PART * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
