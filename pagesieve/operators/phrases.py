"""Many phrases in texts at once: an automaton of all of them reads every text once, wherever the texts lie.

A dictionary of any size is cut into shards of bounded bytes by the first character of its phrases (and by hash, where one character
begins more than a shard). Each shard becomes a trie with failure links in the tasks; texts are neither shuffled nor exploded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.text import text_or_empty

#: Bytes of the phrases of one shard, with ``ROW_BYTES`` for each: what a task's automaton is built from.
SHARD_BYTES, ROW_BYTES = 8_000_000, 32
#: The automaton that this Python worker built last, by the number of the broadcast it came from.
_BUILT: dict[int, tuple] = {}


def automaton(known: Broadcast) -> tuple:
    """``(automaton, phrases, weights)`` of a shard; its values are the rows of each phrase. Built once a worker."""
    import ahocorasick

    number = known._jbroadcast.id() if known._jbroadcast is not None else known._path
    if number not in _BUILT:
        phrases, weights = known.value
        rows: dict[str, list[int]] = {}
        for i, phrase in enumerate(phrases):
            rows.setdefault(phrase, []).append(i)
        built = ahocorasick.Automaton()
        for phrase, places in rows.items():
            built.add_word(phrase, tuple(places))
        built.make_automaton()
        _BUILT.clear()
        _BUILT[number] = (built, pa.array(phrases, pa.string()), weights)
    return _BUILT[number]


def shards(dictionary: DataFrame, shard_bytes: int | None = None) -> Iterator[Column]:
    """Conditions on ``phrase`` that cut a dictionary into parts of at most ``shard_bytes`` (a longer phrase alone)."""
    limit = SHARD_BYTES if shard_bytes is None else shard_bytes
    size = F.sum(F.octet_length("phrase") + ROW_BYTES).alias("bytes")
    by_first = dictionary.groupBy(F.left("phrase", F.lit(1)).alias("first")).agg(size).orderBy("first").collect()  # a row a character
    together: list[str] = []
    total = 0
    for row in by_first:
        if together and total + row.bytes > limit:
            yield F.left("phrase", F.lit(1)).isin(together)
            together, total = [], 0
        if row.bytes > limit:
            parts = -(-2 * row.bytes // limit)
            for part in range(parts):
                yield (F.left("phrase", F.lit(1)) == row.first) & (F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part)
        else:
            together.append(row.first)
            total += row.bytes
    if together:
        yield F.left("phrase", F.lit(1)).isin(together)


def _matches(known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built, phrases, weights = automaton(known)
        weights = pa.array(weights, pa.int32())
        for batch in batches:
            pages, rows = [], []
            for page, text in enumerate(batch.column("lowered").to_pylist()):
                found = {places for _, places in built.iter(text)}
                for places in found:
                    pages += [page] * len(places)
                    rows += places
            at = pa.array(rows, pa.int64())
            columns = [batch.column(0).take(pa.array(pages, pa.int64())), phrases.take(at), weights.take(at)]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "phrase", "weight"])

    return run


def _sums(known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built, _, weights = automaton(known)
        for batch in batches:
            sums = []
            for text in batch.column("lowered").to_pylist():
                found = {places for _, places in built.iter(text)}
                sums.append(sum(weights[i] for places in found for i in places))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("n"), pa.array(sums, pa.int64())], [batch.schema.names[0], "n", "raw"])

    return run


def _known(dictionary: DataFrame) -> Iterator[Broadcast]:
    """The shards of a dictionary, one bounded part at a time, as broadcasts."""
    rows = dictionary.where("phrase <> ''").select("phrase", F.col("weight").cast("int").alias("weight")).distinct()
    for condition in shards(rows):
        part = rows.where(condition).toArrow()
        if not len(part):  # nothing fell into this part of a character
            continue
        yield dictionary.sparkSession.sparkContext.broadcast((part["phrase"].to_pylist(), part["weight"].to_pylist()))


def dictionary_matches(pages: DataFrame, dictionary: DataFrame, key: str = "key", text: str = "visible_text") -> DataFrame:
    """``(key, phrase, weight)`` for every distinct dictionary row whose phrase is in the lower-cased text, as a substring.

    For dictionaries of any size; a page without a key has no rows. The texts are read once for each shard.
    """
    kind = pages.schema[key].dataType.simpleString()
    texts = pages.where(F.col(key).isNotNull()).select(key, F.lower(text_or_empty(text)).alias("lowered"))
    schema = f"`{key}` {kind}, phrase string, weight int"
    found = [texts.mapInArrow(_matches(known), schema) for known in _known(dictionary)]
    together = found[0] if found else pages.sparkSession.createDataFrame([], schema)
    for part in found[1:]:
        together = together.unionAll(part)
    return together


def phrase_sums(pages: DataFrame, dictionary: DataFrame, key: str = "key", text: str = "visible_text") -> DataFrame:
    """``(key, n, raw)``: every page's length in characters and its weight sum; a page without a key matches nothing.

    With one shard nothing is shuffled; with more, one short row a page and shard is. Keys must be unique.
    """
    kind = pages.schema[key].dataType.simpleString()
    whole = text_or_empty(text)
    texts = pages.select(key, F.when(F.col(key).isNotNull(), F.lower(whole)).otherwise("").alias("lowered"), F.char_length(whole).cast("long").alias("n"))
    found = [texts.mapInArrow(_sums(known), f"`{key}` {kind}, n long, raw long") for known in _known(dictionary)]
    if not found:
        return texts.select(key, "n", F.lit(0).cast("long").alias("raw"))
    if len(found) == 1:
        return found[0]
    together = found[0]
    for part in found[1:]:
        together = together.unionAll(part)
    return together.groupBy(key).agg(F.max("n").alias("n"), F.sum("raw").alias("raw"))
