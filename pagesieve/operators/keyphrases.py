"""Keyphrase extraction: one- to three-word candidates ranked by relevance with maximal marginal relevance.

A page and a phrase are both vectors of TF-IDF word weights. Relevance is the cosine between phrase and page,
redundancy the cosine between two phrases. Only single words need corpus statistics, so the corpus join is on the word
vocabulary and not on all n-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.text import text_or_empty
from pagesieve.schemas import Options
from pagesieve.session import cut_lineage

MAX_WORDS = 3
TOKEN = r"[\p{L}\p{N}_]{2,}"
# At most this many words, each of at most so many bytes, are broadcast: the most frequent, which are nearly all tokens.
_BROADCAST_WORDS = 500_000
_BROADCAST_WORD_BYTES = 64
# Words of pages that a task holds as Python strings at a time; a longer page is alone.
_SLICE_WORDS = 100_000


def _words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(TOKEN), F.lit(0))


def _without(words: DataFrame, stop_words: list[str]) -> DataFrame:
    return words.where(~F.col("word").isin(*stop_words)) if stop_words else words


def default_stop_words() -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def train_word_frequencies(docs: DataFrame, text: str = "visible_text", stop_words: list[str] | None = None) -> DataFrame:
    """``(word, df)``: in how many documents each word occurs; the empty word holds the number of documents."""
    stop_words = default_stop_words() if stop_words is None else stop_words
    # every document also counts for the empty word
    words = F.array_append(F.array_distinct(_words(text)), F.lit(""))
    return _without(docs.select(F.explode(words).alias("word")), stop_words).groupBy("word").agg(F.count("*").alias("df"))


def _frequent(frequencies: DataFrame) -> Column:
    """Which words are broadcast: those from the lowest power of two of df that leaves no more than ``_BROADCAST_WORDS``."""
    short = F.octet_length("word") <= _BROADCAST_WORD_BYTES
    by_power = (
        frequencies.where((F.col("word") != "") & short)
        .groupBy(F.floor(F.log2("df")).alias("power"))
        .agg(F.count("*").alias("words"))
        .collect()  # at most 64 rows
    )
    total, lowest = 0, 64
    for power, words in sorted(by_power, reverse=True):
        if total + words > _BROADCAST_WORDS:
            break
        total, lowest = total + words, power
    return (F.col("word") != "") & short & (F.floor(F.log2("df")) >= lowest)


def _rare_words(
    docs: DataFrame, frequent: DataFrame, rare: DataFrame, key: str, text: str, stop_words: list[str]
) -> DataFrame:
    """``(key, rare)``: the frequencies of the words of each document that are not broadcast, as an array of (word, df).

    Only distinct (document, word) pairs without the frequent words are shuffled; a rare word is in few documents, so no key is hot.
    """
    pairs = _without(docs.select(key, F.explode(F.array_distinct(_words(text))).alias("word")), stop_words)
    pairs = pairs.join(F.broadcast(frequent.select("word")), "word", "left_anti")
    return pairs.join(rare, "word").groupBy(key).agg(F.collect_list(F.struct("word", "df")).alias("rare"))


def _rank_page(codes: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray, top_n: int, diversity: float) -> list[str]:
    """The top phrases of one page from its words in order; equal scores go to the more relevant, then smaller phrase.

    ``codes`` are places in ``vocabulary``, which is sorted; ``idf`` weighs the vocabulary.
    """
    root = np.append(idf, 0.0)  # the last entry, reached by code -1, is the weight of an absent word
    tf = np.append(np.bincount(codes), 0)
    square, dot = root * root, root * root * tf
    page_norm = np.sqrt((dot * tf).sum())

    single = np.sort(np.round(tf * root / page_norm, 9)[:-1])[::-1]
    # The phrases picked before the last pick hold at most 3 * (top_n - 1) words, so one of the next-more most relevant
    # single words is free of redundancy and beats every candidate less relevant than it: an exact cut, not a cap.
    reach = MAX_WORDS * (top_n - 1)
    cut = single[reach] if len(single) > reach else -1.0

    runs, relevances, norms = [], [], []
    for n in range(1, MAX_WORDS + 1):
        if len(codes) < n:
            break
        run = np.full((MAX_WORDS, len(codes) - n + 1), -1)
        for i in range(n):
            run[i] = codes[i : len(codes) - n + 1 + i]
        repeats = sum((2 * square[run[i]] * (run[i] == run[j]) for i in range(n) for j in range(i)), np.zeros(run.shape[1]))
        norm = np.sqrt(square[run].sum(axis=0) + repeats)
        relevance = np.round(dot[run].sum(axis=0) / (norm * page_norm), 9)
        near = relevance >= cut
        runs.append(run[:, near]), relevances.append(relevance[near]), norms.append(norm[near])
    run, relevance, norm = np.hstack(runs), np.hstack(relevances), np.hstack(norms)

    # words are coded in their order, so this number orders phrases like their text
    base = len(vocabulary) + 1
    text_order = ((run[0] + 1) * base + run[1] + 1) * base + run[2] + 1
    _, distinct = np.unique(text_order, return_index=True)
    distinct = distinct[np.argsort(-relevance[distinct], kind="stable")]
    run, relevance, norm = run[:, distinct], relevance[distinct], norm[distinct]

    roots = root[run]
    redundancy, open_ = np.zeros(len(norm)), np.ones(len(norm), dtype=bool)
    picked: list[int] = []
    for _ in range(min(top_n, len(norm))):
        value = np.round((1 - diversity) * relevance - diversity * np.round(redundancy, 9), 9)
        best = int(np.argmax(np.where(open_, value, -np.inf)))
        picked.append(best)
        open_[best] = False
        chosen = np.zeros(len(root))
        np.add.at(chosen, run[:, best], roots[:, best])
        redundancy = np.maximum(redundancy, (chosen[run] * roots).sum(axis=0) / (norm * norm[best]))
    return [" ".join(vocabulary[c] for c in run[:, i] if c >= 0) for i in sorted(picked)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``_SLICE_WORDS`` words and frequencies of rare ones, or one page."""
    for batch in batches:
        sizes = [pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in ("words", "_rare")]
        ends = np.cumsum(sizes[0].astype(np.int64) + sizes[1])
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + _SLICE_WORDS, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def _rank(
    known: Broadcast, n_docs: int, stops: frozenset[str], key: str, top_n: int, diversity: float
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The keyphrases of pages given as their words in order and the frequencies of the words that are not broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = known.value
        for batch in _slices(batches):
            ranked = []
            for page, rare in zip(batch.column("words").to_pylist(), batch.column("_rare").to_pylist()):
                codes, vocabulary = pd.factorize(np.array([w for w in page if w not in stops], dtype=object), sort=True)
                own = {r["word"]: r["df"] for r in rare or ()}
                df = np.array([frequency.get(w) or own.get(w, 0) for w in vocabulary], dtype=float)
                idf = np.log((1 + n_docs) / (1 + df)) + 1
                ranked.append(_rank_page(codes, vocabulary, idf, top_n, diversity) if len(codes) else [])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(ranked, pa.list_(pa.string()))], [key, "keyphrases"])

    return run


def extract_keyphrases(
    docs: DataFrame,
    options: Options = Options(),
    text: str = "visible_text",
    stop_words: list[str] | None = None,
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """``(key, keyphrases)`` for every document, most relevant first; blank text gives an empty array.

    ``frequencies`` is a saved word-frequency table of the corpus; without one it is counted from ``docs`` and kept. Words it does
    not hold count as unseen. Texts stay where they lie when the frequent words are all there are; else each meets one short
    array of its rare words on the key.
    """
    key, top_n, diversity = options.key, options.top_keyphrases, options.diversity
    stop_words = default_stop_words() if stop_words is None else stop_words
    if frequencies is None:
        frequencies = cut_lineage(train_word_frequencies(docs, text, stop_words))
    is_frequent = _frequent(frequencies)
    frequent = frequencies.where(is_frequent)
    counted = frequencies.where(F.col("word") == "").agg(F.sum("df").alias("docs")).first()
    n_docs = counted.docs or 0
    table = frequent.select("word", "df").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(table["word"].to_pylist(), table["df"].to_pylist())))
    stops = frozenset(stop_words)

    rare = frequencies.where(~is_frequent & (F.col("word") != ""))
    if rare.isEmpty():
        texts = docs.withColumn("_rare", F.lit(None).cast("array<struct<word: string, df: bigint>>"))
    else:
        found = _rare_words(docs, frequent, rare, key, text, stop_words).withColumnRenamed("rare", "_rare")
        texts = docs.select(key, text).join(found, key, "left")
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, keyphrases array<string>"
    words = texts.select(key, _words(text).alias("words"), "_rare")
    return words.mapInArrow(_rank(known, n_docs, stops, key, top_n, diversity), schema)
