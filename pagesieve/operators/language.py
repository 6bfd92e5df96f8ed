"""Language: a character-trigram model trained from labelled text, detection with English confidence, and the gate."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.text import byte_length, text_or_empty
from pagesieve.schemas import Options
from pagesieve.session import cut_lineage

_SMOOTHING = 0.5
# Bytes of the part of a profile that is broadcast: 16 for each gram and 8 for each of its languages.
_BROADCAST_BYTES = 32_000_000
# Bytes of folded text that a task takes apart at a time; a longer page is alone.
_SLICE_BYTES = 1 << 20
# Different trigrams whose counts a task holds, from which on it sends them.
_HELD_GRAMS = 1_000_000
UNKNOWN = "unknown"
ENGLISH = "en"


def _folded(text: Column | str) -> Column:
    """The lower-cased text with non-letters folded to single spaces."""
    return F.regexp_replace(F.lower(text_or_empty(text)), r"[^\p{L}]+", " ")


def trigrams(text: Column | str) -> Column:
    """Every character trigram of the folded text."""
    return F.regexp_extract_all(_folded(text), F.lit(r"(?=(...))."), F.lit(1))


def _raw_codes(folded: str) -> np.ndarray:
    """The trigrams of a folded text in their order, each as one number."""
    c = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:] if len(c) > 2 else c[:0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's counts. Whenever it holds ``_HELD_GRAMS`` different trigrams or more, they are sent on, so a trigram may come again."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, (codes, times) in held.items():
            columns = [pa.array([lang] * len(codes), pa.string()), pa.array(_texts_of(codes), pa.string()), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])
        held.clear()

    for batch in _slices(batches):
        texts: dict[str, list[str]] = {}
        for lang, folded in zip(batch.column("lang").to_pylist(), batch.column("folded").to_pylist()):
            texts.setdefault(lang, []).append(folded)
        for lang, own in texts.items():
            codes, times = np.unique(np.concatenate([_raw_codes(folded) for folded in own]), return_counts=True)
            if lang in held:
                both, place = np.unique(np.concatenate([held[lang][0], codes]), return_inverse=True)
                sums = np.zeros(len(both), np.int64)
                np.add.at(sums, place, np.concatenate([held[lang][1], times]))
                codes, times = both, sums
            held[lang] = codes, times
        if sum(len(codes) for codes, _ in held.values()) >= _HELD_GRAMS:
            yield from sent()
    yield from sent()


def count_trigrams(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, gram, n)``: what a profile is made of. Tables of different texts add up (``operators.counts``).

    Tasks count the trigrams of their texts and only the counts of different ones are rows.
    """
    folded = labelled.where(F.col(lang).isNotNull()).select(F.lower(lang).alias("lang"), _folded(text).alias("folded"))
    return folded.mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profile_from_counts(counts: DataFrame) -> DataFrame:
    """``(lang, gram, logp)``: add-0.5 smoothed log-probabilities of the trigrams seen per language, and for every
    language one row with an empty gram that holds the value of an unseen trigram. ``counts`` should be a written table.
    """
    vocabulary = counts.select("gram").distinct().count()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    seen = counts.join(totals, "lang").select("lang", "gram", "n", "total")
    unseen = totals.select("lang", F.lit("").alias("gram"), F.lit(0).cast("long").alias("n"), "total")
    smoothed = (F.col("n") + _SMOOTHING) / (F.col("total") + _SMOOTHING * vocabulary)
    return seen.unionByName(unseen).select("lang", "gram", F.ln(smoothed).alias("logp"))


def train_language_profile(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The profile of ``labelled`` texts, trained at once: they are read once, and all else is of profile size."""
    return profile_from_counts(cut_lineage(count_trigrams(labelled, text, lang)))


def _codes(folded: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a folded text, each as one number, and how often they occur."""
    return np.unique(_raw_codes(folded), return_counts=True)


def _texts_of(codes: np.ndarray) -> np.ndarray:
    """The trigrams of code numbers."""
    characters = np.stack([codes >> 42, codes >> 21, codes], axis=1) & 0x1FFFFF
    return np.ascontiguousarray(characters, "<u4").view("<U3").ravel()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``_SLICE_BYTES`` of text, or one page."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("folded")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + _SLICE_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def _score(known: Broadcast, keys: list[str], with_rest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For every page its number of trigrams, of known ones, and a sum for each language; with the unknown ones, if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scores, unseen = known.value
        for batch in _slices(batches):
            rows, rest = [], []
            for folded in batch.column("folded").to_pylist():
                codes, times = _codes(folded)
                at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
                hit = grams[at] == codes if len(grams) else np.zeros(len(codes), bool)
                n, seen = int(times.sum()), int(times[hit].sum())
                rows.append((n, int(hit.sum()), times[hit] @ scores[at[hit]] + (n - seen) * unseen))
                if with_rest:
                    rest.append((codes[~hit], times[~hit]))
            columns = [
                *(batch.column(k) for k in keys), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.list_(pa.float64())),
            ]
            names = [*keys, "n", "known", "sums"]
            if with_rest:
                ends = np.cumsum([0, *(len(codes) for codes, _ in rest)])
                codes, times = (np.concatenate(x) for x in zip(*rest))
                pairs = pa.StructArray.from_arrays([pa.array(_texts_of(codes), pa.string()), pa.array(times, pa.int64())], ["gram", "times"])
                columns, names = [*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], [*names, "rest"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _common(by_gram: DataFrame, size: int, most: int) -> Column:
    """Which trigrams are broadcast: the likeliest in any language, by quarters of a unit of log-probability, within the byte bound."""
    grade = F.floor(F.array_max("scores") * 4).cast("int")
    total, lowest = 0, 1
    for row in by_gram.groupBy(grade.alias("grade")).agg(F.count("*").alias("n")).orderBy(F.desc("grade")).collect():  # some 100 rows
        if (total + row.n) * size > most:
            break
        total, lowest = total + row.n, row.grade
    return grade >= lowest


@dataclass(frozen=True)
class LanguageModel:
    """A profile made ready to score with: the likeliest trigrams broadcast, and the rest of it, if there is one, as a table."""

    langs: list[str]
    unseen: list[float]
    known: Broadcast
    rest: DataFrame | None


def prepare_profile(profile: DataFrame, broadcast_bytes: int | None = None) -> LanguageModel:
    """Cut a profile for scoring. A trigram's values are one array over the languages.

    The likeliest trigrams, as many as the byte bound allows, will be sent to the texts; usually these are all.
    """
    # one row per language, not per gram
    unseen = {row.lang: row.logp for row in profile.where("gram = ''").select("lang", "logp").collect()}
    if not unseen:
        raise ValueError("a language profile must hold a language")
    langs = sorted(unseen)
    place = F.create_map(*[F.lit(x) for pair in zip(langs, range(len(langs))) for x in pair])
    floor = F.array(*[F.lit(unseen[lang]) for lang in langs])
    found = F.map_from_entries(F.collect_list(F.struct(place[F.col("lang")].alias("i"), "logp")))  # an entry for each language
    by_gram = profile.where("gram <> ''").groupBy("gram").agg(found.alias("found"))
    by_gram = by_gram.select("gram", F.transform(floor, lambda low, i: F.coalesce(F.col("found")[i], low)).alias("scores"))
    by_gram = cut_lineage(by_gram)
    common = _common(by_gram, 16 + 8 * len(langs), _BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes)
    table = by_gram.where(common).toArrow()
    codes = np.array([_codes(g)[0][0] for g in table["gram"].to_pylist()], np.int64)
    order = np.argsort(codes)
    scores = np.array(table["scores"].to_pylist(), np.float64).reshape(len(codes), len(langs))[order]
    low = [unseen[lang] for lang in langs]
    known = profile.sparkSession.sparkContext.broadcast((codes[order], scores, np.array(low)))
    rest = by_gram.where(~common)
    return LanguageModel(langs, low, known, None if rest.isEmpty() else rest)


def language_scores(pages: DataFrame, profile: DataFrame | LanguageModel, keys: list[str], text: str = "visible_text") -> DataFrame:
    """``(keys, detected, en_conf)`` for every page with at least one known trigram.

    Texts are scored where they lie by the broadcast part of the profile (prepared here, if it is not). Only if the profile has more,
    each page's other trigrams, distinct and with their numbers, meet the rest of it: trigrams so rare in every language that none is a
    hot key. Averages, not totals, so long pages do not saturate.
    """
    model = profile if isinstance(profile, LanguageModel) else prepare_profile(profile)
    langs, known, rest, with_rest = model.langs, model.known, model.rest, model.rest is not None
    floor = F.array(*map(F.lit, model.unseen))
    folded = pages.select(*keys, _folded(text).alias("folded"))
    own = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{own}, n long, known long, sums array<double>" + (", rest array<struct<gram: string, times: bigint>>" if with_rest else "")
    sums = folded.mapInArrow(_score(known, keys, with_rest), schema)
    if with_rest:
        sums = cut_lineage(sums)
        met = sums.select(*keys, F.explode("rest").alias("r")).select(*keys, "r.gram", "r.times").join(rest, "gram")
        gain = F.transform(F.arrays_zip("scores", floor.alias("floor")), lambda s: F.col("times") * (s["scores"] - s["floor"]))
        by_lang = met.select(*keys, F.posexplode(gain).alias("i", "gain")).groupBy(*keys, "i").agg(F.sum("gain").alias("gain"), F.count("*").alias("met"))
        added = by_lang.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "gain"))).alias("gains"), F.max("met").alias("met"))
        more = F.transform("sums", lambda s, i: s + F.coalesce(F.col("gains")[i], F.lit(0.0)))
        sums = sums.drop("rest").join(added, keys, "left").withColumn("sums", more).withColumn("known", F.col("known") + F.coalesce("met", F.lit(0)))
    average = F.transform("sums", lambda s: s / F.col("n"))
    averages = sums.where("known > 0").select(*keys, average.alias("a")).withColumn("best", F.array_max("a"))
    names = F.array(*map(F.lit, langs))
    weights = F.transform("a", lambda x: F.exp(x - F.col("best")))
    share = F.aggregate(weights, F.lit(0.0), lambda total, w: total + w)
    english = F.element_at(weights, langs.index(ENGLISH) + 1) if ENGLISH in langs else F.lit(0.0)
    detected = F.element_at(names, F.array_position("a", F.col("best")).cast("int"))
    return averages.select(*keys, detected.alias("detected"), (english / share).alias("en_conf"))


def detect_language(pages: DataFrame, profile: DataFrame | LanguageModel, keys: list[str], options: Options = Options()) -> DataFrame:
    """Scores for the pages long enough to be detected; the cheap byte test runs before the trigram join."""
    return language_scores(pages.where(byte_length("visible_text") >= options.min_detect_bytes), profile, keys)


def gate_language(detected: Column | str, n_bytes: Column | str, options: Options = Options()) -> Column:
    """The language a page is given: ``unknown`` when too short or undetected, else the detected code."""
    n_bytes = F.col(n_bytes) if isinstance(n_bytes, str) else n_bytes
    return F.when(n_bytes < options.min_detect_bytes, UNKNOWN).otherwise(F.coalesce(detected, F.lit(UNKNOWN)))


def is_rejected_language(language: Column | str, en_conf: Column | str, options: Options = Options()) -> Column:
    """Rejected: a detected language other than English whose English confidence is not above the floor."""
    language = F.col(language) if isinstance(language, str) else language
    confidence = F.coalesce(en_conf, F.lit(0.0))
    return ~language.isin(UNKNOWN, ENGLISH) & ~(confidence > options.english_floor)
