"""Source divergence audit: how far the term frequencies of every source lie from those of the other sources of its language.

Each (lang, source) group is a row of a sparse group-by-term matrix. Pairwise divergences are made row by row after Gustavson: a
group scatters its terms through the term-major index into one dense accumulator over its peers, so no posting pair becomes a row.
Terms that a group or a peer lacks have the frequency of a zero count, not 0; the accumulator adds these baselines exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.llm.common import slices, texts_of
from pagesieve.session import cut_lineage

#: Frequencies are counted in units of one of so many parts.
PARTS = 1_000_000_000
#: A term is kept in a language when at least so many of its documents hold it.
LEAST_DOCUMENTS = 3
#: Terms reported for each group.
TOP_TERMS = 200
#: Distinct (group, term) entries that a task combines before it hands them on.
COMBINED = 500_000
#: Postings of a block of terms, and groups whose rows one task accumulates, at least and at most.
BLOCK_POSTINGS, ROWS = 20_000, 512
#: Bytes of the group table that are broadcast at most.
BROADCAST_BYTES = 32_000_000

COUNTS = "lang string, source string, term string, n long, docs long"
#: Lower-cases A-Z and makes every ASCII byte that is no letter a blank; bytes of other characters stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII."""
    return text.translate(LETTERS).split()


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of every (lang, source, term) of a task's documents; a row with an empty term says that the group occurs."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            columns = [[lang] * (len(terms) + 1), [source] * (len(terms) + 1)]
            words = pa.array([*terms, b""], pa.binary()).cast(pa.string())
            numbers = [pa.array([*map(c.__getitem__, terms), 0], pa.int64()) for c in (n, docs)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), words, *numbers], ["lang", "source", "term", "n", "docs"])
        counts.clear()

    for batch in slices(batches):
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts_of(batch)):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before, found = len(n), terms_of(text)
            n.update(found)
            docs.update(set(found))
            held += len(n) - before
        if held >= COMBINED:
            yield from emit()
            held = 0
    yield from emit()


def group_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and documents that hold the term; null lang, source and text count as empty."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = texts.mapInArrow(combine, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def frequency(n: Column, total: Column, kept: Column) -> Column:
    """The smoothed share in parts of ``PARTS``, plus 1; null where a language keeps no term."""
    top = (n + 1).cast("decimal(20,0)") * F.lit(PARTS).cast("decimal(10,0)")
    return F.when(total + kept > 0, F.call_function("div", top, (total + kept).cast("decimal(20,0)")).cast("long") + 1)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def accumulate(postings: pa.Table, groups: pa.Table) -> pa.Table:
    """The sums over one block of terms for a run of groups, against all peers of their language.

    ``groups`` are all groups of the language with ``row`` marking those whose rows are made here; ``postings`` hold the block's
    nonzero counts as frequencies. Every value is an exact sum of whole numbers that are not negative, so none outgrows the result.
    """
    groups = groups.sort_by("g")
    names, base, mine = groups["source"], groups["base"].to_numpy(), groups["row"].to_numpy(zero_copy_only=False)
    lang, size = groups["lang"][0].as_py(), len(groups)
    rows, values = np.flatnonzero(mine), []
    if len(postings):
        term = postings["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        g, p = np.searchsorted(groups["g"].to_numpy(), postings["of"].to_numpy()), postings["p"].to_numpy()
        by_term = np.argsort(term, kind="stable")  # the term-major index
        peer, share = g[by_term], p[by_term]
        starts = np.append(0, np.cumsum(np.bincount(term)))
        by_group = np.argsort(g, kind="stable")
        own_starts = np.append(0, np.cumsum(np.bincount(g, minlength=size)))
    for row in rows:
        total = np.zeros(size, np.int64)  # the dense accumulator over the peers
        if len(postings):
            own = by_group[own_starts[row] : own_starts[row + 1]]
            zero = f(base[row], base)
            total += (len(starts) - 1) * zero  # as if neither group held any term of the block
            np.add.at(total, g, f(base[row], p) - zero[g])  # terms of the peers
            share_of, times = np.unique(p[own], return_counts=True)
            for value, n in zip(share_of, times):  # terms of this group
                total += n * (f(value, base) - zero)
            first, lengths = starts[term[own]], starts[term[own] + 1] - starts[term[own]]
            at = np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            h, q, mine_p = peer[at], share[at], np.repeat(p[own], lengths)
            np.add.at(total, h, f(mine_p, q) - f(mine_p, base[h]) - f(base[row], q) + zero[h])  # terms of both
        values.append(np.delete(total, row))
    others = [names.take(pa.array(np.delete(np.arange(size), row))) for row in rows]
    n = len(rows) * (size - 1)
    return pa.table({
        "lang": pa.array([lang] * n, pa.string()),
        "source": names.take(pa.array(np.repeat(rows, size - 1), pa.int64())),
        "item": pa.chunked_array([c for x in others for c in x.chunks] or [pa.array([], pa.string())], pa.string()),
        "value": pa.array(np.concatenate(values) if values else [], pa.int64()),
    })


def _met(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with their group; the groups are broadcast where their measured bytes allow it, else both are shuffled."""
    size = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 64)).first()[0] or 0
    return rows.join(F.broadcast(groups) if size <= BROADCAST_BYTES else groups, ["lang", "source"])


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every occurring (lang, source) group of ``docs`` (text, lang, source).

    Part ``pair``: every other source of the language with the sum of floor((p - q)^2 / q) over all kept terms, all of them ranked.
    Part ``term``: the ``top_terms`` kept terms of the group that are more frequent there than in the language, by the same measure
    against the language's frequency. Ranks begin at 1, by falling value, then by the item's bytes.

    Null text, lang and source count as empty; every row is a document, repeated rows too. A group without a kept term has its pairs;
    a language without kept terms has pairs of value 0. A group alone in its language has no pairs. No documents give no rows;
    other columns are ignored. Text is counted in slices of a few MB (a longer text alone), values stay below 2^63 for up to 10^9
    kept terms of a language. A task's memory grows with a block's postings and the number of sources of one language.
    """
    counts = cut_lineage(group_counts(docs))
    of_term = Window.partitionBy("lang", "term")  # a row for each source of the language at most
    postings = (
        counts.where("term <> ''")
        .withColumns({
            "held": F.sum("docs").over(of_term), "total": F.sum("n").over(of_term),
            "first": F.row_number().over(of_term.orderBy("source")) == 1,
        })
        .where(F.col("held") >= least_documents)
        .select("lang", "source", "term", "n", "total", "first")
    )
    postings = cut_lineage(postings)
    of_lang = F.count_if("first").alias("kept"), F.sum("n").alias("lang_n"), F.count("*").alias("lang_postings")
    langs = postings.groupBy("lang").agg(*of_lang)
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    whole = Window.partitionBy("lang")
    groups = (
        counts.where("term = ''").select("lang", "source").distinct()
        .join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        .na.fill(0, ["kept", "lang_n", "lang_postings", "group_n"])
        .withColumns({"g": F.row_number().over(whole.orderBy("source")), "peers": F.count("*").over(whole)})
        .withColumn("base", frequency(F.lit(0), F.col("group_n"), F.col("kept")))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("lang_postings") / F.greatest(F.lit(BLOCK_POSTINGS).cast("double"), F.col("peers").cast("double") * ROWS))).cast("int"))
    )
    groups = cut_lineage(groups)
    met = _met(postings, groups).withColumn("p", frequency(F.col("n"), F.col("group_n"), F.col("kept")))

    q = frequency(F.col("total"), F.col("lang_n"), F.col("kept"))
    terms = met.withColumn("q", q).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value")
    )
    # a block of terms meets its language's groups once for every run of rows
    runs = F.explode(F.sequence(F.lit(0), F.floor((F.col("peers") - 1) / ROWS).cast("int"))).alias("run")
    blocked = met.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), runs, "term", F.col("g").alias("of"), "p")
    rows = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "g", "base", "peers")
    rows = rows.select("lang", "block", runs, "source", "g", F.coalesce("base", F.lit(1).cast("long")).alias("base"))
    rows = rows.withColumn("row", F.floor((F.col("g") - 1) / ROWS) == F.col("run"))
    key = ["lang", "block", "run"]
    sums = blocked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(accumulate, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    ranked = [part.withColumn("rank", rank) for part in (pairs, terms)]
    return ranked[0].union(ranked[1].where(F.col("rank") <= top_terms))
