"""Entity extraction: one pattern pass in text order, joined by names from a gazetteer table.

A different model from a statistical tagger with the same output contract, ``array<struct<text, label>>``: one list in text
order whose entities do not overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.text import text_or_empty
from pagesieve.schemas import ENTITIES
from pagesieve.session import cut_lineage

_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_HOST = r"[A-Za-z0-9][A-Za-z0-9\-]*+(?:\.[A-Za-z0-9\-]++)*+"

# What the whole of an item must match to get a label, in order of precedence.
PATTERNS = {
    "MONEY": r"[$€£] ?[0-9]++(?:,[0-9]++)*+(?:\.[0-9]++)?+",
    "PERCENT": r"[0-9]+(?:\.[0-9]+)? ?%",
    "DATE": rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}} {_MONTH} [0-9]{{4}}|{_MONTH} [0-9]{{1,2}}, [0-9]{{4}}",
    "TIME": r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?",
    "ORG": rf"{_HOST}(?<=\.(?:com|org|net))",
    "CARDINAL": r"[0-9]++(?:[.,][0-9]++)*+",
}
_WORD_CHARACTER = r"[\p{L}\p{N}_]"
NAME_WORD = f"{_WORD_CHARACTER}+"
# Items cut the text: at every place the first of these, with the rest of a word it ends in. So no entity ends inside a
# word, and as every word is part of an item none begins there. No loop has to give back: long texts need no stack.
_ITEM = "|".join(
    f"(?:{pattern}){_WORD_CHARACTER}*+"
    for pattern in (
        PATTERNS["MONEY"], PATTERNS["PERCENT"], PATTERNS["DATE"], PATTERNS["TIME"],
        rf"{PATTERNS['CARDINAL']}{_WORD_CHARACTER}*+(?:\.[A-Za-z][A-Za-z0-9\-]*+)*+", _HOST, _WORD_CHARACTER,
    )
)
# Most items are plain words and are dismissed by how they begin and end.
_MAY_BE_LABELLED = r"^[$€£0-9]|\.(?:com|org|net)$|^[A-Z][a-z]+ [0-9]"
# Measured bytes of the names that are sent to the texts, at most, counting what one takes besides its text.
_BROADCAST_BYTES, _NAME_BYTES = 32_000_000, 200


def _label(item: Column) -> Column:
    label = F.lit(None).cast("string")
    for name in reversed(PATTERNS):
        label = F.when(item.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(label)
    return F.when(item.rlike(_MAY_BE_LABELLED), label)


def _items(text: Column | str) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(_ITEM), F.lit(0))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NAME_WORD), F.lit(0))


def pattern_entities(text: Column | str) -> Column:
    """Entities found by pattern, in text order."""
    labelled = F.transform(_items(text), lambda i: F.struct(i.alias("text"), _label(i).alias("label")))
    return F.filter(labelled, lambda e: e["label"].isNotNull())


def _placed_patterns(text: Column | str) -> Column:
    """Pattern entities as ``array<struct<pos, longer, kind, n, text, label>>``: place and length in words of the text."""

    def cells(item: Column) -> Column:
        words = _words(item)
        entity = F.struct(F.size(words).alias("n"), item.alias("text"), _label(item).alias("label"))
        return F.transform(words, lambda _, at: F.when(at == 0, entity))

    placed = F.transform(F.flatten(F.transform(_items(text), cells)), lambda e, at: _candidate(at, 1, e["n"], e["text"], e["label"]))
    return F.filter(placed, lambda e: e["label"].isNotNull())


def _candidate(pos: Column, kind: int, n: Column, text: Column, label: Column) -> Column:
    """Sorts by place, then the longest first, then gazetteer names (kind 0) before patterns (kind 1)."""
    return F.struct(
        pos.cast("int").alias("pos"), (-n).cast("int").alias("longer"), F.lit(kind).alias("kind"), n.cast("int").alias("n"),
        text.alias("text"), label.alias("label"),
    )


def anchored_names(gazetteer: DataFrame) -> DataFrame:
    """``(anchor, offset, run, n, label)``: every distinct name once, looked up by its rarest word.

    Rarest is the word that the fewest names hold; of equals the longest, then the smallest, then the first. A text meets a name only
    where it has that word, so common words of long names cost nothing.
    """
    names = (
        gazetteer.select(F.transform(_words(F.col("name")), F.lower).alias("words"), "label")
        .where(F.size("words") > 0)
        .groupBy(F.array_join("words", " ").alias("run"), F.size("words").alias("n"))
        .agg(F.min("label").alias("label"))
    )
    placed = names.select("run", "n", "label", F.posexplode(F.split("run", " ")).alias("offset", "anchor"))
    held = placed.groupBy("anchor").agg(F.countDistinct("run").alias("names"))
    rarest = F.min(F.struct("names", (-F.length("anchor")).alias("shorter"), "anchor", "offset")).alias("least")
    return (
        placed.join(held, "anchor").groupBy("run", "n", "label").agg(rarest)
        .select("least.anchor", "least.offset", "run", "n", "label")
    )


def _mentions(known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For every text the places where a name stands: its anchor is there and the words around it are the name's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = known.value
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("label", pa.string())]))
        for batch in batches:
            found = []
            for words in batch.column("lowered").to_pylist():
                here = []
                for at, word in enumerate(words):
                    for offset, name, label in anchors.get(word, ()):
                        if at >= offset and words[at - offset : at - offset + len(name)] == name:
                            here.append({"pos": at - offset, "n": len(name), "label": label})
                found.append(here or None)
            kept = [c for c in batch.schema.names if c != "lowered"]
            columns = [*(batch.column(c) for c in kept), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "mentions"])

    return run


def _placed(mentions: Column, words: Column) -> Column:
    """Mentions as candidates, with the words of the text as it has them."""
    return F.transform(
        mentions, lambda m: _candidate(m["pos"], 0, m["n"], F.array_join(F.slice(words, m["pos"] + 1, m["n"]), " "), m["label"])
    )


def gazetteer_mentions(
    docs: DataFrame, gazetteer: DataFrame, key: str = "key", text: str = "visible_text", broadcast_bytes: int | None = None
) -> DataFrame:
    """``(key, names)``: every mention of a gazetteer name as candidates for the document's list.

    ``gazetteer`` is ``(name, label)``. Names and texts are cut into words alike, case and what lies between words ignored, and
    a name may have any number of words. Names go to the texts where their measured bytes allow it, and nothing is shuffled. Beyond,
    each text's words meet the names anchored at them, and what is met is confirmed on the text, which moves once, on its key.
    """
    anchors = cut_lineage(anchored_names(gazetteer))
    size = anchors.agg(F.sum(F.octet_length("run") * 2 + F.coalesce(F.octet_length("label"), F.lit(0)) + _NAME_BYTES)).first()[0] or 0
    texts = docs.select(key, _words(text_or_empty(text)).alias("words"))
    lowered = F.transform("words", F.lower).alias("lowered")
    if size <= (_BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        names: dict[str, list[tuple[int, list[str], str]]] = {}
        for a in anchors.toLocalIterator():
            names.setdefault(a.anchor, []).append((a.offset, a.run.split(" "), a.label))
        known = docs.sparkSession.sparkContext.broadcast(names)
        kind = docs.schema[key].dataType.simpleString()
        schema = f"`{key}` {kind}, words array<string>, mentions array<struct<pos: int, n: int, label: string>>"
        found = texts.select(key, "words", lowered).mapInArrow(_mentions(known), schema).where("mentions IS NOT NULL")
        return found.select(key, _placed(F.col("mentions"), F.col("words")).alias("names"))
    met = texts.select(key, F.posexplode(F.transform("words", F.lower)).alias("at", "anchor")).join(anchors, "anchor")
    met = met.where("at >= offset").select(key, (F.col("at") - F.col("offset")).alias("pos"), "n", "run", "label")
    begun = met.groupBy(key).agg(F.collect_list(F.struct("pos", "n", "run", "label")).alias("begun"))
    stands = F.filter("begun", lambda m: F.array_join(F.transform(F.slice(F.col("words"), m["pos"] + 1, m["n"]), F.lower), " ") == m["run"])
    confirmed = texts.join(begun, key).select(key, "words", stands.alias("mentions")).where(F.size("mentions") > 0)
    return confirmed.select(key, _placed(F.col("mentions"), F.col("words")).alias("names"))


def _without_overlap(candidates: Column) -> Column:
    """From left to right the longest candidate at each place, then on behind it."""
    start = F.struct(F.lit(0).alias("end"), F.array().cast(ENTITIES).alias("taken"))

    def step(state: Column, c: Column) -> Column:
        taken = F.concat(state["taken"], F.array(F.struct(c["text"].alias("text"), c["label"].alias("label"))))
        return F.when(
            c["pos"] >= state["end"], F.struct((c["pos"] + c["n"]).alias("end"), taken.alias("taken"))
        ).otherwise(state)

    return F.aggregate(F.array_sort(candidates), start, step, lambda state: state["taken"])


def extract_entities(
    docs: DataFrame, gazetteer: DataFrame | None = None, key: str = "key", text: str = "visible_text", broadcast_bytes: int | None = None
) -> DataFrame:
    """``(key, entities)`` for every document, in text order without overlap; blank text gives an empty array.

    Of entities that overlap the one that begins first stays, of those the longest, then a gazetteer name. A name is given as
    the words of the text with single spaces between them.
    """
    if gazetteer is None:
        return docs.select(key, pattern_entities(text).alias("entities"))
    found = docs.select(key, _placed_patterns(text).alias("patterns"))
    only_patterns = F.transform("patterns", lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label")))
    names = gazetteer_mentions(docs, gazetteer, key, text, broadcast_bytes)
    return found.join(names, key, "left").select(
        key,
        F.when(F.col("names").isNull(), only_patterns)
        .otherwise(_without_overlap(F.concat("patterns", "names")))
        .alias("entities"),
    )


def format_entities(entities: Column | str) -> Column:
    """``"LABEL: text"`` strings, order kept; null when there is none."""
    found = F.col(entities) if isinstance(entities, str) else entities
    return F.when(F.size(found) > 0, F.transform(found, lambda e: F.concat(e["label"], F.lit(": "), e["text"])))
