"""Pattern matches with their positions, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sorted as a struct: by start, then by the kind's rank.
SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"
SPANS = "array<struct<start:int,rank:int,kind:string,end:int,owners:bigint,repositories:bigint,verdict:string>>"


def matches(
    text: str, pattern: str, kind: str, rank: int, keep: Callable[[Column], Column] | None = None, value: Callable[[Column], Column] | None = None
) -> Column:
    """All leftmost non-overlapping matches as spans: start and end in code points, end exclusive; ``keep`` drops failing ones.

    A regular-expression function tells what matched, not where: the positions are running sums over the lengths of the matches
    and of the gaps between them, which are what splitting at the same pattern leaves. Texts without a match are not split.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"))
    empty = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["match"])
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"),
            (value(part["match"]) if value else part["match"]).alias("value"),
        )
        wanted = part["match"].isNotNull() & (keep(part["match"]) if keep else F.lit(True))
        return F.struct(
            F.coalesce(end, state["at"]).alias("at"), F.when(wanted, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out")
        )

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(parts, start, step, lambda state: state["out"])).otherwise(empty)


def without_overlaps(spans: str, base: Column) -> Column:
    """The spans that share no character with one of ``base``."""
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
