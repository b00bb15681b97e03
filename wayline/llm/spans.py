"""Pattern matches with their places, from built-in functions only.

Patterns are Java regular expressions. Their repeated groups are possessive, which the matcher runs as loops, and their
first characters can't be entered in the middle of a run, so long texts cost time in proportion to their length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
MATCH = "struct<start:int,end:int,text:string,part:string,before:string,after:string>"


def matches(text: Column, pattern: str, group: int = 0, wanted: Column | None = None, context: int = 24) -> Column:
    """All leftmost non-overlapping matches in order: array of MATCH.

    start and end count code points, end is exclusive; part is the given group; before and after are up to context
    characters between this match and its neighbours. Where wanted is false, or the text null, the array is empty and
    the pattern isn't run.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.split(text, pattern, -1)
    n = F.size(found)
    rows = F.arrays_zip(F.slice(pieces, 1, n).alias("piece"), found.alias("text"), parts.alias("part"), F.slice(pieces, 2, n).alias("next"))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["piece"])
        end = start + F.length(row["text"])
        match = F.struct(
            start.alias("start"), end.alias("end"), row["text"].alias("text"), row["part"].alias("part"),
            F.right(row["piece"], F.lit(context)).alias("before"), F.left(row["next"], F.lit(context)).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(match)).alias("out"))

    none = F.array().cast(f"array<{MATCH}>")
    # A fold copies what it has gathered at each step, so places are folded by blocks: first where blocks begin.
    block = lambda k: F.slice(rows, k * BLOCK + 1, F.lit(BLOCK))
    width = lambda k: F.aggregate(block(k), F.lit(0), lambda n, row: n + F.length(row["piece"]) + F.length(row["text"]))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda state, k: F.struct((state["at"] + width(k)).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))
    begins = F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), begin, add, lambda s: s["out"])
    out = F.flatten(F.transform(begins, lambda at, k: F.aggregate(block(k), F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"])))
    asked = text.isNotNull() if wanted is None else text.isNotNull() & wanted
    return F.when(asked & F.coalesce(text.rlike(pattern), F.lit(False)), out).otherwise(none)


def marked(found: Column, kind: str, order: int) -> Column:
    """Matches as spans: array of struct(start, place, end, kind); place is the kind's place in the list of kinds."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("place"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def outermost(spans: Column) -> Column:
    """Of spans in order those that begin at or behind the furthest end of all before them: array of struct(from, start, kind), from being that end.

    Furthest ends are folded by blocks, as places of matches are.
    """
    block = lambda k: F.slice(spans, k * BLOCK + 1, F.lit(BLOCK))
    reach = lambda k: F.array_max(F.transform(block(k), lambda s: s["end"]))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda state, k: F.struct(F.greatest(state["at"], reach(k)).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))
    begins = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), begin, add, lambda s: s["out"])
    none = F.array().cast("array<struct<from:int,start:int,kind:string>>")

    def step(state: Column, s: Column) -> Column:
        span = F.struct(state["at"].alias("from"), s["start"].alias("start"), s["kind"].alias("kind"))
        kept = F.when(s["start"] >= state["at"], F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), kept.alias("out"))

    return F.flatten(F.transform(begins, lambda at, k: F.aggregate(block(k), F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"])))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def joined(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind in listed order, then end, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    reverse = F.reverse(digits)

    def step(total: Column, i: Column) -> Column:
        digit = F.substring(reverse, i, F.lit(1)).cast("int")
        double = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(double > 9, double - 9).otherwise(double))

    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    return (F.length(digits) > 0) & (F.aggregate(places, F.lit(0), step) % 10 == 0)
