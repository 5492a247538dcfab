"""Matches of a regular expression with their places, in DataFrame functions only.

The text between matches (split) and the matches themselves (regexp_extract_all) come from the same
pattern, so the running sum of both lengths gives each match's place in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
#: Matches whose places are summed one after the other; more of them are summed part by part.
PART = 256


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def placed(rows: Column, at: Column, around: int | None) -> Column:
    """The spans of some matches (gap, hit, next), the first gap of which starts at `at`."""
    state = F.struct(at.alias("at"), F.lit(None).cast(SPAN).alias("out"))

    def edge(gap: Column, side) -> Column:
        if around == 0:
            return F.lit("")
        return gap if around is None else F.when(F.length(gap) > around, side(gap, F.lit(around))).otherwise(gap)

    def step(s: Column, r: Column) -> Column:
        start = s["at"] + F.length(r["gap"])
        end = start + F.length(r["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), r["hit"].alias("value"), edge(r["gap"], F.right).alias("before"), edge(F.coalesce(r["next"], F.lit("")), F.left).alias("after")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(r["hit"].isNull(), s["out"]).when(s["out"].isNull(), one).otherwise(F.concat(s["out"], one)).alias("out"))

    return F.aggregate(rows, state, step, lambda s: s["out"])


def matches(text: Column, pattern: str, around: int | None = 0) -> Column:
    """array<struct<start,end,value,before,after>> of leftmost non-overlapping matches of a pattern that
    never matches the empty string; before and after: up to `around` code points (None: all) between this
    match and its neighbours. Time grows with the text, however many matches it has."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = let(gaps, lambda g: F.arrays_zip(g.alias("gap"), found.alias("hit"), F.slice(g, 2, F.size(g)).alias("next")))

    def long(r: Column) -> Column:
        return F.length(r["gap"]) + F.coalesce(F.length(r["hit"]), F.lit(0))

    def in_parts(rows: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / PART).cast("int")), lambda i: F.slice(rows, i * PART + 1, F.lit(PART)))
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, r: s + long(r)))
        ends = F.aggregate(sums, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
        each = F.zip_with(parts, ends, lambda p, at: F.coalesce(placed(F.coalesce(p, F.array().cast("array<struct<gap:string,hit:string,next:string>>")), at, around), F.array().cast(SPAN)))
        return F.flatten(each)

    spans = let(rows, lambda r: F.when(F.size(r) <= PART, placed(r, F.lit(0), around)).otherwise(in_parts(r)))
    return F.coalesce(spans, F.array().cast(SPAN))


def matches_where(condition: Column, text: Column, pattern: str, around: int | None = 0) -> Column:
    """As matches, looked for only where a cheaper test says there can be any."""
    return F.when(condition, matches(text, pattern, around)).otherwise(F.array().cast(SPAN))
