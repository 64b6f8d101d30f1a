"""Spans of regular expressions as native array columns, and the digests made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraloom.llm.common import let

BLOCK = 128


def running(values: Column, step: Callable[[Column, Column], Column], zero: Column) -> Column:
    """The running results of step over an array of longs, each with its own value taken in.

    step must be associative with zero as its neutral value. Blocks of BLOCK values are run through apart and then
    shifted by what comes before them, so the time is in proportion to the array, not to its square.
    """

    def along(part: Column) -> Column:
        start = F.array().cast("array<bigint>")
        return F.aggregate(part, start, lambda acc, x: F.concat(acc, F.array(step(F.coalesce(F.try_element_at(acc, F.lit(-1)), zero), x))))

    def blocks(own: Column) -> Column:
        size = F.size(own)
        first = F.sequence(F.lit(0), size - 1, F.lit(BLOCK))
        return F.transform(first, lambda at: along(F.transform(F.sequence(at, F.least(at + BLOCK, size) - 1), lambda i: F.get(own, i))))

    def joined_up(own: Column) -> Column:
        ends = along(F.transform(own, lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), zero)))
        shifted = lambda ends_: F.flatten(F.transform(own, lambda x, i: F.transform(x, lambda y: step(F.coalesce(F.get(ends_, i - 1), zero), y))))
        return let(ends, shifted)

    return let(values, lambda own: F.when(F.size(own) == 0, F.array().cast("array<bigint>")).otherwise(let(blocks(own), joined_up)))


SPAN = "array<struct<start:bigint,stop:bigint,value:string,lead:string>>"
LEAD = 32


def spans(text: Column, pattern: str, ahead: Column | None = None) -> Column:
    """Every leftmost non-overlapping match of a pattern without empty matches, in time linear in the text.

    start and stop in code points, value, and lead: up to LEAD characters between the match before and this one.
    The parts between matches and the matches themselves tell the places. ahead: a cheap condition that holds
    for every text with a match; other texts are not searched.
    """

    def place(found: Column, parts: Column) -> Column:
        sizes = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda part, match: (F.length(part) + F.length(match)).cast("bigint"))
        row = lambda match, stop: F.struct((stop - F.length(match)).alias("start"), stop.alias("stop"), match.alias("value"))
        placed = F.zip_with(found, running(sizes, lambda a, b: a + b, F.lit(0).cast("bigint")), row)
        return F.zip_with(placed, F.slice(parts, 1, F.size(found)), lambda x, part: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"), F.right(part, F.lit(LEAD)).alias("lead")))

    literal = F.lit(pattern)
    some = let(F.regexp_extract_all(text, literal, F.lit(0)), lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda parts: place(found, parts))).otherwise(F.array().cast(SPAN)))
    return some if ahead is None else F.when(ahead, some).otherwise(F.array().cast(SPAN))


def labelled(found: Column, kind: str, rank: int) -> Column:
    """Spans with their kind and its place in the list of kinds; sorting gives the order of digests."""
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop"), F.lit(kind).alias("kind"), x["value"].alias("value")))


def joined(found: Column) -> Column:
    """kind:start:end of labelled spans by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.sort_array(found), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def apart(found: Column, base: Column) -> Column:
    """The spans of found, which do not overlap one another, that overlap none of base; in time n log n.

    All spans stand in order of start, base first at equal starts. One of found meets a span of base if one before it
    ends after its start, or the next one after it starts before its end.
    """
    far = F.lit((1 << 62)).cast("bigint")

    def swept(all_: Column) -> Column:
        ends = running(F.transform(all_, lambda x: F.when(x["own"] == 0, x["span"]["stop"]).otherwise(F.lit(0).cast("bigint"))), lambda a, b: F.greatest(a, b), F.lit(0).cast("bigint"))
        starts = running(F.transform(F.reverse(all_), lambda x: F.when(x["own"] == 0, x["span"]["start"]).otherwise(far)), lambda a, b: F.least(a, b), far)
        both = F.zip_with(F.zip_with(all_, ends, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), F.reverse(starts), lambda p, s: F.struct(p["x"].alias("x"), p["e"].alias("e"), s.alias("s")))
        return F.transform(F.filter(both, lambda p: (p["x"]["own"] == 1) & (p["e"] <= p["x"]["span"]["start"]) & (p["s"] >= p["x"]["span"]["stop"])), lambda p: p["x"]["span"])

    mark = lambda spans_, own: F.transform(spans_, lambda x: F.struct(x["start"].alias("at"), F.lit(own).alias("own"), x.alias("span")))
    meet = lambda f, b: F.when((F.size(f) > 0) & (F.size(b) > 0), let(F.sort_array(F.concat(mark(b, 0), mark(f, 1))), swept)).otherwise(f)
    return let(found, lambda f: let(base, lambda b: meet(f, b)))
