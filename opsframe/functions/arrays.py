"""Native expressions over arrays and the matches of a pattern, linear in the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before_each(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array all before it combined, from 0 on; ``combine`` is associative.

    An array that grows by one is copied each time. So this works in chunks: the copies
    are a few dozen entries long, not as long as the array.
    """

    def running(some: Column, first: Column) -> Column:
        state = F.struct(first.alias("total"), F.array().cast("array<long>").alias("found"))
        step = lambda s, v: F.struct(combine(s["total"], v).alias("total"), F.concat(s["found"], F.array(s["total"])).alias("found"))
        return F.aggregate(some, state, step)["found"]

    zero = F.lit(0).cast("long")
    whole = lambda c: F.transform(c, lambda x: F.aggregate(x, zero, combine))
    chunked = let(_chunks(values), lambda c: F.flatten(F.zip_with(c, running(whole(c), zero), running)))
    # Most arrays are one chunk.
    return F.when(F.size(values) > _CHUNK, chunked).otherwise(running(values, zero))


def _chunks(values: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(_CHUNK))
    return F.transform(places, lambda at: F.slice(values, at, F.lit(_CHUNK)))


def states(values: Column, first: Column, step: Callable[[Column, Column], Column], field: str) -> Column:
    """A field of the state, a struct, after each value of an array; ``values`` is named more than once.

    Works in chunks as ``before_each`` does; the state goes from chunk to chunk.
    """

    def running(some: Column, state: Column, more: Callable[[Column, Column], Column], none: str) -> Column:
        begin = F.struct(state.alias("state"), F.array().cast(none).alias("found"))
        return F.aggregate(some, begin, more)

    def each(s: Column, v: Column) -> Column:
        return let(step(s["state"], v), lambda now: F.struct(now.alias("state"), F.concat(s["found"], F.array(now[field])).alias("found")))

    def chunk(s: Column, c: Column) -> Column:
        made = running(c, s["state"], each, "array<boolean>")
        return let(made, lambda m: F.struct(m["state"].alias("state"), F.concat(s["found"], F.array(m["found"])).alias("found")))

    chunked = F.flatten(running(_chunks(values), first, chunk, "array<array<boolean>>")["found"])
    return F.when(F.size(values) > _CHUNK, chunked).otherwise(running(values, first, each, "array<boolean>")["found"])


def sums_before(lengths: Column) -> Column:
    return before_each(lengths, lambda total, n: total + n)


def placed(text: Column, pattern: str, span: Callable[[Column, Column], Column]) -> Column:
    """``span`` of the start (from 0) and the text of each match of a pattern, in order."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap).cast("long"))

    def place(pieces: Column) -> Column:
        both = F.zip_with(pieces["gaps"], pieces["matches"], lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        # The last gap follows the last match.
        return let(F.slice(both, F.lit(1), F.size(pieces["matches"])), pieced)

    def pieced(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda p: p["gap"] + F.length(p["match"]))
        return F.zip_with(let(lengths, sums_before), pairs, lambda b, p: span(b + p["gap"], p["match"]))

    return let(F.struct(matches.alias("matches"), gaps.alias("gaps")), place)
