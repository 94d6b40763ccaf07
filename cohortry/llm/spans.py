"""Spans of regular-expression matches as built-in column expressions, in code points, ends exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64
EMPTY = "array<struct<s:int,e:int,t:string>>"
WITH_CONTEXT = "array<struct<s:int,e:int,t:string,b:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, x: acc + x)


def _cut(values: Column, block: int = _BLOCK) -> Column:
    """A non-empty array in blocks."""
    return let(values, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda j: F.slice(x, j * block + 1, F.lit(block))))


def _before(numbers: Column) -> Column:
    """For each number the sum of those before it, by adding them up again: for short arrays."""
    return F.transform(numbers, lambda _, i: F.when(i == 0, F.lit(0)).otherwise(_sum(F.slice(numbers, F.lit(1), i))))


def running(numbers: Column, levels: int = 2) -> Column:
    """For each number of an int array, the sum of those before it; over blocks, whose sums are summed over blocks in turn."""
    if levels == 0:
        return _before(numbers)

    def place(z: Column) -> Column:
        return let(running(F.transform(z, _sum), levels - 1), lambda first: F.flatten(F.transform(z, lambda b, j: let(F.get(first, j), lambda at: F.transform(_before(b), lambda v: v + at)))))

    return let(numbers, lambda x: F.when(F.size(x) > 0, let(_cut(x, 32), place)).otherwise(F.array().cast("array<int>")))


def spans(text: Column, pattern: str, context: int = 0) -> Column:
    """The leftmost non-overlapping matches: an array of (s, e, t), t being the matched text.

    With ``context``, also b: the last characters, up to so many, between the match before and this one. Starts are running
    sums of the lengths of gaps and matches, and context comes from the gaps, so that time follows the text's length.
    """
    none = F.array().cast(WITH_CONTEXT if context else EMPTY)

    def place(parts: Column) -> Column:
        def one(at: Column) -> Column:
            def row(p: Column, i: Column) -> Column:
                before = [p["b"].alias("b")] if context else []
                return let(F.get(at, i) + p["gap"], lambda s: F.struct(s.alias("s"), (s + p["len"]).alias("e"), p["t"].alias("t"), *before))

            return F.transform(parts, row)

        return let(running(F.transform(parts, lambda p: p["gap"] + p["len"])), one)

    def found(matches: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def part(p: Column) -> Column:
            before = [F.right(p["g"], F.lit(context)).alias("b")] if context else []
            return F.struct(F.length(p["g"]).alias("gap"), F.length(p["t"]).alias("len"), p["t"].alias("t"), *before)

        parts = F.transform(F.arrays_zip(matches.alias("t"), F.slice(gaps, F.lit(1), F.size(matches)).alias("g")), part)
        return F.when(F.size(matches) > 0, let(parts, place)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), found)


def of_kind(found: Column, kind: int) -> Column:
    """(s, k, e): sorts by start, then kind."""
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def joined(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_of(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda x: x["k"] == kind)).cast("long")


def overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def blocked(found: Column) -> Column:
    """``found`` (sorted by start) cut into blocks of blocks, each with the stretch it covers, for :func:`meets`."""
    stretch = lambda items: F.struct(F.get(items, 0)["s"].alias("s"), F.array_max(F.transform(items, lambda y: y["e"])).alias("e"), items.alias("items"))
    some = lambda values: F.filter(_cut(values), lambda b: F.size(b) > 0)
    return F.transform(some(F.transform(some(found), stretch)), stretch)


def meets(x: Column, blocks: Column, also: Callable[[Column], Column] | None = None) -> Column:
    """Whether ``x`` overlaps a span of the blocks for which ``also`` holds; only blocks that ``x`` overlaps are looked through."""
    one = lambda y: overlaps(x, y) & also(y) if also else overlaps(x, y)
    return F.exists(blocks, lambda c: overlaps(x, c) & F.exists(c["items"], lambda b: overlaps(x, b) & F.exists(b["items"], one)))
