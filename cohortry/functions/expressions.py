"""Column expressions that several operators use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6


def rounded(c: Column, digits: int = DIGITS) -> Column:
    return F.round(c, digits)


def total(cols: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols])


def row_mean(cols: list[str]) -> Column:
    return total(cols) / float(len(cols))


def row_sd(cols: list[str]) -> Column:
    """Population standard deviation within a row."""
    mean = row_mean(cols)
    return F.sqrt(reduce(lambda a, b: a + b, [(F.col(c) - mean) * (F.col(c) - mean) for c in cols]) / float(len(cols)))


def longest_run(cols: list[str]) -> Column:
    """Length of the longest run of equal neighbours among ``cols``."""
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("now"), F.lit(None).cast("int").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        now = F.when(acc["last"] == x, acc["now"] + 1).otherwise(1)
        return F.struct(F.greatest(acc["best"], now).alias("best"), now.alias("now"), x.cast("int").alias("last"))

    return F.aggregate(F.array(*[F.col(c).cast("int") for c in cols]), start, step, lambda acc: acc["best"])


def average_rank(order: Column, over_all, ties) -> Column:
    """Ranks that share their mean among ties. ``over_all``: a window ordered by the value; ``ties``: one partitioned by it."""
    return F.rank().over(over_all) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def banded(c: Column, bounds: list[float], labels: list[str]) -> Column:
    """Right-open bands: the first label below the first bound, and so on."""
    out = F.lit(labels[-1])
    for bound, label in reversed(list(zip(bounds, labels, strict=False))):
        out = F.when(c < bound, label).otherwise(out)
    return F.when(c.isNotNull(), out)


def effect_size(c: Column) -> Column:
    """Eta squared: closed on the right."""
    return F.when(c <= 0.01, "negligible").when(c <= 0.06, "small").when(c <= 0.14, "medium").when(c.isNotNull(), "large")


def association_size(c: Column) -> Column:
    return banded(c, [0.10, 0.20, 0.30], ["negligible", "small", "moderate", "large"])


def answered(c: Column) -> Column:
    """Whether anything but white space was written."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")) > 0


NON_ANSWERS = r"(?i)^\s*(?:n\s*/?\s*a|none|no|nothing|nil|same|same as (?:above|before)|no comments?|don'?t know|idk|[-.?*_]+)\s*[.!]?\s*$"


def non_answer(c: Column) -> Column:
    """Procedural answers that say nothing."""
    return answered(c) & c.rlike(NON_ANSWERS)
