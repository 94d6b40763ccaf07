"""Evidence per k for the plainest segmentation there is: equal bands of a total score.

A table's scores are integers of a small range, so one grouping by score gives a table of cells whose size is that of the range, and
everything per k comes from it. The bands are a baseline that any clustering should better, and give the selection rules an
evidence table that depends on the data alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.functions.expressions import rounded, total


def _band(score: str, k: Column) -> Column:
    low, high = F.col(f"{score}_low"), F.col(f"{score}_high")
    return F.least(k - 1, F.floor((F.col(score) - low) * k / F.greatest(high - low, F.lit(1)))).cast("int")


def _rand(x: DataFrame, other: str) -> DataFrame:
    """k and the adjusted Rand index of the bands and ``other``."""
    pairs = lambda n: n * (n - 1) / 2.0
    cells = x.groupBy("k", "band", other).agg(F.sum("n").cast("double").alias("n"))
    a, b = (cells.groupBy("k", c).agg(F.sum("n").alias("n")).groupBy("k").agg(F.sum(pairs(F.col("n"))).alias(f"_{c}")) for c in ("band", other))
    one = cells.groupBy("k").agg(F.sum(pairs(F.col("n"))).alias("_both"), F.sum("n").alias("_n")).join(a, "k").join(b, "k")
    expected, top = F.col("_band") * F.col(f"_{other}") / pairs(F.col("_n")), (F.col("_band") + F.col(f"_{other}")) / 2
    return one.select("k", rounded(F.when(top == expected, 1.0).otherwise((F.col("_both") - expected) / (top - expected))).alias(f"ari_{other}"))


def banded(df: DataFrame, items: list[str], ks) -> DataFrame:
    """k, band, whole, rest, half (scores), rest_band, half_band, n and the items' sums, from one grouping of ``df``.

    ``whole``: the total of the items, which is banded; ``rest``: without the last item; ``half``: of the first half of them."""
    scored = df.select(total(items).cast("long").alias("whole"), total(items[:-1]).cast("long").alias("rest"), total(items[: len(items) // 2]).cast("long").alias("half"), *items)
    cells = scored.groupBy("whole", "rest", "half").agg(F.count("*").alias("n"), *[F.sum(i).alias(i) for i in items])
    ends = cells.agg(*[x for c in ("whole", "rest", "half") for x in (F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"))])
    each = cells.join(F.broadcast(ends), F.lit(True)).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return each.select("k", _band("whole", F.col("k")).alias("band"), _band("rest", F.col("k")).alias("rest_band"), _band("half", F.col("k")).alias("half_band"), "whole", "rest", "half", "n", *items)


def evidence(df: DataFrame, items: list[str], ks=range(2, 9)) -> DataFrame:
    """One row per k, as the selection rules take it. Stability is agreement with the bands without the last item, agreement of methods that
    with the bands of the first half; silhouettes and spreads are those of the total, with band means in place of rows; BIC is that of normal bands of one variance."""
    x = banded(df, items, ks).cache()
    bands = x.groupBy("k", "band").agg(F.sum("n").cast("double").alias("nb"), (F.sum(F.col("n") * F.col("whole")) / F.sum("n")).alias("m"), *[(F.sum(i) / F.sum("n")).alias(i) for i in items])
    values = x.groupBy("k", "band", "whole").agg(F.sum("n").cast("double").alias("n"))
    other = bands.select("k", F.col("band").alias("_band"), F.col("m").alias("_m"))
    gap = F.abs(F.col("whole") - F.col("_m"))
    near = values.join(other, "k").groupBy("k", "band", "whole", "n").agg(F.max(F.when(F.col("band") == F.col("_band"), gap)).alias("a"), F.min(F.when(F.col("band") != F.col("_band"), gap)).alias("b"))
    s = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    rows = near.groupBy("k").agg((F.sum(F.col("n") * s) / F.sum("n")).alias("silhouette"), F.sum(F.col("n") * F.col("a") * F.col("a")).alias("within"), F.sum("n").alias("n"))
    spread = near.groupBy("k", "band").agg((F.sum(F.col("n") * F.col("a")) / F.sum("n")).alias("s")).join(bands.select("k", "band", "m"), ["k", "band"])
    second = spread.select("k", F.col("band").alias("_band"), F.col("s").alias("_s"), F.col("m").alias("_m"))
    worst = spread.join(second, "k").filter("band != _band").groupBy("k", "band").agg(F.max((F.col("s") + F.col("_s")) / F.abs(F.col("m") - F.col("_m"))).alias("r")).groupBy("k").agg(F.avg("r").alias("davies_bouldin"))
    weighted = bands.withColumn("_g", F.sum(F.col("nb") * F.col("m")).over(W.partitionBy("k")) / F.sum("nb").over(W.partitionBy("k")))
    sizes = weighted.groupBy("k").agg(F.sum(F.col("nb") * F.pow(F.col("m") - F.col("_g"), 2)).alias("between"), F.count("*").alias("found"), (F.min("nb") / F.sum("nb")).alias("min_size_frac"))
    away = [F.col(i) - F.sum(F.col("nb") * F.col(i)).over(W.partitionBy("k")) / F.sum("nb").over(W.partitionBy("k")) for i in items]
    moved = bands.select("k", "nb", *[d.alias(i) for d, i in zip(away, items, strict=True)]).withColumn("_level", reduce(lambda a, b: a + b, [F.col(i) for i in items]) / len(items))
    shape = moved.groupBy("k").agg(F.sum(F.col("nb") * reduce(lambda a, b: a + b, [F.pow(F.col(i) - F.col("_level"), 2) for i in items])).alias("_shape"), F.sum(F.col("nb") * reduce(lambda a, b: a + b, [F.pow(i, 2) for i in items])).alias("_between"))
    out = rows.join(worst, "k").join(sizes, "k").join(shape, "k").join(_rand(x, "rest_band"), "k").join(_rand(x, "half_band"), "k")
    return out.select(
        "k", rounded(F.col("silhouette")).alias("silhouette"), rounded(F.col("davies_bouldin")).alias("davies_bouldin"), rounded((F.col("between") / (F.col("found") - 1)) / (F.col("within") / (F.col("n") - F.col("found")))).alias("calinski_harabasz"),
        rounded(F.col("n") * F.ln(F.col("within") / F.col("n")) + F.col("k") * F.ln("n")).alias("bic_gmm"), F.col("ari_rest_band").alias("bootstrap_ari"), F.col("ari_half_band").alias("cross_algo_ari"),
        rounded(F.col("_shape") / F.col("_between")).alias("differentiation"), rounded(F.col("min_size_frac")).alias("min_size_frac"), rounded(F.col("within")).alias("sse"),
    )


def curves(df: DataFrame, items: list[str], ks=range(1, 9), parts: int = 10, key: str = "row_id") -> DataFrame:
    """k, ref, log_w: log of the mean squared distance from the band's mean, over all rows (ref -1) and over each of ``parts`` by key."""
    scored = df.select(total(items).cast("long").alias("whole"), F.pmod(key, F.lit(parts)).cast("int").alias("part"))
    cells = scored.groupBy("whole", "part").agg(F.count("*").alias("n"))
    ends = cells.agg(F.min("whole").alias("whole_low"), F.max("whole").alias("whole_high"))
    each = cells.join(F.broadcast(ends), F.lit(True)).select("whole", "whole_low", "whole_high", "n", F.explode(F.array(F.lit(-1), F.col("part"))).alias("ref"))
    each = each.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    per = each.groupBy("k", "ref", _band("whole", F.col("k")).alias("band")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("whole")).alias("s"), F.sum(F.col("n") * F.col("whole") * F.col("whole")).alias("q"))
    return per.groupBy("k", "ref").agg(F.ln(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.sum("n")).alias("log_w"))
