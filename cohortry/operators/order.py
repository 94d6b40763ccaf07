"""Ranks and exact quantiles of one column, from counts per value.

Values lie in cells between approximate quantiles of the distinct values. Counts are summed within a cell and over the cells
before it, so that neither a window nor an aggregation buffer holds all values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_counts(df: DataFrame, col: str, cells: int = 256) -> DataFrame:
    """value (double), n, upto: how many rows have this value, and this or a smaller one. Nulls are left out."""
    values = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("value")).agg(F.count("*").alias("n"))
    cuts = values.agg(F.percentile_approx("value", [i / cells for i in range(1, cells)], 10 * cells)).first()[0] or []
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    placed = values.withColumn("_cell", F.size(F.filter(edges, lambda e: e < F.col("value"))))
    per = placed.groupBy("_cell").agg(F.sum("n").alias("_n"))
    before = per.select("_cell", (F.sum("_n").over(W.orderBy("_cell")) - F.col("_n")).alias("_before"))  # one row per cell
    inside = F.sum("n").over(W.partitionBy("_cell").orderBy("value"))
    return placed.join(F.broadcast(before), "_cell").select("value", "n", (F.col("_before") + inside).alias("upto"))


def average_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """Adds ``out``, the rank of ``col`` from 1, ties sharing their mean. Rows without a value go."""
    ranks = running_counts(df, col).select(F.col("value").alias("_value"), (F.col("upto") - (F.col("n") - 1) / 2.0).alias(out))
    return df.join(ranks, F.col(col).cast("double") == F.col("_value")).drop("_value")


def quantiles(df: DataFrame, col: str, shares: list[float]) -> DataFrame:
    """One row, ``edges``: exact quantiles, linearly interpolated between neighbours; null for an empty column."""
    counts = running_counts(df, col)
    n = F.max("upto")
    reached = counts.agg(n.alias("_n")).first()["_n"]
    if not reached:
        return counts.agg(F.array(*[F.max("value") for _ in shares]).alias("edges"))
    edges = []
    for share in shares:
        at = share * (reached - 1)
        low, high = math.floor(at), math.ceil(at)
        lower, upper = F.min(F.when(F.col("upto") > low, F.col("value"))), F.min(F.when(F.col("upto") > high, F.col("value")))
        edges.append(lower if low == high else (high - at) * lower + (at - low) * upper)
    return counts.agg(F.array(*edges).alias("edges"))
