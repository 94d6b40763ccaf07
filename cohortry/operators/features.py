"""Projections: alignment, standardisation, subscales, encodings, bins and feature spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.expressions import row_mean
from cohortry.operators.order import quantiles


def align(df: DataFrame, reversed_items: list[str], low: int = 1, high: int = 5) -> DataFrame:
    """Reverse-codes items that point the other way."""
    return df.withColumns({c: (F.lit(low + high) - F.col(c)).cast("int") for c in reversed_items})


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` beside the columns of ``one``, which is an ungrouped aggregate: always one row, so it is broadcast."""
    return df.join(F.broadcast(one), F.lit(True))


def standardise(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """Z-scores by population deviation; a constant column gives 0. One aggregate, then a projection."""
    stats = df.agg(*[f(c).alias(f"_{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    return with_row(df, stats).withColumns({c + suffix: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in cols}).drop(*stats.columns)


def subscales(df: DataFrame, members: dict[str, list[str]]) -> DataFrame:
    """Row means of the members of each subscale."""
    return df.withColumns({name: row_mean(cols) for name, cols in members.items()})


def assign_subscales(loadings, items: list[str], names: list[str], alone: str | None = None) -> dict[str, list[str]]:
    """Each item goes to the factor on which it loads most; ``alone`` may split one item off. Raises if a factor stays empty."""
    members: dict[str, list[str]] = {n: [] for n in names}
    for item, row in zip(items, abs(loadings), strict=True):
        members[names[int(row.argmax())]].append(item)
    if empty := [n for n, m in members.items() if not m]:
        raise ValueError(f"no item loads most on {empty}")
    if alone and not any(m == [alone] for m in members.values()):
        members = {n: [i for i in m if i != alone] for n, m in members.items()} | {alone: [alone]}
    return members


def one_hot(df: DataFrame, col: str, levels: list[str]) -> DataFrame:
    """A 0/1 column for each level."""
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in levels})


def encode_background(df: DataFrame, nominal: list[str], ordinal: list[str], exclude: tuple[str, ...] = (), keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Nominal columns as flags of their levels, ordinal ones as they are; names or prefixes in ``exclude`` are left out, so that nothing leaks. Levels are read in one pass."""
    wanted = [c for c in nominal if not c.startswith(exclude or ("\0",))]
    levels = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in wanted]).first() if wanted else {}
    out = df
    for c in wanted:
        out = one_hot(out, c, list(levels[c]))
    flags = [c for c in out.columns if c not in df.columns]
    return out.select(*keep, *[c for c in ordinal if not c.startswith(exclude or ("\0",))], *flags)


def quantile_cut(df: DataFrame, col: str, shares: list[float], labels: list[str], out: str) -> DataFrame:
    """Right-closed bins at linearly interpolated quantiles; equal edges are merged downwards."""
    edges = quantiles(df, col, shares).withColumnRenamed("edges", "_edges")
    placed = F.lit(labels[-1])
    for i in range(len(shares) - 1, -1, -1):
        placed = F.when(F.col(col) <= F.get("_edges", F.lit(i)), labels[i]).otherwise(placed)
    return with_row(df, edges).withColumn(out, F.when(F.col(col).isNotNull(), placed)).drop("_edges")


def tertiles(df: DataFrame, col: str, out: str = "stratum") -> DataFrame:
    return quantile_cut(df, col, [1 / 3, 2 / 3], ["low", "mid", "high"], out)


def level_order(c: Column, levels: list[str]) -> Column:
    """Sort key: the fixed order, then whatever else by name."""
    place = F.lit(len(levels))
    for i, v in enumerate(levels):
        place = F.when(c == v, i).otherwise(place)
    return place


def feature_spaces(df: DataFrame, items: list[str], scales: dict[str, dict[str, list[str]]], extra: str | None = None) -> dict[str, tuple[DataFrame, list[str]]]:
    """Standardised spaces: the items, each set of subscales, and each set with ``extra``. Name to (DataFrame, columns)."""
    spaces = {"items": (standardise(df, items), items)}
    for name, members in scales.items():
        scored, cols = subscales(df, members), list(members)
        spaces[name] = standardise(scored, cols), cols
        if extra:
            spaces[f"{name}+{extra}"] = standardise(scored.withColumn(extra, F.col(extra).cast("double")), [*cols, extra]), [*cols, extra]
    return spaces


def build_background(df: DataFrame, texts: list[str], flags: dict[str, str] | None = None, bands: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` with trimmed ``texts``, a 0/1 flag where an answer starts with its stem in any case (null: 0), and ``c_ord`` from 1 for each banded column.

    A value that is none of its bands raises when its row is read; a null has no place.
    """
    out = df.withColumns({c: F.trim(F.col(c).cast("string")) for c in [*texts, *(bands or {})]})
    out = out.withColumns({c: F.coalesce(F.lower(F.trim(F.col(c).cast("string"))).startswith(stem.lower()), F.lit(False)).cast("int") for c, stem in (flags or {}).items()})
    place = lambda c, levels: F.when(F.col(c).isNull(), F.lit(None).cast("int")).when(F.col(c).isin(levels), F.array_position(F.array(*map(F.lit, levels)), F.col(c)).cast("int")).otherwise(F.raise_error(F.concat(F.lit(f"{c}: no band: "), F.col(c))).cast("int"))
    return out.withColumns({f"{c}_ord": place(c, levels) for c, levels in (bands or {}).items()})


def split_holdout(df: DataFrame, stratum: str, share: float = 0.3, seed: int = 42, key: str = "row_id", digits: int = 4) -> DataFrame:
    """``split`` is holdout for exactly the rounded share of each stratum, by hashed rank: the same rows on every run.

    Ranks come from counts per cell of the hash (16 ** ``digits`` cells, which do not change the result), so that a large stratum is not one task.
    """
    from pyspark.sql import Window as W

    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    rows = df.withColumn("_order", order).withColumn("_cell", F.substring("_order", 1, digits))
    cells = rows.groupBy(stratum, "_cell").agg(F.count("*").alias("_n"))
    before = cells.select(F.col(stratum).alias("_s"), F.col("_cell").alias("_c"), (F.sum("_n").over(W.partitionBy(stratum).orderBy("_cell")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(stratum)).alias("_all"))
    placed = rows.join(before, rows[stratum].eqNullSafe(before["_s"]) & (rows["_cell"] == before["_c"]))
    rank = F.col("_before") + F.row_number().over(W.partitionBy(stratum, "_cell").orderBy("_order", key))
    return placed.withColumn("split", F.when(rank <= F.round(F.col("_all") * share), "holdout").otherwise("train")).drop("_order", "_cell", "_s", "_c", "_before", "_all")
