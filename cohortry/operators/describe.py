"""Audit and description: one aggregate query for each table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.functions.expressions import longest_run, row_mean, row_sd, rounded
from cohortry.operators.features import level_order


def unpivot(df: DataFrame, keys: list[str], cols: list[str], name: str = "item", value: str = "value") -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keys, cols, name, value)


def audit_quality(df: DataFrame, closed: list[str], items: list[str], texts: list[str], time: str, low: int = 1, high: int = 5) -> DataFrame:
    """Rows, nulls, duplicates with and without the time stamp, values out of range or fractional, and the time window with its peak day: one row."""
    missing = lambda cols: F.sum(reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols])).cast("long")
    outside = reduce(lambda a, b: a + b, [F.coalesce((~F.col(c).between(low, high)).cast("int"), F.lit(0)) for c in items])
    broken = reduce(lambda a, b: a + b, [F.coalesce((F.col(c) != F.floor(c)).cast("int"), F.lit(0)) for c in items])
    whole = F.struct(*[F.col(c) for c in df.columns])
    untimed = F.struct(*[F.col(c) for c in df.columns if c != time])
    facts = df.agg(
        F.count("*").alias("n_rows"), missing(closed).alias("null_closed"), missing(items).alias("null_items"), missing(texts).alias("null_texts"),
        (F.count("*") - F.count_distinct(F.xxhash64(whole))).alias("duplicates"), (F.count("*") - F.count_distinct(F.xxhash64(untimed))).alias("duplicates_untimed"),
        F.sum(outside).cast("long").alias("out_of_range"), F.sum(broken).cast("long").alias("fractional"), F.min(time).alias("first_time"), F.max(time).alias("last_time"),
        (F.floor((F.unix_micros(F.max(time).cast("timestamp")) - F.unix_micros(F.min(time).cast("timestamp"))) / 86_400_000_000) + 1).cast("long").alias("window_days"),
    )
    days = df.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n")).filter("day IS NOT NULL")
    peak = days.agg(F.max_by("day", F.struct(F.col("n"), -F.unix_date("day"))).alias("peak_day"), F.max("n").alias("peak_n"))
    return facts.join(F.broadcast(peak), F.lit(True))


def response_style(df: DataFrame, items: list[str], flat_sd: float = 0.35, run: int = 8, high: int = 5) -> DataFrame:
    """Straight-lining, spread within rows, long runs, extreme use: one row. Takes items as answered, before alignment."""
    row = df.select(F.array(*items).alias("a"), row_sd(items).alias("sd"), longest_run(items).alias("run"))
    share = lambda c: rounded(100.0 * F.avg(c.cast("double")))
    straight = F.size(F.array_distinct("a")) == 1
    return row.agg(
        F.count_if(straight).alias("n_straight"), share(straight).alias("pct_straight"), F.count_if(F.col("sd") < flat_sd).alias("n_flat"), rounded(F.avg("sd")).alias("mean_sd"), rounded(F.min("sd")).alias("min_sd"),
        F.max("run").alias("longest_run"), F.count_if(F.col("run") >= run).alias("n_long_runs"), rounded(100.0 * F.avg(F.size(F.filter("a", lambda x: x == high)) / float(len(items)))).alias("pct_top_box"), share(F.size(F.array_distinct("a")) == high).alias("pct_all_points"),
    )


def quality_table(audit: DataFrame, style: DataFrame) -> DataFrame:
    """check, value: the two one-row tables, one fact to a row."""
    both = audit.join(F.broadcast(style), F.lit(True))
    return both.select(*[F.col(c).cast("string").alias(c) for c in both.columns]).unpivot([], both.columns, "check", "value")


def distribution(df: DataFrame, col: str, order: list[str] | None = None) -> DataFrame:
    """level, n, pct and its place. The window runs over one row per level."""
    counts = df.groupBy(F.col(col).alias("level")).agg(F.count("*").alias("n"))
    out = counts.withColumn("pct", rounded(100.0 * F.col("n") / F.sum("n").over(W.partitionBy())))
    return out.orderBy(*([level_order(F.col("level"), order)] if order else []), "level")


def item_descriptives(df: DataFrame, items: list[str], high: int = 5) -> DataFrame:
    """Per item: mean, sample sd, population skew, agreement, disagreement, top box, counts of each answer, median, ceiling flag."""
    share = lambda c: 100.0 * F.avg(c.cast("double"))
    v = F.col("value")
    return unpivot(df, [], items).groupBy("item").agg(
        F.count("value").alias("n"), rounded(F.avg(v)).alias("mean"), rounded(F.stddev_samp(v)).alias("sd"), rounded(F.skewness(v)).alias("skew"), rounded(share(v >= high - 1)).alias("pct_agree"), rounded(share(v <= 2)).alias("pct_disagree"), rounded(share(v == high)).alias("pct_top_box"),
        *[F.count_if(v == i).alias(f"n_{i}") for i in range(1, high + 1)], F.median(v).alias("median"), ((F.avg(v) >= high - 1) & (share(v == high) >= 45)).alias("ceiling"),
    )


def standardisation_evidence(df: DataFrame, items: list[str]) -> DataFrame:
    """Per item: mean, sd, variance, and how much more it would weigh than the item that varies least."""
    per = unpivot(df, [], items).groupBy("item").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.var_samp("value").alias("variance"))
    return per.select("item", rounded(F.col("mean")).alias("mean"), rounded(F.col("sd")).alias("sd"), rounded(F.col("variance")).alias("variance"), rounded(F.col("variance") / F.min("variance").over(W.partitionBy())).alias("weight_vs_smallest"))


def imbalance(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: levels, largest and smallest level, their ratio, share of the three largest, levels under 25 rows."""
    levels = reduce(DataFrame.unionAll, [df.groupBy(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")).agg(F.count("*").alias("n")) for c in cols])
    ranked = levels.withColumn("k", F.row_number().over(W.partitionBy("variable").orderBy(F.desc("n"), "level")))
    return ranked.groupBy("variable").agg(F.count("*").alias("levels"), F.max("n").alias("largest"), F.min("n").alias("smallest"), rounded(F.max("n") / F.min("n")).alias("ratio"), rounded(100.0 * F.sum(F.when(F.col("k") <= 3, F.col("n")).otherwise(0)) / F.sum("n")).alias("top3_pct"), F.count_if(F.col("n") < 25).alias("small_levels"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long form: a, b, n."""
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def composition(df: DataFrame, a: str, b: str, levels: list) -> DataFrame:
    """Row percentages of ``b`` (its levels as columns) within ``a``."""
    n = F.count("*")
    return df.groupBy(F.col(a).alias("a")).agg(n.alias("n"), *[rounded(100.0 * F.count_if(F.col(b) == v) / n).alias(f"pct_{v}") for v in levels])


def cluster_sizes(df: DataFrame, label: str = "cluster") -> DataFrame:
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("k"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), rounded(F.min("n") / F.sum("n")).alias("min_frac"), rounded(F.max("n") / F.sum("n")).alias("max_frac"))


def cluster_profiles(df: DataFrame, cols: list[str], label: str = "cluster") -> DataFrame:
    """Per cluster: n, share, and the mean of each column."""
    per = df.groupBy(label).agg(F.count("*").alias("n"), *[rounded(F.avg(c)).alias(c) for c in cols])
    return per.withColumn("pct", rounded(100.0 * F.col("n") / F.sum("n").over(W.partitionBy())))


def profile_table(df: DataFrame, items: list[str], label: str = "cluster") -> DataFrame:
    """Item means per cluster and, from the same pass, over all."""
    rolled = df.rollup(label).agg(F.grouping_id().alias("_all"), F.count("*").alias("n"), *[rounded(F.avg(c)).alias(c) for c in items])
    return rolled.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col(label).cast("string")).alias("cluster"), "n", *items)


def z_profile(df: DataFrame, items: list[str], label: str = "cluster") -> DataFrame:
    """(cluster mean - mean) / sd of each item, long form."""
    long = unpivot(df, [label], items)
    whole = long.groupBy("item").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    per = long.groupBy(label, "item").agg(F.avg("value").alias("mean"))
    return per.join(F.broadcast(whole), "item").select(F.col(label).alias("cluster"), "item", rounded((F.col("mean") - F.col("_m")) / F.col("_s")).alias("z"))


def modal(df: DataFrame, group: str, col: str) -> DataFrame:
    """The most frequent level within each group; ties go to the first by name."""
    counts = df.groupBy(group, F.col(col).cast("string").alias("level")).agg(F.count("*").alias("n"))
    first = W.partitionBy(group).orderBy(F.desc("n"), "level")
    return counts.withColumn("_k", F.row_number().over(first)).filter("_k = 1").select(group, F.col("level").alias(f"modal_{col}"), F.col("n").alias(f"n_modal_{col}"))


def background_composition(df: DataFrame, label: str, ordinals: list[str], flags: list[str], nominal: str, levels: list[str], modals: tuple[str, ...] = ()) -> DataFrame:
    """Per cluster and for the whole sample: n, share, mean ordinals, share of flags, share of each level, and the commonest level of ``modals``."""
    n = F.count("*")
    rolled = df.rollup(label).agg(F.grouping_id().alias("_all"), n.alias("n"), *[rounded(F.avg(c)).alias(f"mean_{c}") for c in ordinals], *[rounded(100.0 * F.avg(F.col(c).cast("double"))).alias(f"pct_{c}") for c in flags], *[rounded(100.0 * F.count_if(F.col(nominal) == v) / n).alias(f"pct_{v}") for v in levels])
    whole = F.max(F.col("n")).over(W.partitionBy())
    out = rolled.select(F.when(F.col("_all") == 1, "SAMPLE").otherwise(F.col(label).cast("string")).alias("cluster"), "n", rounded(100.0 * F.col("n") / whole).alias("pct"), *[c for c in rolled.columns if c not in (label, "_all", "n")])
    for c in modals:
        each = df.select(F.col(c), F.explode(F.array(F.col(label).cast("string"), F.lit("SAMPLE"))).alias("cluster"))
        out = out.join(modal(each, "cluster", c).select("cluster", f"modal_{c}"), "cluster", "left")
    return out


def cluster_summary(df: DataFrame, label: str, strain: str, modals: list[str], flags: list[str]) -> DataFrame:
    out = df.groupBy(label).agg(F.count("*").alias("n"), rounded(F.avg(strain)).alias("mean_strain"), rounded(F.stddev_samp(strain)).alias("sd_strain"), *[rounded(100.0 * F.avg(F.col(c).cast("double"))).alias(f"pct_{c}") for c in flags])
    for c in modals:
        out = out.join(modal(df, label, c).select(label, f"modal_{c}"), label, "left")
    return out


def order_by_strain(df: DataFrame, items: list[str], label: str = "cluster") -> DataFrame:
    """cluster, mean strain, rank (1: highest)."""
    per = df.groupBy(label).agg(F.avg(row_mean(items)).alias("_strain"))
    return per.select(F.col(label).alias("cluster"), rounded(F.col("_strain")).alias("strain"), F.row_number().over(W.orderBy(F.desc("_strain"), label)).alias("strain_rank"))


def subscale_report(df: DataFrame, members: dict[str, list[str]]) -> DataFrame:
    """Per subscale: items, alpha, Spearman-Brown for two, mean and sd; one aggregate for all."""
    from cohortry.functions.expressions import total

    parts = {}
    for name, cols in members.items():
        k = len(cols)
        alpha = F.lit(float(k)) / (k - 1) * (1 - reduce(lambda a, b: a + b, [F.var_samp(c) for c in cols]) / F.var_samp(total(cols))) if k > 1 else F.lit(None).cast("double")
        brown = 2 * F.corr(*cols) / (1 + F.corr(*cols)) if k == 2 else F.lit(None).cast("double")
        parts[name] = F.struct(F.lit(name).alias("subscale"), F.lit(k).alias("n_items"), rounded(alpha).alias("alpha"), rounded(brown).alias("spearman_brown"), rounded(F.avg(row_mean(cols))).alias("mean"), rounded(F.stddev_samp(row_mean(cols))).alias("sd"))
    return df.agg(F.array(*parts.values()).alias("a")).select(F.inline("a"))
