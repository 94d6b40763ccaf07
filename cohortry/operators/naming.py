"""Names, advice and cards for clusters, from their standardised profiles and rule tables given as data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.functions.expressions import rounded
from cohortry.operators.describe import modal


def persona_names(profiles: DataFrame, phrases: dict[str, tuple[str, str]], eligible: list[str] | None = None, least: float = 0.35, most_terms: int = 3, fallback: str = "Average profile") -> DataFrame:
    """profiles: cluster, item, z. Up to ``most_terms`` strongest dimensions with abs(z) >= ``least`` become phrases (low, high), joined; repeated names get a number.

    ``eligible``: the dimensions whose effect is large enough to name a cluster by.
    """
    spark = profiles.sparkSession
    words = spark.createDataFrame([(d, lo, hi) for d, (lo, hi) in phrases.items()], "item string, lo string, hi string")
    known = profiles.join(F.broadcast(words), "item") if eligible is None else profiles.filter(F.col("item").isin(eligible)).join(F.broadcast(words), "item")
    strong = known.filter(F.abs("z") >= least).withColumn("_k", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc(F.abs("z")), "item"))).filter(F.col("_k") <= most_terms)
    terms = strong.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("_k", F.when(F.col("z") > 0, F.col("hi")).otherwise(F.col("lo")).alias("t"), F.concat("item", F.when(F.col("z") > 0, " high").otherwise(" low")).alias("d")))).alias("x"))
    named = profiles.select("cluster").distinct().join(terms, "cluster", "left").select("cluster", F.coalesce(F.array_join(F.transform("x", lambda v: v["t"]), " & "), F.lit(fallback)).alias("name"), F.coalesce(F.array_join(F.transform("x", lambda v: v["d"]), ", "), F.lit("")).alias("defining"))
    again = F.row_number().over(W.partitionBy("name").orderBy("cluster"))
    return named.withColumn("_n", again).select("cluster", F.when(F.col("_n") > 1, F.concat("name", F.lit(" ("), "_n", F.lit(")"))).otherwise(F.col("name")).alias("persona"), "defining")


def ranked_names(profiles: DataFrame, tags: dict[str, str], ranks: DataFrame, least: float = 0.30) -> DataFrame:
    """The two highest dimensions and the strongest low one, behind the rank by strain (ranks: cluster, strain_rank)."""
    words = profiles.sparkSession.createDataFrame(list(tags.items()), "item string, tag string")
    known = profiles.join(F.broadcast(words), "item")
    highs = known.filter(F.col("z") >= least).withColumn("_k", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("z"), "item"))).filter("_k <= 2").groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "tag"))), lambda v: v["tag"]), " + ").alias("hi"))
    lows = known.filter(F.col("z") <= -least).groupBy("cluster").agg(F.min_by("tag", F.struct("z", "item")).alias("lo"))
    return ranks.join(highs, "cluster", "left").join(lows, "cluster", "left").select("cluster", F.concat(F.lit("P"), "strain_rank", F.lit(": "), F.concat_ws(", low ", F.coalesce("hi", F.lit("typical")), "lo")).alias("persona"))


def recommendations(profiles: DataFrame, rules: list[tuple[str, str, str]], least: float = 0.35, comparison: str = "comparison group", monitor: str = "monitor") -> DataFrame:
    """rules: (item, 'high' or 'low', advice), in order of precedence. All low: comparison group; nothing strong: monitor."""
    wide = profiles.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("item", "z"))).alias("z"))
    values = F.map_values("z")
    advice = F.when(F.forall(values, lambda v: v < -least), comparison).when(F.forall(values, lambda v: F.abs(v) < least), monitor)
    for item, side, text in rules:
        v = F.coalesce(F.try_element_at("z", F.lit(item)), F.lit(0.0))
        advice = advice.when(v >= least if side == "high" else v <= -least, text)
    return wide.select("cluster", advice.otherwise(monitor).alias("advice"))


def common_level(df: DataFrame, col: str) -> DataFrame:
    """Per cluster: the most frequent level of a background column, and its share in percent."""
    sizes = df.groupBy("cluster").agg(F.count("*").alias("_n"))
    return modal(df, "cluster", col).join(sizes, "cluster").select("cluster", f"modal_{col}", rounded(100.0 * F.col(f"n_modal_{col}") / F.col("_n"), 1).alias(f"pct_modal_{col}"))


def top_themes(df: DataFrame, themes: DataFrame, most: int = 3) -> DataFrame:
    """Per cluster: its commonest themes (row_id, themes), joined."""
    counts = df.select("row_id", "cluster").join(themes.select("row_id", F.explode("themes").alias("theme")), "row_id").groupBy("cluster", "theme").agg(F.count("*").alias("n"))
    first = counts.withColumn("_k", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), "theme"))).filter(F.col("_k") <= most)
    return first.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "theme"))), lambda v: v["theme"]), ", ").alias("themes"))


def cards(*parts: DataFrame) -> DataFrame:
    """One row per cluster: tables keyed by ``cluster``, side by side."""
    return reduce(lambda a, b: a.join(b, "cluster", "left"), parts)
