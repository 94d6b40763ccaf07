"""What sweeps and resampling report, as tables; consensus on a block of rows, and parallel analysis, whose draws are tasks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.functions.expressions import rounded
from cohortry.operators.cluster import kmeans
from cohortry.operators.fanout import run_tasks
from cohortry.operators.measure import parallel_eigenvalues

def contingency(a, b) -> np.ndarray:
    x, y = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    return np.bincount(x * (y.max() + 1) + y, minlength=(x.max() + 1) * (y.max() + 1)).reshape(x.max() + 1, -1)


def exclusions(swept: DataFrame) -> DataFrame:
    """algorithm, reason, ks: what the sweep left out."""
    why = F.coalesce("error", F.when(F.col("degenerate"), F.concat(F.lit("largest cluster "), rounded(F.col("max_size_frac"), 3))))
    return swept.withColumn("reason", why).filter("reason IS NOT NULL").groupBy("algorithm").agg(F.max_by("reason", "k").alias("reason"), F.sort_array(F.collect_list("k")).alias("ks"))


def agreement_summary(runs: DataFrame) -> DataFrame:
    """Per k, over (k, ari, ami): mean, sd, percentiles, share above .5 and .75, mean adjusted information."""
    return runs.groupBy("k").agg(F.count("ari").alias("n"), F.avg("ari").alias("mean_ari"), F.stddev_pop("ari").alias("sd_ari"), *[F.percentile("ari", p / 100).alias(f"p{p:02d}") for p in (5, 50, 95)], F.avg((F.col("ari") > 0.5).cast("double")).alias("above_50"), F.avg((F.col("ari") > 0.75).cast("double")).alias("above_75"), F.avg("ami").alias("mean_ami"))


def consensus(spark: SparkSession, z: np.ndarray, k: int, resamples: int = 100, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Long form: i <= j, how often both were drawn and how often they fell together; rate 1 on the diagonal. Pairs are joined and counted in Spark."""

    def fit(task, z):
        rows = np.random.default_rng([seed, task["id"]]).choice(len(z), int(share * len(z)), replace=False)
        return [{"id": task["id"], "row": int(r), "label": int(c)} for r, c in zip(rows, kmeans(z[rows], k, seed + task["id"], 5)[0], strict=True)]

    fits = run_tasks(spark, pd.DataFrame({"id": range(resamples)}), fit, z, "id int, row int, label int")
    a, b = fits.select("id", F.col("row").alias("i"), F.col("label").alias("ci")), fits.select("id", F.col("row").alias("j"), F.col("label").alias("cj"))
    return a.join(b, (a["id"] == b["id"]) & (F.col("i") <= F.col("j"))).groupBy("i", "j").agg(F.count("*").alias("seen"), F.count_if(F.col("ci") == F.col("cj")).alias("together")).withColumn("rate", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("together") / F.col("seen")))


def consensus_by_cluster(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """labels: row, cluster. Mean rate of pairs within each cluster; a cluster of one has none."""
    a, b = labels.select(F.col("row").alias("i"), F.col("cluster").alias("ci")), labels.select(F.col("row").alias("j"), F.col("cluster").alias("cj"))
    pairs = matrix.filter("i < j").join(a, "i").join(b, "j").filter("ci = cj")
    return labels.select("cluster").distinct().join(pairs.groupBy(F.col("ci").alias("cluster")).agg(F.avg("rate").alias("consensus"), F.count("*").alias("pairs")), "cluster", "left")


def gap_summary(runs: DataFrame, references: int) -> DataFrame:
    """k, gap, s over (k, ref, log_w); ref -1: the data."""
    ref = F.when(F.col("ref") >= 0, F.col("log_w"))
    return runs.groupBy("k").agg((F.avg(ref) - F.max(F.when(F.col("ref") < 0, F.col("log_w")))).alias("gap"), (F.stddev_pop(ref) * math.sqrt(1 + 1 / references)).alias("s"))


def parallel_analysis(spark: SparkSession, n: int, p: int, observed: list[float], simulations: int = 500, seed: int = 42) -> DataFrame:
    """Per component: observed eigenvalue, random mean and 95th percentile, and whether it is retained (so far as all before are)."""

    def draw(task, _):
        return [{"pc": i + 1, "value": float(v)} for i, v in enumerate(parallel_eigenvalues(n, p, seed + task["id"]))]

    runs = run_tasks(spark, pd.DataFrame({"id": range(simulations)}), draw, np.zeros(0), "pc int, value double")
    table = runs.groupBy("pc").agg(F.avg("value").alias("random_mean"), F.percentile("value", 0.95).alias("random_p95"))
    seen = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(observed)], "pc int, observed double")
    above = seen.join(table, "pc").withColumn("_over", F.col("observed") > F.col("random_p95"))
    return above.withColumn("retain", F.min("_over").over(W.orderBy("pc"))).drop("_over")
