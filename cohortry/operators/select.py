"""Choosing k and the feature space: rules over small evidence tables, as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.functions.expressions import average_rank, rounded

#: criterion: whether larger is better. Elbow and gap are reported and do not vote.
CRITERIA = {"silhouette": True, "davies_bouldin": False, "calinski_harabasz": True, "bic_gmm": False, "bootstrap_ari": True, "cross_algo_ari": True, "differentiation": True}
EVIDENCE = "k int, silhouette double, davies_bouldin double, calinski_harabasz double, bic_gmm double, bootstrap_ari double, cross_algo_ari double, differentiation double, min_size_frac double"


def screened(ev: DataFrame, cap: int = 6, least_size: float = 0.05, least_ari: float = 0.50, least_shape: float = 0.50) -> DataFrame:
    """Adds ``reasons``: the rules that a k breaks, joined; empty for survivors."""
    rules = [(F.col("min_size_frac") < least_size, "small cluster"), (F.col("bootstrap_ari") < least_ari, "unstable"), (F.col("differentiation") < least_shape, "level only"), (F.col("k") > cap, "above cap")]
    return ev.withColumn("reasons", F.concat_ws("; ", *[F.when(c, r) for c, r in rules]))


def screen_and_vote(ev: DataFrame, cap: int = 6) -> DataFrame:
    """Per k: reasons, mean average rank over the criteria among survivors, and whether it is chosen.

    The smallest mean rank wins, ties go to the smaller k; if none survives, the smallest k is chosen.
    """
    marked = screened(ev, cap).withColumn("_in", F.col("reasons") == "")
    group = W.partitionBy("_in")
    ranks = [average_rank(F.col(c), group.orderBy(F.desc(c) if up else F.asc(c)), W.partitionBy("_in", c)) for c, up in CRITERIA.items()]
    mean = reduce(lambda a, b: a + b, ranks) / float(len(ranks))
    ranked = marked.withColumn("mean_rank", F.when(F.col("_in"), rounded(mean)))
    first = F.row_number().over(W.orderBy(F.desc("_in"), F.col("mean_rank").asc_nulls_last(), "k"))
    return ranked.select("k", "reasons", "mean_rank", (first == 1).alias("chosen"))


def own_picks(ev: DataFrame) -> DataFrame:
    """criterion, k: where each criterion is best; ties to the smaller k."""
    picks = [F.struct(F.lit(c).alias("criterion"), F.max_by("k", F.struct(F.col(c) if up else -F.col(c), -F.col("k"))).alias("k")) for c, up in CRITERIA.items()]
    return ev.agg(F.array(*picks).alias("a")).select(F.inline("a"))


def modal_vote(votes: DataFrame, preferred: str = "silhouette") -> DataFrame:
    """votes: criterion, k. The k with most votes; ties go to that of the preferred criterion, then to the smaller. All k with their votes."""
    n = votes.groupBy("k").agg(F.count("*").alias("votes"), F.max((F.col("criterion") == preferred).cast("int")).alias("preferred"))
    return n.withColumn("chosen", F.row_number().over(W.orderBy(F.desc("votes"), F.desc("preferred"), "k")) == 1)


def one_se_rule(gap: DataFrame) -> DataFrame:
    """gap: k, gap, s. The smallest k whose gap is at least the next one's less its error; else the last."""
    order = W.orderBy("k")
    held = gap.withColumn("holds", F.col("gap") >= F.lead("gap").over(order) - F.lead("s").over(order))
    return held.agg(F.coalesce(F.min(F.when(F.col("holds"), F.col("k"))), F.max("k")).alias("k"))


def knee_point(curve: DataFrame, x: str = "k", y: str = "sse", signed: bool = False) -> DataFrame:
    """The x farthest from the chord between the ends, after scaling both axes to [0, 1]; ``signed``: farthest below it. Ties to the smaller x."""
    ends = curve.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("lo"), F.max(y).alias("hi"), F.min_by(y, x).alias("y0"), F.max_by(y, x).alias("y1"))
    unit = lambda v: (v - F.col("lo")) / (F.col("hi") - F.col("lo"))
    at = (F.col(x) - F.col("x0")) / (F.col("x1") - F.col("x0"))
    below = unit(F.col("y0")) + (unit(F.col("y1")) - unit(F.col("y0"))) * at - unit(F.col(y))
    d = below if signed else F.abs(below) / F.sqrt(1 + F.pow(unit(F.col("y1")) - unit(F.col("y0")), 2))
    return curve.join(F.broadcast(ends), F.lit(True)).agg(F.max_by(x, F.struct(rounded(d, 9), -F.col(x))).alias("knee"), rounded(F.max(d)).alias("distance"))


def choose_space(ev: DataFrame, cap: int = 6, close: float = 0.01) -> DataFrame:
    """ev: evidence with a ``space`` column. Each space is judged at the k it chose: the highest bootstrap agreement, within ``close`` the highest differentiation."""
    spaces = [r[0] for r in ev.select("space").distinct().orderBy("space").collect()]  # a handful
    crowned = reduce(DataFrame.unionByName, [screen_and_vote(ev.filter(F.col("space") == s).drop("space"), cap).filter("chosen").select(F.lit(s).alias("space"), "k") for s in spaces])
    at = crowned.join(ev, ["space", "k"])
    near = at.withColumn("_near", F.col("bootstrap_ari") >= F.max("bootstrap_ari").over(W.partitionBy()) - close)
    return near.select("space", "k", "bootstrap_ari", "differentiation", (F.row_number().over(W.orderBy(F.desc("_near"), F.desc("differentiation"), "space")) == 1).alias("chosen"))


def runner_up(decision: DataFrame) -> DataFrame:
    """The second survivor, and how far its mean rank is behind."""
    order = W.orderBy("mean_rank", "k")
    return decision.filter("mean_rank IS NOT NULL").select("k", (F.col("mean_rank") - F.min("mean_rank").over(W.partitionBy())).alias("margin"), F.row_number().over(order).alias("_k")).filter("_k = 2").select("k", rounded(F.col("margin")).alias("margin"))


def decision_record(ev: DataFrame, decision: DataFrame, gap: DataFrame, curve: DataFrame) -> dict:
    """The chosen k, the k of each criterion with elbow (curve: k, sse) and gap beside them, who disagrees, and how the result may be called: where the gap finds one group, structure is weak."""
    rows = decision.orderBy("k").collect()  # one row per k, as the others
    chosen = next(r["k"] for r in rows if r["chosen"])
    picks = {r["criterion"]: r["k"] for r in own_picks(ev).collect()} | {"elbow": knee_point(curve).first()["knee"], "gap": one_se_rule(gap).first()["k"]}
    survivors = [r["k"] for r in rows if not r["reasons"]]
    return {
        "k": chosen, "rule": "mean rank among the k that pass the screens" if survivors else "no k passes the screens: the smallest", "survivors": survivors, "screened_out": {r["k"]: r["reasons"] for r in rows if r["reasons"]},
        "picks": picks, "disagree": sorted(c for c, k in picks.items() if k != chosen), "weak_structure": picks["gap"] == 1, "framing": "segments of a continuum" if picks["gap"] == 1 else "separate groups",
    }


def explained(variances: DataFrame, target: float = 0.95) -> DataFrame:
    """variances: pc, eigenvalue. Shares, running shares, and whether this component is the first to reach the target."""
    run = F.sum("eigenvalue").over(W.orderBy("pc").rowsBetween(W.unboundedPreceding, 0)) / F.sum("eigenvalue").over(W.partitionBy())
    out = variances.select("pc", "eigenvalue", rounded(F.col("eigenvalue") / F.sum("eigenvalue").over(W.partitionBy())).alias("share"), rounded(run).alias("cumulative"))
    return out.withColumn("reaches", F.col("pc") == F.min(F.when(F.col("cumulative") >= target, F.col("pc"))).over(W.partitionBy()))


def verdict(silhouette: float) -> str:
    return "no structure" if silhouette < 0.25 else "weak structure" if silhouette < 0.50 else "reasonable structure" if silhouette < 0.70 else "strong structure"


def evidence_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, EVIDENCE)
