"""Association and agreement from contingency counts: one aggregate each, closed forms after it."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.functions.expressions import association_size, effect_size, rounded
from cohortry.functions.special import binomial_two_sided, chi2_sf, correlation_p, f_sf, t_two_sided
from cohortry.operators.describe import crosstab, unpivot
from cohortry.operators.order import average_ranks


def chi2_cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, r, c, dof, chi2 (Yates-corrected at one degree of freedom), plain and bias-corrected V. Counts only: no p.

    Expected counts of empty cells matter too: the sum over all cells is written with the marginals.
    """
    cells = crosstab(df, a, b).filter("a IS NOT NULL AND b IS NOT NULL")
    marg = cells.select("n", F.sum("n").over(W.partitionBy("a")).alias("ra"), F.sum("n").over(W.partitionBy("b")).alias("cb"), F.sum("n").over(W.partitionBy()).alias("n_all"), "a", "b")
    # sum (o - e)^2 / e = n (sum o^2 / (ra cb) - 1); with Yates in a 2x2 table every |o - e| is the same
    one = marg.agg(F.first("n_all").alias("n"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"), F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("cb"))).alias("q"), F.max(F.abs(F.col("n") - F.col("ra") * F.col("cb") / F.col("n_all"))).alias("gap"))
    plain = F.col("n") * (F.col("q") - 1)
    corrected = F.when(F.col("gap") > 0, plain * F.pow(F.greatest(F.col("gap") - F.least(F.lit(0.5), F.col("gap")), F.lit(0.0)) / F.col("gap"), 2)).otherwise(0.0)
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    out = one.select(F.col("n").cast("long").alias("n"), "r", "c", dof.alias("dof"), plain.alias("_plain"), F.when(dof == 1, corrected).otherwise(plain).alias("_chi2"))
    phi = F.greatest(F.lit(0.0), F.col("_chi2") / F.col("n") - F.col("dof") / (F.col("n") - 1))
    rr, cc = F.col("r") - F.pow(F.col("r") - 1, 2) / (F.col("n") - 1), F.col("c") - F.pow(F.col("c") - 1, 2) / (F.col("n") - 1)
    small, corrected_small = F.least(F.col("r"), F.col("c")) - 1, F.least(rr, cc) - 1
    v = F.when(corrected_small > 0, F.sqrt(phi / corrected_small)).otherwise(0.0)
    return out.select("n", "r", "c", "dof", rounded(F.col("_chi2")).alias("chi2"), rounded(F.when(small > 0, F.sqrt(F.col("_chi2") / (F.col("n") * small))).otherwise(0.0)).alias("v_plain"), rounded(v).alias("cramers_v"), association_size(v).alias("effect"))


def chi2_of_table(table: list[list[float]]) -> dict[str, float]:
    """The same for a small table held by the driver, with p."""
    rows, cols = [sum(r) for r in table], [sum(c) for c in zip(*table, strict=True)]
    n, dof = sum(rows), (len(rows) - 1) * (len(cols) - 1)
    gaps = [[abs(o - r * c / n) for o, c in zip(row, cols, strict=True)] for row, r in zip(table, rows, strict=True)]
    chi2 = sum((g - (min(0.5, g) if dof == 1 else 0)) ** 2 / (r * c / n) for row, r in zip(gaps, rows, strict=True) for g, c in zip(row, cols, strict=True))
    r, c = len(rows), len(cols)
    phi, rr, cc = max(0.0, chi2 / n - dof / (n - 1)), r - (r - 1) ** 2 / (n - 1), c - (c - 1) ** 2 / (n - 1)
    return {"chi2": chi2, "dof": dof, "p": chi2_sf(chi2, dof), "v_plain": math.sqrt(chi2 / (n * (min(r, c) - 1))), "cramers_v": math.sqrt(phi / (min(rr, cc) - 1)) if min(rr, cc) > 1 else 0.0}


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index, normalised mutual information (arithmetic mean), majority accuracy and its baseline of two labelings."""
    pairs = lambda n: n * (n - 1) / 2.0
    cells = crosstab(df, a, b)
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("n"), F.max("n").alias("m")), cells.groupBy("b").agg(F.sum("n").alias("n"))
    h = lambda: F.sum(F.col("n") * F.ln("n"))
    c = cells.agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum("n").alias("N"), h().alias("hij"))
    r = rows.agg(F.sum(pairs(F.col("n"))).alias("i"), h().alias("hi"), F.sum("m").alias("major"))
    k = cols.agg(F.sum(pairs(F.col("n"))).alias("j"), h().alias("hj"), F.max("n").alias("base"))
    one = c.join(F.broadcast(r), F.lit(True)).join(F.broadcast(k), F.lit(True))
    n = F.col("N").cast("double")
    expected = F.col("i") * F.col("j") / pairs(n)
    top = (F.col("i") + F.col("j")) / 2
    ari = F.when(top == expected, 1.0).otherwise((F.col("ij") - expected) / (top - expected))
    ha, hb, hab = F.ln(n) - F.col("hi") / n, F.ln(n) - F.col("hj") / n, F.ln(n) - F.col("hij") / n
    nmi = F.when(ha + hb == 0, 1.0).otherwise(2 * (ha + hb - hab) / (ha + hb))
    return one.select(F.col("N").cast("long").alias("n"), rounded(ari).alias("ari"), rounded(nmi).alias("nmi"), rounded(F.col("major") / n).alias("majority_accuracy"), rounded(F.col("base") / n).alias("baseline"))


def ari_of_table(table) -> float:
    pairs = lambda n: n * (n - 1) / 2
    ij = sum(pairs(x) for row in table for x in row)
    i, j = sum(pairs(sum(row)) for row in table), sum(pairs(sum(col)) for col in zip(*table, strict=True))
    expected, top = i * j / pairs(sum(map(sum, table))), (i + j) / 2
    return 1.0 if top == expected else (ij - expected) / (top - expected)


def expected_information(r: int, c: int, n: int) -> float:
    """What a cell with these margins adds to the mutual information of two random labelings: the mean of x/n ln(nx/(rc)) over the
    hypergeometric x. Probabilities are products of ratios from the mode outwards, over 12 standard deviations and 40 more; where
    that is over 4,096 values, the mean comes from the central moments up to the fourth (the next terms are below 1e-9 of it)."""
    mean = r * c / n
    variance = mean * (1 - r / n) * (n - c) / max(n - 1, 1)
    spread = math.sqrt(variance)
    if 24 * spread > 4_096:
        skew = variance * (n - 2 * r) * (n - 2 * c) / (n * max(n - 2, 1))
        fourth = 3 * variance * variance + variance
        return (variance / (2 * mean) - skew / (6 * mean**2) + fourth / (12 * mean**3)) / n
    low, high, mode = max(0, r + c - n), min(r, c), (r + 1) * (c + 1) // (n + 2)
    reach = int(12 * spread) + 40
    up, down = np.arange(mode, min(high, mode + reach), dtype=float), np.arange(mode, max(low, mode - reach), -1.0)
    rising = np.cumprod((r - up) * (c - up) / ((up + 1) * (n - r - c + up + 1)))
    falling = np.cumprod(down * (n - r - c + down) / ((r - down + 1) * (c - down + 1)))
    x, weight = np.concatenate([[mode], up + 1, down - 1]), np.concatenate([[1.0], rising, falling])
    some = x > 0
    return float((weight[some] * x[some] * np.log(x[some] / mean)).sum() / weight.sum() / n)


def ami_of_table(table) -> float:
    """Adjusted mutual information (arithmetic mean) of a small contingency table; the time does not depend on its counts."""
    rows, cols = [int(sum(r)) for r in table], [int(sum(c)) for c in zip(*table, strict=True)]
    n = sum(rows)
    entropy = lambda xs: -sum(x / n * math.log(x / n) for x in xs if x)
    mutual = sum(x / n * math.log(n * x / (r * c)) for row, r in zip(table, rows, strict=True) for x, c in zip(row, cols, strict=True) if x)
    expected = sum(expected_information(r, c, n) for r in rows if r for c in cols if c)
    top = (entropy(rows) + entropy(cols)) / 2
    return 1.0 if abs(top - expected) < 1e-15 else (mutual - expected) / (top - expected)


def best_agreement(table) -> float:
    """Largest share on the diagonal over all matchings of columns to rows; for few clusters."""
    from itertools import permutations

    n = sum(map(sum, table))
    return max(sum(table[i][p[i]] for i in range(len(table))) for p in permutations(range(len(table[0])), len(table))) / n


def kappa_of_table(table) -> tuple[float, float]:
    """Accuracy and Cohen's kappa of a confusion matrix."""
    n = sum(map(sum, table))
    accuracy = sum(table[i][i] for i in range(len(table))) / n
    chance = sum(sum(r) * sum(c) for r, c in zip(table, zip(*table, strict=True), strict=True)) / n / n
    return accuracy, (accuracy - chance) / (1 - chance)


def classes_to_clusters(df: DataFrame, label: str, held_out: list[str], in_model: tuple[str, ...] = (), alpha: float = 0.05) -> list[dict]:
    """Per held-out variable: chi2, p, V, agreement; significance is Bonferroni-corrected over the checks. Variables in the model are manipulation checks."""
    out = []
    for v in held_out:
        chi, fit = chi2_cells(df, v, label).first().asDict(), agreement(df, v, label).first().asDict()
        p = chi2_sf(chi["chi2"], chi["dof"]) if chi["dof"] else 1.0
        out.append({"variable": v, **chi, "p": p, "ari": fit["ari"], "nmi": fit["nmi"], "majority_accuracy": fit["majority_accuracy"], "baseline": fit["baseline"], "significant": p < alpha / len(held_out), "manipulation_check": v in in_model})
    return out


def eta_squared(df: DataFrame, cols: list[str], label: str = "cluster") -> DataFrame:
    """Per column: share of variance between clusters, one-way F, degrees of freedom, effect; largest first."""
    long = unpivot(df, [label], cols)
    per = long.groupBy("item", label).agg(F.count("value").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("value")).alias("w"))
    grand = per.withColumn("g", F.sum(F.col("n") * F.col("m")).over(W.partitionBy("item")) / F.sum("n").over(W.partitionBy("item")))
    sums = grand.groupBy("item").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("ssb"), F.sum("w").alias("ssw"), F.sum("n").alias("n"), F.count("*").alias("k"))
    eta = F.col("ssb") / (F.col("ssb") + F.col("ssw"))
    f = (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))
    return sums.select("item", rounded(eta).alias("eta_squared"), rounded(f).alias("f"), (F.col("k") - 1).alias("dof_between"), (F.col("n") - F.col("k")).alias("dof_within"), effect_size(eta).alias("effect")).orderBy(F.desc("eta_squared"), "item")


def eta_with_p(df: DataFrame, cols: list[str], label: str = "cluster") -> list[dict]:
    return [r.asDict() | {"p": f_sf(r["f"], r["dof_between"], r["dof_within"])} for r in eta_squared(df, cols, label).collect()]  # one row per column


def welch(df: DataFrame, flag: str, value: str) -> DataFrame:
    """Welch's t of ``value`` where the 0/1 ``flag`` is 1 against 0, its degrees of freedom, and Cohen's d."""
    side = lambda f, v: f(F.when(F.col(flag) == v, F.col(value).cast("double")))
    s = df.agg(*[side(f, v).alias(f"{k}{v}") for v in (0, 1) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return s.select("n1", "n0", rounded(F.col("m1")).alias("mean1"), rounded(F.col("m0")).alias("mean0"), rounded((F.col("m1") - F.col("m0")) / F.sqrt(a + b)).alias("t"), rounded(F.pow(a + b, 2) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))).alias("dof"), rounded((F.col("m1") - F.col("m0")) / pooled).alias("d"))


def welch_p(row) -> float:
    return t_two_sided(row["t"], row["dof"])


def correlation(df: DataFrame, a: str, b: str, ranks: bool = False) -> dict[str, float]:
    """Pearson, or Spearman by average ranks, with p. Ranks are joined from counts per value, not from one global sort of the rows."""
    if ranks:
        for c in (a, b):
            df = average_ranks(df, c, f"_r_{c}")
        a, b = f"_r_{a}", f"_r_{b}"
    r, n = df.agg(F.corr(a, b), F.count("*")).first()
    return {"r": r, "n": n, "p": correlation_p(r, n)}


def mcnemar(gained: int, dropped: int) -> float:
    """Exact two-sided p of a paired shift."""
    return binomial_two_sided(gained, gained + dropped)
