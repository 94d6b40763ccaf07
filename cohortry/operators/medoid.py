"""Partition around medoids by Gower's distance, on tables of any size.

Medoids are rows. A pass over all rows measures, for some candidate rows, what each swap of a medoid for a candidate would change: a
row's nearest and second-nearest medoids say what it pays if its own goes, so the k x c changes of cost are plain sums. The
best swap that lowers the cost is made; the search ends after ``patience`` passes in a row without one. Candidates are rows drawn by a
hash, others in each pass; where the table has no more rows than ``candidates`` all are tried, and the end is a local optimum.
All k advance in the same passes. Equal rows are measured once, with their number as weight, so a pass takes as long as there are
different rows; candidates are still drawn among all rows, for some passes at a time.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.resample import _passed, uniform

SWEEP = "k int, cost double, mean_distance double, silhouette double, passes int, rested boolean"


def gower_points(df: DataFrame, numeric: list[str], categorical: list[str], key: str) -> tuple[DataFrame, int, int]:
    """h and x: numbers divided by their range (columns that do not vary left out), then a 53-bit hash of each level. A missing number differs from all, missing levels are a level."""
    ranges = df.agg(*[(F.max(c) - F.min(c)).cast("double").alias(c) for c in numeric]).first() if numeric else {}
    used = [c for c in numeric if ranges[c]]
    if not used and not categorical:
        raise ValueError("no column varies")
    cells = [F.coalesce(F.col(c).cast("double") / float(ranges[c]), F.lit(math.nan)) for c in used]
    levels = [F.shiftrightunsigned(F.xxhash64(F.col(c).isNull(), F.col(c)), 11).cast("double") for c in categorical]
    return df.select(F.xxhash64(key).alias("h"), F.array(*cells, *levels).alias("x")), len(used), len(categorical)


def gower(a: np.ndarray, b: np.ndarray, numbers: int) -> np.ndarray:
    """Distances of all rows of ``a`` to all of ``b``."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        if j < numbers:
            total += np.nan_to_num(np.abs(a[:, j, None] - b[:, j]), nan=1.0)
        else:
            total += a[:, j, None] != b[:, j]
    return total / a.shape[1]


def _greedy(points: np.ndarray, weights: np.ndarray, k: int, numbers: int) -> np.ndarray:
    """``k`` of a few weighted points, each the one that lowers the weighted cost most."""
    d = gower(points, points, numbers)
    near, chosen = np.full(len(points), np.inf), []
    for _ in range(min(k, len(points))):
        cost = (np.minimum(near[:, None], d) * weights[:, None]).sum(0) if chosen else (d * weights[:, None]).sum(0)
        cost[chosen] = np.inf
        chosen.append(int(cost.argmin()))
        near = np.minimum(near, d[:, chosen[-1]])
    return points[chosen]


def medoids(df: DataFrame, numeric: list[str], categorical: list[str], ks, candidates: int = 64, patience: int = 3, most_passes: int = 200, seed: int = 42, key: str = "row_id") -> tuple[dict[int, np.ndarray], DataFrame]:
    """The medoids of each k, and per k: cost, mean distance to the own medoid, silhouette with medoids in place of rows, passes and whether it came to rest."""
    ks = list(ks)
    points, numbers, levels = gower_points(df, numeric, categorical, key)
    points, size = points.cache(), numbers + levels
    n, slots = points.count(), max(df.sparkSession.sparkContext.defaultParallelism, points.rdd.getNumPartitions())
    kinds = points.groupBy("x").agg(F.count("*").cast("double").alias("n")).repartition(slots, "x").sortWithinPartitions("x")
    kinds = kinds.select(F.lit(0).cast("long").alias("h"), F.concat("x", F.array("n")).alias("x")).cache()
    share, pools = 1.0 if n <= candidates else candidates / n, {}

    def drawn_at(step: int, ahead: int = 16) -> list[np.ndarray]:
        """The rows drawn for a pass; those of the next ones are drawn with them."""
        if step not in pools:
            steps = range(step, step + ahead)

            def draw(total, h, x):
                return [(s, x[i]) for s in steps for i in np.flatnonzero(uniform(h, seed * 101 + s) < share)]

            pools.clear()
            pools.update({s: [] for s in steps})
            for s, x in _passed(points, size, [(1,)], draw)[1]:
                pools[s].append(x)
        return pools[step]

    pool = np.array(drawn_at(0, 1 if n <= candidates else 16))
    if not len(pool):
        pool = np.array([points.select("x").first()[0]]) if n else np.zeros((1, size))

    def weigh(total, h, x):
        total[0] += np.bincount(gower(x[:, :size], pool, numbers).argmin(1), x[:, size], len(pool))

    weights = _passed(kinds, size + 1, [(len(pool),)], weigh)[0][0]
    chosen = {k: _greedy(pool, weights, k, numbers) for k in ks}
    best, idle, passes, moving = {}, dict.fromkeys(ks, 0), dict.fromkeys(ks, 0), list(ks)
    last: dict[int, np.ndarray] = {}
    for step in range(1, most_passes + 1):
        now = {k: chosen[k] for k in moving}

        def measure(total, h, x, now=now, pool=pool):
            x, n = x[:, :size], x[:, size]
            to_pool = gower(x, pool, numbers)
            for out, (k, m) in zip(total, now.items(), strict=True):
                d = gower(x, m, numbers)
                own = d.argmin(1)
                first = d[np.arange(len(x)), own]
                d[np.arange(len(x)), own] = np.inf
                second = d.min(1) if len(m) > 1 else np.full(len(x), np.inf)
                kept = np.minimum(to_pool - first[:, None], 0)
                lost = np.minimum(to_pool, second[:, None]) - first[:, None]
                member = np.eye(len(m))[own]
                out[: len(m), : len(pool)] += n @ kept + (member * n[:, None]).T @ (lost - kept)
                near = np.where(np.isfinite(second), second, first)
                out[len(m), 0] += first @ n
                out[len(m), 1] += ((near - first) / np.maximum(near, 1e-300)) @ n if len(m) > 1 else 0

        sums, _ = _passed(kinds, size + 1, [(len(m) + 1, max(2, len(pool))) for m in now.values()], measure)
        for k, s in zip(list(moving), sums, strict=True):
            m = len(chosen[k])
            passes[k], best[k] = step, (float(s[m, 0]), float(s[m, 1]))
            change = s[:m, : len(pool)]
            i, j = np.unravel_index(change.argmin(), change.shape)
            if change[i, j] < -1e-9 * max(1.0, s[m, 0]):
                chosen[k], idle[k] = np.vstack([chosen[k][:i], pool[j : j + 1], chosen[k][i + 1 :]]), 0
            else:
                idle[k] += 1
                if idle[k] >= (1 if n <= candidates else patience):
                    moving.remove(k)
                    last[k] = chosen[k]
        if not moving:
            break
        if n > candidates and (drawn := drawn_at(step)):
            pool = np.array(drawn)
    kinds.unpersist()
    points.unpersist()
    rows = [(k, best[k][0], best[k][0] / max(n, 1), best[k][1] / max(n, 1), passes[k], k in last) for k in ks]
    return chosen, df.sparkSession.createDataFrame(rows, SWEEP)
