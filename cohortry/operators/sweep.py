"""The sweep of algorithms over k on whole tables: fits share their passes, labels are given once, and two passes give all indices.

A fit becomes a small rule: centres, mixture parameters, or condensed features with their clusters. One projection applies all rules
to a row; two passes over the labelled rows then add up sizes, centroids, spreads and distances for every fit together. Silhouettes
have centroids in place of rows, which makes them sums too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators.agglomerate import features, weighted_tree
from cohortry.operators.associate import ami_of_table, ari_of_table
from cohortry.operators.cluster import cut_tree, squared_distances
from cohortry.operators.mixture import free_parameters, log_densities, many_mixtures, partitions
from cohortry.operators.resample import _arrays, _passed, _points, many_kmeans
from cohortry.session import ship_code

LINKAGES = ("ward", "complete", "average")
ALGORITHMS = ("kmeans", "bisecting", "gmm_full", "gmm_diag", *LINKAGES)
ROW = "algorithm string, k int, n_clusters_found int, min_size long, max_size long, min_size_frac double, max_size_frac double, silhouette double, davies_bouldin double, calinski_harabasz double, ss_level double, ss_shape double, between_ss double, differentiation double, inertia double, bic double, aic double, entropy double, converged boolean, degenerate boolean"


class Fit:
    """One labelling rule, and what its fit reports."""

    def __init__(self, algorithm: str, k: int, rule, **reports):
        self.algorithm, self.k, self.rule, self.reports = algorithm, k, rule, reports

    def labels(self, x: np.ndarray) -> np.ndarray:
        if self.rule[0] == "mixture":
            return log_densities(x, *self.rule[1:]).argmax(1)
        near = np.concatenate([squared_distances(x[i : i + 2000], self.rule[1]).argmin(1) for i in range(0, len(x), 2000)] or [np.empty(0, int)])
        return near if self.rule[2] is None else self.rule[2][near]


def fits(df: DataFrame, cols: list[str], ks, algorithms: tuple[str, ...] = ALGORITHMS, seed: int = 42, key: str = "row_id", starts: int = 5, most: int = 2_000) -> list[Fit]:
    """All algorithms at all k. k-means (the best of ``starts``), bisecting k-means, mixtures and agglomerations over at most ``most`` features.

    The algorithms, and the fits of bisecting k-means, run at the same time: on tables whose passes take less than their start, they wait for each other's."""
    ks, size = list(ks), len(cols)
    points = _points(df, cols, key, least=4_096).cache()  # a task of Python takes a tenth of a second to begin
    points.count()
    ship_code(df.sparkSession)

    def kmeans() -> list[Fit]:
        tasks, out = [(k, i) for k in ks for i in range(starts)], []
        centres, inertia, rested = many_kmeans(points, size, tasks, lambda h, x, t: x, seed=seed, family=lambda t: 0)
        for i, k in enumerate(ks):
            best = min(range(i * starts, (i + 1) * starts), key=lambda t: inertia[t])
            out.append(Fit("kmeans", k, ("centres", centres[best], None), inertia=inertia[best], converged=rested[best]))
        return out

    def bisecting(k: int, ready: DataFrame) -> list[Fit]:
        from pyspark.ml.clustering import BisectingKMeans

        model = BisectingKMeans(k=k, seed=seed, featuresCol="_features").fit(ready)
        return [Fit("bisecting", k, ("centres", np.array([c for c in model.clusterCenters()]), None), inertia=float(model.summary.trainingCost))]

    def mixtures(names: list[str]) -> list[Fit]:
        tasks, out = [(k, -1) for k in ks], []
        centres = partitions(points, size, tasks, seed=seed)
        for name, fitted in zip(names, _together(df.sparkSession, [lambda name=name: many_mixtures(df, cols, tasks, diagonal=name == "gmm_diag", seed=seed, key=key, points=points, centres=centres) for name in names]), strict=True):
            for k, f in zip(ks, fitted, strict=True):
                free = free_parameters(k, size, name == "gmm_diag")
                out.append(Fit(name, k, ("mixture", f["weights"], f["means"], f["spreads"]), bic=free * math.log(f["n"]) - 2 * f["log_likelihood"], aic=2 * free - 2 * f["log_likelihood"], entropy=f["entropy"], converged=f["converged"]))
        return out

    def trees(names: list[str]) -> list[Fit]:
        f, out = features(points, size, most), []
        for name in names if len(f.n) else ():
            merges = weighted_tree(f, name)
            out += [Fit(name, k, ("centres", f.centres(), cut_tree(merges, len(f.n), min(k, len(f.n))))) for k in ks]
        return out

    work = [kmeans] if "kmeans" in algorithms else []
    if "bisecting" in algorithms:
        from pyspark.ml.feature import VectorAssembler

        ready = VectorAssembler(inputCols=cols, outputCol="_features").transform(df.select(*cols)).select("_features").cache()
        ready.count()
        work += [lambda k=k: bisecting(k, ready) for k in ks]
    if used := [name for name in ("gmm_full", "gmm_diag") if name in algorithms]:
        work.append(lambda used=used: mixtures(used))
    if used := [name for name in LINKAGES if name in algorithms]:
        work.append(lambda used=used: trees(used))
    out = [fit for fits in _together(df.sparkSession, work) for fit in fits]
    if "bisecting" in algorithms:
        ready.unpersist()
    points.unpersist()
    return out


def _together(spark: SparkSession, work: list[Callable[[], list]]) -> list[list]:
    """What each returns, in their order; their Spark jobs run side by side."""
    with ThreadPoolExecutor(max(1, len(work))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(w)) for w in work]]


def labelled(df: DataFrame, cols: list[str], found: list[Fit], key: str = "row_id") -> DataFrame:
    """h, and x: the values, then the label of each fit."""
    size, points = len(cols), _points(df, cols, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _arrays(batch, size)[1]
                both = np.hstack([x, *[f.labels(x)[:, None] for f in found]])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both.tolist(), pa.list_(pa.float64()))], names=["h", "x"])

    ship_code(df.sparkSession)
    return points.mapInArrow(run, "h long, x array<double>")


def quality(marked: DataFrame, size: int, found: list[Fit], largest: float = 0.80) -> list[dict]:
    """Sizes and indices of each fit, from two passes over :func:`labelled` rows."""
    width = [f.k for f in found]

    def moments(total, h, x):
        v = x[:, :size]
        total[-1] += np.concatenate([[len(v)], v.sum(0), [(v * v).sum()]])
        for out, label, k in zip(total, x[:, size:].T.astype(int), width, strict=False):
            own = np.eye(k)[label]
            out[:, 0] += own.sum(0)
            out[:, 1:] += own.T @ v

    sums, _ = _passed(marked, size + len(found), [*[(k, size + 1) for k in width], (size + 2,)], moments)
    n, grand = sums[-1][0], sums[-1][1 : 1 + size] / max(sums[-1][0], 1)
    kept = [s[:, 0] > 0 for s in sums[:-1]]
    centres = [np.where(s[:, :1] > 0, s[:, 1:] / np.maximum(s[:, :1], 1), np.inf) for s in sums[:-1]]

    def spreads(total, h, x):
        v = x[:, :size]
        for out, label, m, used in zip(total, x[:, size:].T.astype(int), centres, kept, strict=True):
            d = np.full((len(v), len(m)), np.inf)
            d[:, used] = np.sqrt(squared_distances(v, m[used]))
            own = d[np.arange(len(v)), label]
            d[np.arange(len(v)), label] = np.inf
            other = d.min(1)
            s = np.where(np.isfinite(other) & (np.maximum(own, other) > 0), (other - own) / np.where(np.isfinite(other), np.maximum(np.maximum(own, other), 1e-300), 1), 0)
            out[:, 0] += np.bincount(label, own, len(m))
            out[:, 1] += np.bincount(label, own**2, len(m))
            out[:, 2] += np.bincount(label, s, len(m))

    spread, _ = _passed(marked, size + len(found), [(k, 3) for k in width], spreads)
    rows = []
    for f, first, second, used, m in zip(found, sums, spread, kept, centres, strict=False):
        sizes, k = first[used, 0], int(used.sum())
        delta = m[used] - grand
        between, within = float((sizes[:, None] * delta**2).sum()), float(second[used, 1].sum())
        level = delta.mean(1)
        ss_level, ss_shape = float((sizes * size * level**2).sum()), float((sizes[:, None] * (delta - level[:, None]) ** 2).sum())
        mean = second[used, 0] / np.maximum(sizes, 1)
        gaps = np.sqrt(squared_distances(m[used], m[used])) + np.diag([np.inf] * k) if k else np.empty((0, 0))
        proper = 2 <= k < n
        row = {"algorithm": f.algorithm, "k": f.k, "n_clusters_found": k, "min_size": int(sizes.min()) if k else 0, "max_size": int(sizes.max()) if k else 0, "min_size_frac": float(sizes.min() / n) if k else None, "max_size_frac": float(sizes.max() / n) if k else None}
        row |= {"silhouette": float(second[used, 2].sum() / n) if proper else None, "davies_bouldin": float(((mean[:, None] + mean) / gaps).max(1).mean()) if proper else None, "calinski_harabasz": float((between / (k - 1)) / (within / (n - k))) if proper and within else None}
        row |= {"ss_level": ss_level, "ss_shape": ss_shape, "between_ss": between, "differentiation": ss_shape / between if between else 0.0, "inertia": None, "bic": None, "aic": None, "entropy": None, "converged": None, "degenerate": bool(k and sizes.max() / n > largest)}
        rows.append(row | {c: (bool(v) if c == "converged" else float(v)) for c, v in f.reports.items()})
    return rows


def contingencies(marked: DataFrame, size: int, found: list[Fit]) -> dict[tuple[int, int], np.ndarray]:
    """The table of counts of each pair of fits of one k, in one pass."""
    pairs = [(i, j) for i in range(len(found)) for j in range(i + 1, len(found)) if found[i].k == found[j].k]
    if not pairs:
        return {}

    def count(total, h, x):
        label = x[:, size:].T.astype(int)
        for out, (i, j) in zip(total, pairs, strict=True):
            out += np.bincount(label[i] * found[j].k + label[j], minlength=out.size).reshape(out.shape)

    tables, _ = _passed(marked, size + len(found), [(found[i].k, found[j].k) for i, j in pairs], count)
    return dict(zip(pairs, (t.astype(np.int64) for t in tables), strict=True))


def _agreement(found: list[Fit], tables: dict[tuple[int, int], np.ndarray], largest: float) -> list[tuple]:
    """Pairs of fits of one k; one with a cluster above ``largest`` is left out."""
    pairs = [(i, j) for (i, j), t in tables.items() if max(t.sum(1).max(), t.sum(0).max()) <= largest * t.sum()]
    return [(found[i].k, found[i].algorithm, found[j].algorithm, float(ari_of_table(tables[i, j])), float(ami_of_table(tables[i, j]))) for i, j in pairs]


def swept(df: DataFrame, cols: list[str], ks=range(2, 9), algorithms: tuple[str, ...] = ALGORITHMS, largest: float = 0.80, key: str = "row_id", seed: int = 42, starts: int = 5) -> tuple[DataFrame, DataFrame]:
    """Every algorithm at every k, fitted once on all rows. First a row for each: sizes, validity by centroids, what the fit reports, and whether one cluster
    has more than ``largest`` of the rows (degenerate). Then k, a, b, ari, ami: agreement of all pairs of algorithms that are not."""
    found = fits(df, cols, ks, algorithms, seed, key, starts)
    marked = labelled(df, cols, found, key).cache()
    rows, tables = quality(marked, len(cols), found, largest), contingencies(marked, len(cols), found)
    marked.unpersist()
    names, make = [c.split()[0] for c in ROW.split(", ")], df.sparkSession.createDataFrame
    return make([tuple(r[c] for c in names) for r in rows], ROW), make(_agreement(found, tables, largest), "k int, a string, b string, ari double, ami double")


def sweep(df: DataFrame, cols: list[str], ks=range(2, 9), algorithms: tuple[str, ...] = ALGORITHMS, **settings) -> DataFrame:
    return swept(df, cols, ks, algorithms, **settings)[0]


def cross_algorithm(df: DataFrame, cols: list[str], ks, algorithms: tuple[str, ...] = ALGORITHMS, **settings) -> DataFrame:
    return swept(df, cols, ks, algorithms, **settings)[1]


def seed_stability(df: DataFrame, cols: list[str], k: int, trials: int = 20, key: str = "row_id", seed: int = 1_000) -> DataFrame:
    """Agreement of all pairs of k-means fits with different seeds, on all rows: mean, least, share above .99."""
    points = _points(df, cols, key).cache()
    centres, _, _ = many_kmeans(points, len(cols), [(k, i) for i in range(trials)], lambda h, x, t: x, seed=seed, family=lambda t: 0)
    points.unpersist()
    found = [Fit("kmeans", k, ("centres", c, None)) for c in centres]
    marked = labelled(df, cols, found, key).cache()
    aris = [float(ari_of_table(t)) for t in contingencies(marked, len(cols), found).values()]
    marked.unpersist()
    return df.sparkSession.createDataFrame([(k, float(np.mean(aris)), min(aris), float(np.mean(np.array(aris) > 0.99)))], "k int, mean_ari double, min_ari double, above_99 double")


def compare_labelings(df: DataFrame, labelings: list[str]) -> DataFrame:
    """a, b, ari, ami of all pairs of label columns that ``df`` already has, from one grouping by all of them; rows where either is null are left out of a pair."""
    cells = df.groupBy(*labelings).agg(F.count("*").alias("_n"))
    parts = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").cast("string").alias("x"), F.col(f"`{b}`").cast("string").alias("y")) for i, a in enumerate(labelings) for b in labelings[i + 1 :]]))
    long = cells.select("_n", parts.alias("p")).select("_n", "p.*").filter("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.sum("_n").alias("n"))
    rows, out = long.collect(), []  # one row for each pair of labels in use
    for a, b in dict.fromkeys((r["a"], r["b"]) for r in rows):
        own = [r for r in rows if (r["a"], r["b"]) == (a, b)]
        xs, ys = sorted({r["x"] for r in own}), sorted({r["y"] for r in own})
        table = np.zeros((len(xs), len(ys)), np.int64)
        for r in own:
            table[xs.index(r["x"]), ys.index(r["y"])] = r["n"]
        out.append((a, b, float(ari_of_table(table.tolist())), float(ami_of_table(table.tolist()))))
    return df.sparkSession.createDataFrame(out, "a string, b string, ari double, ami double")
