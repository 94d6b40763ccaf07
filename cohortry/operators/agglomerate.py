"""Agglomeration of tables of any size, over clustering features.

A feature is a group of near rows: its count, sum and sum of squares. Each task condenses its rows, batch by batch, to at most
``most`` features, and these are merged in a tree, ``fan_in`` tasks at a time, to at most ``most`` for the table; then the features are
agglomerated with their counts. A table of up to ``most`` different rows is condensed to these rows, and the tree is exact. Of a larger
one, rows within the final radius of each other are taken together before the tree begins; the radius is reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators import validity
from cohortry.operators.cluster import cut_tree, squared_distances
from cohortry.operators.resample import _arrays, _points
from cohortry.session import ship_code

FEATURES = "part int, radius double, n array<double>, sums array<double>, squares array<double>"
TYPES = pa.schema([("part", pa.int32()), ("radius", pa.float64()), ("n", pa.list_(pa.float64())), ("sums", pa.list_(pa.float64())), ("squares", pa.list_(pa.float64()))])
REPORT = "linkage string, features int, radius double, cophenetic double, heights array<double>, largest_frac double, degenerate boolean, reported boolean"


class Features:
    """Counts, sums and sums of squares of groups of rows, and the radius within which rows were taken together."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, radius: float = 0.0):
        self.n, self.sums, self.squares, self.radius = n, sums, squares, radius

    @classmethod
    def of_rows(cls, x: np.ndarray) -> Features:
        return cls(np.ones(len(x)), x, (x * x).sum(1))

    def centres(self) -> np.ndarray:
        return self.sums / self.n[:, None]

    def merged(self, group: np.ndarray) -> Features:
        k = group.max() + 1 if len(group) else 0
        sums = np.zeros((k, self.sums.shape[1]))
        np.add.at(sums, group, self.sums)
        return Features(np.bincount(group, self.n, k), sums, np.bincount(group, self.squares, k), self.radius)

    def condensed(self, most: int) -> Features:
        """At most ``most`` features: equal ones first, then leaders take what lies within a radius that grows as needed."""
        now = self.merged(np.unique(self.centres(), axis=0, return_inverse=True)[1].ravel()) if len(self.n) else self
        while len(now.n) > most:
            centres = now.centres()
            if not now.radius:  # to begin with, how near the nearest of a few features lies
                few = centres[:: max(1, len(centres) // 200)]
                near = np.sqrt(np.sort(squared_distances(few, centres), 1)[:, 1])
                now.radius = float(np.median(near)) or float(near.max()) or 1e-9
            free, group, leaders = np.ones(len(centres), bool), np.empty(len(centres), np.int64), 0
            heavy = np.argsort(-now.n, kind="stable")
            for i in heavy:
                if free[i]:
                    open_ = np.flatnonzero(free)
                    took = open_[squared_distances(centres[open_], centres[i : i + 1])[:, 0] <= now.radius**2]
                    took = np.union1d(took, [i])
                    group[took], free[took] = leaders, False
                    leaders += 1
            now = now.merged(group)
            if len(now.n) > most:
                now.radius *= 1.3
        return now

    def row(self, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([self.radius]), *[pa.array([a.ravel().tolist()], pa.list_(pa.float64())) for a in (self.n, self.sums, self.squares)]], schema=TYPES)

    @classmethod
    def joined(cls, parts: list[Features]) -> Features:
        return cls(*(np.concatenate([getattr(p, a) for p in parts]) for a in ("n", "sums", "squares")), max(p.radius for p in parts))


def features(points: DataFrame, size: int, most: int = 2_000, fan_in: int = 16) -> Features:
    """At most ``most`` features of all rows (h, x)."""

    def read(rows: list[dict]) -> Features:
        return Features.joined([Features(np.array(r["n"]), np.array(r["sums"]).reshape(-1, size), np.array(r["squares"]), r["radius"]) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Features(np.empty(0), np.empty((0, size)), np.empty(0))
        for batch in batches:
            x = _arrays(batch, size)[1]
            for at in range(0, len(x), most):
                now = Features.joined([now, Features.of_rows(x[at : at + most])]).condensed(most)
        yield now.row(TaskContext.get().partitionId())

    def together(table: pa.Table) -> pa.Table:
        rows = table.select(TYPES.names).sort_by("part").to_pylist()
        return pa.Table.from_batches([read(rows).condensed(most).row(rows[0]["part"] // fan_in)], TYPES)

    ship_code(points.sparkSession)
    parts, left = points.mapInArrow(run, FEATURES), points.rdd.getNumPartitions()
    while left > 1:
        parts = parts.withColumn("_group", F.expr(f"part div {fan_in}")).groupBy("_group").applyInArrow(together, FEATURES)
        left = math.ceil(left / fan_in)
    found = parts.collect()  # one row: at most ``most`` features
    return read(found) if found else Features(np.empty(0), np.empty((0, size)), np.empty(0))


def weighted_tree(f: Features, linkage: str = "ward") -> np.ndarray:
    """Merges (a, b, height), lowest first, of features with counts, by nearest-neighbour chains. Distances are those of centres."""
    n, size = len(f.n), f.n.copy()
    d = squared_distances(f.centres(), f.centres())
    d = d * (2 * size[:, None] * size / (size[:, None] + size)) if linkage == "ward" else np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    alive, chain, merges = np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            b = int(np.where(alive, d[a], np.inf).argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        height, sa, sb = d[a, b], size[a], size[b]
        if linkage == "ward":
            new = ((sa + size) * d[a] + (sb + size) * d[b] - size * height) / (sa + sb + size)
        elif linkage == "complete":
            new = np.maximum(d[a], d[b])
        else:
            new = (sa * d[a] + sb * d[b]) / (sa + sb)
        merges.append((a, b, math.sqrt(height) if linkage == "ward" else height))
        new[~alive], new[b] = np.inf, np.inf
        d[b], d[:, b] = new, new
        alive[a], size[b] = False, sa + sb
        d[a], d[:, a] = np.inf, np.inf
    return np.array(sorted(merges, key=lambda m: m[2])).reshape(-1, 3)


def cophenetic(f: Features, merges: np.ndarray) -> float:
    """Correlation of distances with the heights at which pairs meet, each pair of features as often as it has pairs of rows."""
    n = len(f.n)
    groups, where, heights = {i: np.array([i]) for i in range(n)}, np.arange(n), np.zeros((n, n))
    for a, b, h in merges:
        ga, gb = where[int(a)], where[int(b)]
        one, two = groups.pop(ga), groups[gb]
        heights[np.ix_(one, two)], heights[np.ix_(two, one)] = h, h
        groups[gb] = np.concatenate([two, one])
        where[one] = gb
    upper = np.triu_indices(n, 1)
    x, y, w = np.sqrt(squared_distances(f.centres(), f.centres()))[upper], heights[upper], (f.n[:, None] * f.n)[upper]
    mean = lambda v: (v * w).sum() / w.sum()
    x, y = x - mean(x), y - mean(y)
    spread = math.sqrt(mean(x * x) * mean(y * y))
    return float(mean(x * y) / spread) if spread else math.nan


def labels_of(df: DataFrame, cols: list[str], f: Features, group: np.ndarray, key: str) -> DataFrame:
    """Each row's cluster: that of the nearest feature. The features go with the code: at most ``most`` of them."""
    centres = f.centres()
    order = sorted(range(group.max() + 1), key=lambda c: (-round(float((f.sums[group == c].sum(0) / f.n[group == c].sum()).mean()), 9), c))
    number = np.argsort(order)[group].astype(np.int32)
    size = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, size)
            near = np.concatenate([squared_distances(x[i : i + 1000], centres).argmin(1) for i in range(0, len(x), 1000)] or [np.empty(0, int)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number[near], pa.int32())], names=[key, "cluster"])

    ship_code(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.array(*[F.col(c).cast("double") for c in cols])).mapInArrow(run, f"`{key}` {kind}, cluster int")


def agglomerate(df: DataFrame, cols: list[str], k: int, linkage: str = "ward", most: int = 2_000, key: str = "row_id") -> DataFrame:
    """key and ``cluster`` (0 has the largest mean) of all rows, from the tree cut at ``k`` clusters; fewer where fewer rows differ."""
    points = _points(df, cols, key).cache()
    f = features(points, len(cols), most)
    points.unpersist()
    if not len(f.n):
        return df.select(key, F.lit(0).alias("cluster"))
    return labels_of(df, cols, f, cut_tree(weighted_tree(f, linkage), len(f.n), min(k, len(f.n))), key)


def hierarchy(df: DataFrame, cols: list[str], ks=range(2, 9), linkages: tuple[str, ...] = ("ward", "complete", "average"), largest: float = 0.90, most: int = 2_000, key: str = "row_id") -> DataFrame:
    """Per linkage: cophenetic correlation, the last ten heights, the largest share of a cluster over all k and whether it is above
    ``largest``; ``reported`` is the linkage that follows the distances best among the others."""
    points = _points(df, cols, key).cache()
    f = features(points, len(cols), most)
    points.unpersist()
    rows = []
    for name in linkages if len(f.n) > 1 else ():
        merges = weighted_tree(f, name)
        worst = max(np.bincount(cut_tree(merges, len(f.n), min(k, len(f.n))), f.n).max() / f.n.sum() for k in ks)
        rows.append((name, len(f.n), float(f.radius), cophenetic(f, merges), [float(h) for h in merges[-10:, 2]], float(worst), bool(worst > largest)))
    best = max((r for r in rows if not r[-1]), key=lambda r: r[3], default=(None,))[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], REPORT)


def simplified_quality(df: DataFrame, cols: list[str], labels: DataFrame, key: str = "row_id") -> DataFrame:
    """Sizes by centroids and the simplified silhouette of labels."""
    return validity.simplified_silhouette(df.join(labels.select(key, "cluster"), key), cols)
