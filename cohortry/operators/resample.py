"""Model selection on tables of any size: rows stay where they are, and many fits advance in one pass.

A fit of :func:`many_kmeans` sees the table through a view: a resample (rows whose hash falls below a share) or uniform draws
in place of the values. Both depend on the row's hash only, so a lost task gives the same sums again. A pass gives, for each fit,
sums that Spark adds up in a tree; only they and the few rows drawn as candidates reach the driver, so its work does not
depend on the number of rows. First centres come from k-means|| over all rows: some rounds draw rows in proportion to their squared
distance from the candidates so far, a pass counts the rows nearest to each candidate, and weighted k-means++ picks among them.
"""

from __future__ import annotations

import math
import weakref
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators import associate, validity
from cohortry.operators.associate import ami_of_table, ari_of_table
from cohortry.operators.cluster import squared_distances
from cohortry.operators.stability import agreement_summary, gap_summary
from cohortry.session import ship_code
from cohortry.staging import free_shuffles

View = Callable[[np.ndarray, np.ndarray, tuple[int, int]], np.ndarray]


def uniform(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on hash and salt only."""
    x = hashes + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def uniforms(hashes: np.ndarray, salt: int, size: int) -> np.ndarray:
    """``size`` numbers for each hash, two to a 64-bit value."""
    half = (size + 1) // 2
    salts = np.array([((salt * 4_099 + j) * 0x9E3779B97F4A7C15) % (1 << 64) for j in range(half)], np.uint64)
    x = hashes[:, None] + salts
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(times)
    x ^= x >> np.uint64(31)
    return x.view(np.uint32)[:, :size] * (1 / float(1 << 32))


def _points(df: DataFrame, cols: list[str], key: str, small: int = 1_000_000, least: int = 1) -> DataFrame:
    """Hash and values of each row. A table of fewer than ``small`` rows is dealt out, so that all cores share its many fits: to partitions of ``least`` rows or more."""
    points = df.select(F.xxhash64(key).alias("h"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    n = df.count()
    return points.repartition(max(1, min(df.sparkSession.sparkContext.defaultParallelism, n // least))) if n < small else points


def _arrays(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy().view(np.uint64), batch.column(1).flatten().to_numpy().reshape(-1, size)


PARTS = "slot int, part int, sums binary, task int, x array<double>"
PART_TYPES = pa.schema([("slot", pa.int32()), ("part", pa.int32()), ("sums", pa.binary()), ("task", pa.int32()), ("x", pa.list_(pa.float64()))])


#: Bytes that passes have shuffled since their files were last let go.
_shuffled: list[int] = []


#: Partitions of the tables that passes read.
_partitions: weakref.WeakKeyDictionary[DataFrame, int] = weakref.WeakKeyDictionary()


def _passed(points: DataFrame, size: int, shapes: list[tuple], add: Callable[..., list[tuple[int, np.ndarray]] | None], slots: int = 16, fan_in: int = 64, read: Callable[[pa.RecordBatch, int], tuple] = _arrays, direct: int = 1 << 24) -> tuple[list[np.ndarray], list[tuple[int, np.ndarray]]]:
    """One pass: the sums of what ``add`` has put into arrays of these shapes, and the (task, row) pairs it has returned.

    ``add`` takes the arrays and what ``read`` finds in a batch. Each partition sends its sums in ``slots`` slices; they are added in a tree, ``fan_in`` at a time. Up to ``fan_in`` partitions whose sums have no more than
    ``direct`` bytes together send them to the driver, which adds them in the same order."""
    lengths = [int(np.prod(s)) for s in shapes]
    left = _partitions.get(points) or points.rdd.getNumPartitions()
    _partitions[points] = left
    if at_once := left <= fan_in and 8 * sum(lengths) * left <= direct:
        slots = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = [np.zeros(s) for s in shapes], TaskContext.get().partitionId()
        for batch in batches:
            drawn = add(total, *read(batch, size)) if batch.num_rows else None
            if drawn:
                yield pa.RecordBatch.from_arrays([pa.array([-1 - t % slots for t, _ in drawn], pa.int32()), pa.array([part] * len(drawn), pa.int32()), pa.nulls(len(drawn), pa.binary()), pa.array([t for t, _ in drawn], pa.int32()), pa.array([x.tolist() for _, x in drawn], pa.list_(pa.float64()))], schema=PART_TYPES)
        flat = np.array_split(np.concatenate([t.ravel() for t in total]), slots)
        yield pa.RecordBatch.from_arrays([pa.array(range(slots), pa.int32()), pa.array([part] * slots, pa.int32()), pa.array([f.tobytes() for f in flat], pa.binary()), pa.nulls(slots, pa.int32()), pa.nulls(slots, pa.list_(pa.float64()))], schema=PART_TYPES)

    def together(rows: pa.Table) -> pa.Table:
        rows = rows.select(PART_TYPES.names)
        if rows.column("slot")[0].as_py() < 0:
            return rows
        rows = rows.sort_by("part")  # sums of floats in one order, whatever came first
        sums = np.sum([np.frombuffer(b) for b in rows.column("sums").to_pylist()], axis=0)
        return pa.table([[rows.column("slot")[0].as_py()], [rows.column("part")[0].as_py()], [sums.tobytes()], [None], [None]], schema=PART_TYPES)

    ship_code(points.sparkSession)
    parts = points.mapInArrow(run, PARTS)
    shuffled = 0 if at_once else 8 * sum(lengths) * left
    while left > fan_in:
        parts = parts.groupBy("slot", F.expr(f"part div {fan_in}").alias("_group")).applyInArrow(together, PARTS).withColumn("part", F.expr(f"part div {fan_in}").cast("int"))
        left = math.ceil(left / fan_in)
    found = (parts if at_once else parts.groupBy("slot").applyInArrow(together, PARTS)).collect()  # sums of each fit, and its candidates
    _shuffled.append(shuffled)
    if sum(_shuffled) > 1 << 26:  # passes follow each other faster than Spark would clear their files
        _shuffled.clear()
        free_shuffles(points.sparkSession)
    if not found:
        return [np.zeros(s) for s in shapes], []
    sent = sorted((r for r in found if r["slot"] >= 0), key=lambda r: (r["slot"], r["part"]))
    flat = np.sum([np.frombuffer(r["sums"]) for r in sent], axis=0) if at_once else np.concatenate([np.frombuffer(r["sums"]) for r in sent])
    sums = [part.reshape(shape) for part, shape in zip(np.split(flat, np.cumsum(lengths)[:-1]), shapes, strict=True)]
    return sums, sorted(((r["task"], np.array(r["x"])) for r in found if r["slot"] < 0), key=lambda r: (r[0], tuple(r[1])))


def weighted_plus_plus(points: np.ndarray, weights: np.ndarray, k: int, seed: tuple[int, ...], draws: int = 8) -> np.ndarray:
    """``k`` of a few weighted points: the best of several k-means++ draws by weighted cost; points repeat where there are fewer."""
    best = None
    for draw in range(draws):
        rng = np.random.default_rng([*seed, draw])
        chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
        near = squared_distances(points, points[chosen])[:, 0]
        while len(chosen) < k:
            p = near * weights
            chosen.append(int(rng.choice(len(points), p=p / p.sum())) if p.sum() > 0 else int(rng.integers(len(points))))
            near = np.minimum(near, squared_distances(points, points[chosen[-1:]])[:, 0])
        cost = float(near @ weights)
        if best is None or cost < best[0]:
            best = cost, points[chosen]
    return best[1]


#: Distances that are measured at once: what fits in a processor's cache.
AT_ONCE = 1 << 19
#: Values of rows that are measured at once, for the same reason.
VALUES_AT_ONCE = 1 << 17


class Together:
    """Tasks (k, id) that share work in a pass. Those of one ``family`` see the same values, ``view`` of any of them; ``takes`` selects rows by
    hash and id (None: all). Centres of a family are measured by one matrix product."""

    def __init__(self, tasks: list[tuple[int, int]], view: View, family: Callable | None = None, takes: Callable | None = None):
        self.tasks, self.view, self.takes, self.families = tasks, view, takes, {}
        for t, task in enumerate(tasks):
            self.families.setdefault(family(task) if family else t, []).append(t)

    def blocks(self, h: np.ndarray, x: np.ndarray, widths: list[int], some: list[int] | None = None) -> Iterator[tuple[list[int], slice, np.ndarray, np.ndarray | None]]:
        """(tasks, rows, values, taken) over all families, a bounded number of distances at a time; ``taken`` has a row for each task."""
        chosen = None if some is None else set(some)
        for members in self.families.values():
            members = sorted((t for t in members if chosen is None or t in chosen), key=lambda t: widths[t])
            if not members:
                continue
            v, lots = self.view(h, x, self.tasks[members[0]]), {}
            if self.takes:
                lots = {i: self.takes(h, i) for i in {self.tasks[t][1] for t in members}}
            groups, now = [], []
            for t in members:
                if now and (len(now) + 1) * widths[t] > 2_048:
                    groups.append(now)
                    now = []
                now.append(t)
            for group in [*groups, now]:
                step = max(64, min(AT_ONCE // (len(group) * widths[group[-1]]), VALUES_AT_ONCE // max(v.shape[1], 1)))
                for at in range(0, len(v), step):
                    rows = slice(at, min(at + step, len(v)))
                    masks = [lots.get(self.tasks[t][1]) for t in group]
                    taken = None if all(m is None for m in masks) else np.array([np.ones(rows.stop - at, bool) if m is None else m[rows] for m in masks])
                    yield group, rows, v[rows], taken


def _nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of fits of one k (fits x k x columns): squared distance of each row to the nearest centre of each fit, and which it is; the first of several."""
    fits, k, size = centres.shape
    flat = centres.transpose(1, 0, 2).reshape(-1, size)
    d = (flat @ (-2 * v.T)).reshape(k, fits, len(v))
    d += (flat * flat).sum(1).reshape(k, fits, 1)
    best, label = d[0].copy(), np.zeros((fits, len(v)), np.int8 if k < 128 else np.int32)
    for c in range(1, k):
        np.copyto(label, c, where=d[c] < best)
        np.minimum(best, d[c], out=best)
    best += (v * v).sum(1)
    return np.maximum(best, 0, out=best), label


def _nearest_each(v: np.ndarray, centres: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """For fits (k x columns) in ascending order of k: places of those of one k, and of them what :func:`_nearest` gives. One product measures all centres."""
    flat = np.vstack(centres)
    d = flat @ (-2 * v.T)
    d += (flat * flat).sum(1)[:, None]
    norm, begin = (v * v).sum(1), 0
    for k, some in groupby(range(len(centres)), key=lambda n: len(centres[n])):
        some = list(some)
        end = begin + k * len(some)
        mine = d[begin:end].reshape(len(some), k, len(v))
        best, label = mine[:, 0].copy(), np.zeros((len(some), len(v)), np.int8 if k < 128 else np.int32)
        for c in range(1, k):
            np.copyto(label, c, where=mine[:, c] < best)
            np.minimum(best, mine[:, c], out=best)
        best += norm
        yield some, np.maximum(best, 0, out=best), label
        begin = end


def _owned(v: np.ndarray, centres: list[np.ndarray], taken: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For fits (k x columns) in ascending order of k: a row of ones and zeros for each centre, ones where it is the nearest of its fit to a row that is ``taken``; and each fit's sum of squared distances."""
    flat = np.vstack(centres)
    d = flat @ (-2 * v.T)
    d += (flat * flat).sum(1)[:, None]
    norm, lost, begin = (v * v).sum(1), np.empty(len(centres)), 0
    there = np.full(len(centres), len(v)) if taken is None else taken.sum(1)
    for k, some in groupby(range(len(centres)), key=lambda n: len(centres[n])):
        some = list(some)
        some = slice(some[0], some[-1] + 1)
        end = begin + k * (some.stop - some.start)
        mine = d[begin:end].reshape(-1, k, len(v))
        best = mine.min(axis=1)
        near = best + norm
        np.maximum(near, 0, out=near)
        if taken is not None:
            near *= taken[some]
            np.copyto(best, np.nan, where=~taken[some])
        lost[some] = near.sum(1)
        np.copyto(mine, mine == best[:, None])
        begin = end
    if d.sum() == there.sum():
        return d, lost
    begin = 0  # some row is as near to two centres of a fit: the first of them has it
    for some, near, label in _nearest_each(v, centres):
        if taken is not None:
            mine = taken[some]
            near *= mine
            label[~mine] = -1
        lost[some] = near.sum(1)
        k = len(centres[some[0]])
        end = begin + k * len(some)
        d[begin:end].reshape(len(some), k, len(v))[:] = label[:, None] == np.arange(k, dtype=label.dtype)[:, None]
        begin = end
    return d, lost


def seeded(points: DataFrame, size: int, tasks: list[tuple[int, int]], view: View, seed: int = 42, rounds: int = 4, family: Callable | None = None, takes: Callable | None = None) -> list[np.ndarray]:
    """First centres for each task (k, id) by k-means||: about 2k rows are drawn in each of ``rounds`` passes over all rows."""
    together = Together(tasks, view, family, takes)

    def moments(total, h, x):
        for group, _, v, taken in together.blocks(h, x, [1] * len(tasks)):
            both = np.hstack([np.ones((len(v), 1)), (v * v).sum(1)[:, None], v])
            sums = both.sum(0)[None].repeat(len(group), 0) if taken is None else taken.astype(float) @ both
            for t, row in zip(group, sums, strict=True):
                total[t] += row

    sums, _ = _passed(points, size, [(size + 2,)] * len(tasks), moments)
    candidates = [[s[2:] / max(s[0], 1)] for s in sums]
    cost = [max(0.0, s[1] - (s[2:] @ s[2:]) / max(s[0], 1)) for s in sums]

    def measured(v: np.ndarray, group: list[int], now: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of all candidates of these tasks to the rows, less the rows' own squares, and where each task's begin."""
        flat = np.vstack([now[t] for t in group])
        d = flat @ (-2 * v.T)
        d += (flat * flat).sum(1)[:, None]
        return d, np.cumsum([0, *[len(now[t]) for t in group[:-1]]])

    for step in range(rounds):
        now = [np.array(c) for c in candidates]

        def draw(total, h, x, now=now, cost=tuple(cost), step=step):
            found = []
            for group, rows, v, taken in together.blocks(h, x, [len(c) for c in now]):
                d, begin = measured(v, group, now)
                near = np.minimum.reduceat(d, begin, axis=0)
                near += (v * v).sum(1)
                np.maximum(near, 0, out=near)
                if taken is not None:
                    near *= taken
                total[0][group] += near.sum(1)
                for t, mine in zip(group, near, strict=True):
                    if cost[t] > 0:
                        k, i = tasks[t]
                        took = np.flatnonzero(uniform(h[rows], (seed * 31 + step) * 1_000_003 + k * 10_007 + i + 1) * cost[t] < 2 * k * mine)
                        found += [(t, v[r]) for r in took]
            return found

        (left,), drawn = _passed(points, size, [(len(tasks),)], draw)
        cost = [float(c) for c in left]  # of the candidates before this draw: at least what remains
        for t, x in drawn:
            candidates[t].append(x)

    final = [np.array(c) for c in candidates]

    def weigh(total, h, x):
        for group, _, v, taken in together.blocks(h, x, [len(c) for c in final]):
            d, begin = measured(v, group, final)
            for i, t in enumerate(group):
                own = d[begin[i] : begin[i] + len(final[t])].argmin(0)
                total[t] += np.bincount(own if taken is None else own[taken[i]], minlength=len(final[t]))

    weights, _ = _passed(points, size, [(len(c),) for c in final], weigh)
    return [weighted_plus_plus(c, w if w.sum() else np.ones(len(c)), k, (seed, k, i + 1)) for c, w, (k, i) in zip(final, weights, tasks, strict=True)]


def many_kmeans(points: DataFrame, size: int, tasks: list[tuple[int, int]], view: View, rounds: int = 300, seed: int = 42, family: Callable | None = None, takes: Callable | None = None) -> tuple[list[np.ndarray], list[float], list[bool]]:
    """Centres, inertia and whether they came to rest, for each task (k, id).

    A fit rests when a pass lowers its inertia by no more than a millionth, and is then left out of further passes; after ``rounds`` passes
    the others are given as they are, marked. ``family`` and ``takes``: as in :class:`Together`."""
    together, widths = Together(tasks, view, family, takes), [k for k, _ in tasks]
    centres = seeded(points, size, tasks, view, seed, family=family, takes=takes)
    inertia, moving = [math.inf] * len(tasks), list(range(len(tasks)))
    for _ in range(rounds):
        at = {t: n for n, t in enumerate(moving)}
        now = {t: centres[t] for t in moving}

        def add(total, h, x, now=now, at=at):
            for group, _, v, taken in together.blocks(h, x, widths, list(now)):
                both = np.hstack([np.ones((len(v), 1)), v])
                ends = np.cumsum([widths[t] for t in group])[:-1]
                own, lost = _owned(v, [now[t] for t in group], taken)
                for t, rows, less in zip(group, np.split(own @ both, ends), lost, strict=True):
                    out = total[at[t]]
                    out[:, 0] += rows[:, 0]
                    out[:, 2:] += rows[:, 1:]
                    out[0, 1] += less

        sums, _ = _passed(points, size, [(len(centres[t]), size + 2) for t in moving], add)
        still = []
        for t, s in zip(moving, sums, strict=True):
            before, inertia[t] = inertia[t], float(s[:, 1].sum())
            centres[t] = np.where(s[:, :1] > 0, s[:, 2:] / np.maximum(s[:, :1], 1), centres[t])
            if before - inertia[t] > 1e-6 * inertia[t]:
                still.append(t)
        moving = still
        if not moving:
            break
    return centres, inertia, [t not in set(moving) for t in range(len(tasks))]


def bootstrap(df: DataFrame, cols: list[str], ks, resamples: int = 200, share: float = 0.8, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Per k: adjusted Rand agreement of refits on resamples with the full fit, as :func:`stability.agreement_summary` has it, and how many fits did not come to rest. A resample has the rows whose hash falls below ``share``."""
    tasks = [(k, i) for k in ks for i in range(-1, resamples)]

    def drawn(h: np.ndarray, i: int) -> np.ndarray | None:
        return None if i < 0 else uniform(h, seed * 100_003 + i) < share

    one = lambda t: 0
    points = _points(df, cols, key).cache()
    centres, _, rested = many_kmeans(points, len(cols), tasks, lambda h, x, t: x, seed=seed, family=one, takes=drawn)
    whole = {k: c for (k, i), c in zip(tasks, centres, strict=True) if i < 0}
    drawn_tasks = [(t, c) for t, c in zip(tasks, centres, strict=True) if t[1] >= 0]
    together, widths = Together([t for t, _ in drawn_tasks], lambda h, x, t: x, one, drawn), [len(c) for _, c in drawn_tasks]

    def add(total, h, x):
        reference = {k: _nearest(x, c[None])[1][0] for k, c in whole.items()}
        for group, rows, v, taken in together.blocks(h, x, widths):
            for k in {widths[t] for t in group}:
                some = [n for n, t in enumerate(group) if widths[t] == k]
                label = _nearest(v, np.array([drawn_tasks[group[n]][1] for n in some]))[1]
                cell = label.astype(np.int64) * k + reference[k][rows]
                for n, own in zip(some, cell, strict=True):
                    total[group[n]] += np.bincount(own[taken[n]], minlength=k * k).reshape(k, k)

    tables, _ = _passed(points, len(cols), [(len(c), len(c)) for _, c in drawn_tasks], add)
    points.unpersist()
    still = [r for t, r in zip(tasks, rested, strict=True) if t[1] >= 0]
    runs = [(k, float(ari_of_table(t.astype(np.int64))), float(ami_of_table(t.astype(np.int64))), r) for ((k, _), _), t, r in zip(drawn_tasks, tables, still, strict=True)]
    found = df.sparkSession.createDataFrame(runs, "k int, ari double, ami double, rested boolean")
    return agreement_summary(found).join(found.groupBy("k").agg(F.count_if(~F.col("rested")).alias("unrested")), "k")


def gap(df: DataFrame, cols: list[str], ks=range(1, 9), references: int = 50, seed: int = 42, key: str = "row_id") -> DataFrame:
    """k, gap, s: log dispersion of all rows against that of references. A reference has a uniform draw in the box of the principal axes for each row."""
    points, size = _points(df, cols, key).cache(), len(cols)

    def moments(total, h, x):
        total[0][0, 0] += len(x)
        total[0][1] += x.sum(0)
        total[0][2:] += x.T @ x

    (found,), _ = _passed(points, size, [(size + 2, size)], moments)
    n, centre = found[0, 0], found[1] / found[0, 0]
    axes = np.linalg.eigh(found[2:] / n - np.outer(centre, centre))[1]

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = (_arrays(batch, size)[1] - centre) @ axes
                for j in range(size):
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([y[:, j].min()]), pa.array([y[:, j].max()])], names=["j", "low", "high"])

    ends = points.mapInArrow(turned, "j int, low double, high double").groupBy("j").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("j").collect()  # one row per column
    low, high = np.array([r["low"] for r in ends]), np.array([r["high"] for r in ends])

    wide = high - low

    def view(h: np.ndarray, x: np.ndarray, task: tuple[int, int]) -> np.ndarray:
        """Rows, or draws in the box along its axes: a turn changes no distance."""
        return x if task[1] < 0 else low + wide * uniforms(h, seed * 100_003 + task[1], size)

    tasks = [(k, r) for r in range(-1, references) for k in ks]
    _, inertia, _ = many_kmeans(points, size, tasks, view, seed=seed, family=lambda t: t[1])
    points.unpersist()
    runs = [(k, r, math.log(w)) for (k, r), w in zip(tasks, inertia, strict=True)]
    return gap_summary(df.sparkSession.createDataFrame(runs, "k int, ref int, log_w double"), references)


def fit(df: DataFrame, cols: list[str], k: int, starts: int = 25, seed: int = 42, key: str = "row_id") -> np.ndarray:
    """Centres of the best of several k-means fits on all rows, which advance together; by descending mean of the centre."""
    points = _points(df, cols, key).cache()
    centres, inertia, _ = many_kmeans(points, len(cols), [(k, i) for i in range(starts)], lambda h, x, t: x, seed=seed, family=lambda t: 0)
    points.unpersist()
    best = centres[int(np.argmin(inertia))]
    return best[sorted(range(k), key=lambda c: (-round(float(best[c].mean()), 9), tuple(np.round(best[c], 6))))]


def holdout(train: DataFrame, test: DataFrame, cols: list[str], centres: np.ndarray, starts: int = 25, seed: int = 42, key: str = "row_id") -> dict:
    """How a frozen model holds on other rows (centroid drift, proportions, silhouettes, agreement with a fresh fit): ``centres`` from the training rows against the rows held out. Silhouettes are the simplified ones."""
    from cohortry.functions.special import chi2_sf

    k, labelled = len(centres), lambda df, m: validity.nearest_centroid(df, cols, m.tolist(), key).select(key, "cluster").join(df.select(key, *cols), key)
    fresh = labelled(test, fit(test, cols, k, starts, seed, key)).select(key, F.col("cluster").alias("_fresh"))
    seen, frozen = labelled(train, centres), labelled(test, centres)
    means = {r["cluster"]: r for r in validity.centroids(frozen, cols).collect()}  # k rows
    sizes = {r["cluster"]: r["n"] for r in seen.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # k rows
    drift = [float(np.linalg.norm(np.array([means[c][x] for x in cols]) - centres[c])) for c in range(k) if c in means]
    n_seen, n_held = sum(sizes.values()), sum(r["n"] for r in means.values())
    expected, got = [sizes.get(c, 0) / n_seen * n_held for c in range(k)], [means[c]["n"] if c in means else 0 for c in range(k)]
    p = chi2_sf(float(sum((g - e) ** 2 / e for g, e in zip(got, expected, strict=True) if e)), k - 1)
    return {
        "max_drift": max(drift), "mean_drift": float(np.mean(drift)), "proportion_p": p, "silhouette_train": validity.simplified_silhouette(seen, cols).first()[0], "silhouette_holdout": validity.simplified_silhouette(frozen, cols).first()[0],
        "ari_frozen_fresh": associate.agreement(frozen.join(fresh, key), "cluster", "_fresh").first()["ari"], "drift_ok": max(drift) <= 0.50, "proportions_ok": p > 0.05,
    }
