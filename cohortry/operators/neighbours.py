"""Nearest neighbours of all rows, exactly, and what is built on their graph.

Rows are packed into blocks; every pair of groups of blocks is a task of its own, which leaves ``k`` neighbours for each of its rows, and the
lists of a row are merged. No pair of rows is written. The work is that of all pairs, so it grows with the square of the rows: the
graph is for tables where that is affordable, and what follows it is linear in the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.resample import _passed, fit, uniform
from cohortry.operators.validity import nearest_centroid, paired, side
from cohortry.session import ship_code
from cohortry.staging import Staged, stage


def blocks(df: DataFrame, cols: list[str], key: str, block_rows: int) -> DataFrame:
    """block, keys, x: up to ``block_rows`` rows of a partition each, staged."""
    size = len(cols)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                x = np.array(part.column(1).to_pylist(), float).reshape(-1, size)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["block", "keys", "x"])
                number += 1

    ship_code(df.sparkSession)
    rows = df.select(F.col(key).cast("long"), F.array(*[F.col(c).cast("double") for c in cols]))
    return stage(rows.mapInArrow(pack, "block long, keys binary, x binary"), "knn-blocks")


def nearest_of(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, k: int, same: bool = False, values: int = 1 << 23) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys ``a``, how many neighbours each has, and their distances and keys of ``b``, some rows at a time; ``same``: both sides are the same rows.

    Products of single precision rule out what is farther than the ``k``-th by more than their error can be (double precision, where squares are too large); the others
    are measured by their differences."""
    fine = np.isfinite(y).all(1)
    centre = y[fine].mean(0) if fine.any() else np.zeros(y.shape[1])  # a shift changes no distance, but large values blur products
    u, v = x - centre, y - centre
    most_u, most_v = (float(np.sqrt((w[np.isfinite(w).all(1)] ** 2).sum(1).max(initial=0))) for w in (u, v))
    kind = np.float32 if 1e-12 < max(most_u, most_v) < 1e15 else float
    error = (y.shape[1] + 8) * float(np.finfo(kind).eps) * (2 * most_u + most_v) * most_v
    turned, square = (-2 * v.T).astype(kind), (v * v).sum(1).astype(kind)
    step = max(16, min(512, values // max(1, len(y))))
    for at in range(0, len(x), step):
        d = u[at : at + step].astype(kind) @ turned
        d += square
        own = np.arange(len(d))
        if same:
            d[own, at + own] = np.inf
        first = d[:, :2_048]
        some = min(k, first.shape[1])
        limit = np.partition(first, some - 1, 1)[:, some - 1] if first.shape[1] > k else np.full(len(d), np.inf)  # that of a part of the rows is no less than that of all
        limit = np.where(np.isnan(limit), np.inf, limit + 2 * error).astype(kind)
        row, col = np.divmod(np.flatnonzero(d <= np.nextafter(limit, kind(np.inf))[:, None]), len(y))
        rough = d[row, col].astype(float)
        order = np.lexsort((rough, row))
        row, col, rough = row[order], col[order], rough[order]
        begin = np.searchsorted(row, np.arange(len(d) + 1))
        last = np.minimum(begin[:-1] + k, begin[1:]) - 1  # the k-th by the products
        close = rough <= rough[last[row]] + 2 * error if len(row) else np.empty(0, bool)
        row, col = row[close], col[close]
        exact = np.concatenate([np.sqrt(((x[at + row[i : i + 8_192]] - y[col[i : i + 8_192]]) ** 2).sum(1)) for i in range(0, len(row), 8_192)] or [np.empty(0)])
        whole = np.isfinite(exact) & ((at + row != col) if same else True)
        row, col, exact = row[whole], col[whole], exact[whole]
        order = np.lexsort((b[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col, exact = row[kept], col[kept], exact[kept]
        yield a[at : at + step], np.bincount(row, minlength=len(d)), exact, b[col]


def nearest_rows(df: DataFrame, cols: list[str], k: int = 15, key: str = "row_id", block_rows: int = 4_096, most_groups: int = 24) -> DataFrame:
    """key (a long, different in all rows), ``other`` and ``distance``: the ``k`` nearest other rows of each row, ties to the smaller key.

    Blocks are sent to at most ``most_groups`` pairs of groups, and a row has a list from each group, so what is shuffled grows as the rows do."""
    packed, size = blocks(df, cols, key, block_rows).withColumnRenamed("block", "part"), len(cols)
    if packed.isEmpty():
        return df.sparkSession.createDataFrame([], f"{key} long, other long, distance double")

    def near(table: pa.Table) -> pa.Table:
        a, _, x = side(table, True, size)
        if table.column("i")[0].as_py() == table.column("j")[0].as_py():
            parts = list(nearest_of(a, x, a, x, k, same=True))
        else:
            b, _, y = side(table, False, size)
            parts = [*nearest_of(a, x, b, y, k), *nearest_of(b, y, a, x, k)]
        keys, counts, exact, other = (np.concatenate(c) for c in zip(*parts, strict=True))
        found = pa.StructArray.from_arrays([pa.array(exact, pa.float64()), pa.array(other, pa.int64())], names=["d", "o"])
        return pa.table({"key": pa.array(keys, pa.int64()), "found": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), found)})

    lists = paired(packed, most_groups, block_rows).groupBy("i", "j").applyInArrow(near, "key long, found array<struct<d: double, o: long>>")
    merged = lists.groupBy("key").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("found"))  # a list from each group
    return merged.select(F.col("key").alias(key), F.inline("found")).select(key, F.col("o").alias("other"), F.col("d").alias("distance"))


def _turned(rows: DataFrame, turn: np.ndarray) -> DataFrame:
    """i, and ``v`` times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, len(turn)) @ turn
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    return rows.select("i", "v").mapInArrow(run, "i long, v array<double>")


def spectral_vectors(edges: DataFrame, size: int, powers: int = 8, restarts: int = 6, close: float = 1e-5, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """i and v: the leading ``size`` vectors of the normalised graph divided by the root of the degree, and their eigenvalues.

    ``edges``: i, j, weight, both ways. A block Krylov method: a step joins the edges with the last block of vectors and sums over each row;
    after ``powers`` steps the best vectors in the span of all blocks are found from their products, a matrix of a few dozen rows
    that alone reaches the driver. It begins anew from them until no eigenvalue moves by more than ``close``, or ``restarts`` times."""
    wide = size + 2
    degrees = stage(edges.groupBy("i").agg(F.sum("weight").alias("degree")), "spectral-degrees")
    ends = degrees.select(F.col("i").alias("j"), F.col("degree").alias("_d"))
    scaled = stage(edges.join(degrees, "i").join(ends, "j").select("i", "j", (F.col("weight") / F.sqrt(F.col("degree") * F.col("_d"))).alias("w")), "spectral-edges")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(1).to_numpy().view(np.uint64)
            v = np.column_stack([uniform(h, seed * 1_009 + c) - 0.5 for c in range(wide)]) if len(h) else np.empty((0, wide))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    def products(total, h, x):
        total[0] += x.T @ x

    ship_code(edges.sparkSession)
    now = Staged(degrees.select("i", F.xxhash64("i")).mapInArrow(start, "i long, v array<double>"), "spectral-vectors")
    before = None
    for _ in range(restarts):
        basis = now
        for step in range(powers):
            last = basis.df.select(F.col("i").alias("j"), F.slice("v", step * wide + 1, wide).alias("u"))
            moved = scaled.join(last, "j").groupBy("i").agg(F.array(*[F.sum(F.col("w") * F.get("u", F.lit(c))) for c in range(wide)]).alias("y"))
            grown = Staged(basis.df.join(moved, "i").select("i", F.concat("v", "y").alias("v")), "spectral-basis")
            if basis is not now:
                basis.drop()
            basis = grown
        many = wide * powers
        (whole,), _ = _passed(basis.df.select(F.col("i").alias("h"), F.col("v").alias("x")), many + wide, [(many + wide, many + wide)], products)
        spread, axes = np.linalg.eigh(whole[:many, :many])
        kept = spread > 1e-11 * spread[-1]
        whiten = axes[:, kept] / np.sqrt(spread[kept])
        inside = whiten.T @ whole[:many, wide:] @ whiten
        values, best = np.linalg.eigh((inside + inside.T) / 2)
        turn = np.zeros((many + wide, min(wide, len(values))))
        turn[:many] = whiten @ best[:, ::-1][:, :wide]
        after = Staged(_turned(basis.df, turn), "spectral-vectors")
        basis.drop()
        now.drop()
        now, values = after, values[::-1][:size]
        if before is not None and np.abs(values - before).max() < close:
            break
        before = values
        wide = turn.shape[1]
    return now.df.join(degrees, "i").select("i", F.transform(F.slice("v", 1, size), lambda x: x / F.sqrt("degree")).alias("v")), values


def spectral(df: DataFrame, cols: list[str], k: int, neighbours: int = 15, key: str = "row_id", seed: int = 42, starts: int = 10) -> DataFrame:
    """key and ``cluster``: k-means on the leading vectors of the neighbour graph (a row is its own neighbour; an edge weighs half for each end that has it)."""
    near = nearest_rows(df, cols, neighbours, key)
    one_way = near.select(F.col(key).alias("i"), F.col("other").alias("j"), F.lit(0.5).alias("weight"))
    own = df.select(F.col(key).cast("long").alias("i"), F.col(key).cast("long").alias("j"), F.lit(1.0).alias("weight"))
    edges = stage(one_way.unionAll(one_way.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight")).unionAll(own).groupBy("i", "j").agg(F.sum("weight").alias("weight")), "spectral-graph")
    vectors, _ = spectral_vectors(edges, k, seed=seed)
    names = [f"v{c}" for c in range(k)]
    rows = stage(vectors.select(F.col("i").alias(key), *[F.get("v", F.lit(c)).alias(n) for c, n in enumerate(names)]), "spectral-rows")
    return nearest_centroid(rows, names, fit(rows, names, k, starts, seed, key).tolist(), key).select(key, "cluster")
