"""Gaussian mixtures by EM on tables of any size, diagonal or full, with held-out likelihood.

A pass gives, for each fit, sums over all rows: memberships, first and second moments, log likelihood and membership entropy. Folds
are shares of the row's hash, so the fits of all k and all folds advance in the same passes, each on the rows outside its
fold and scored on those inside. Fits begin at k-means partitions. Parameters are k-sized; they are all that the driver holds.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from cohortry.operators.resample import _nearest, _passed, _points, many_kmeans, uniform

SWEEP = "k int, log_likelihood double, bic double, aic double, entropy double, converged boolean"
FOLDS = "k int, log_density double, folds int, converged int, chosen boolean"


def log_densities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, spreads: np.ndarray) -> np.ndarray:
    """Log of weight times density of each row in each component; ``spreads``: variances (k x d) or covariances (k x d x d)."""
    d, out = x.shape[1], np.empty((len(x), len(weights)))
    for c, (w, m, s) in enumerate(zip(weights, means, spreads, strict=True)):
        away = x - m
        if s.ndim == 1:
            out[:, c] = math.log(w) - 0.5 * ((away * away) @ (1 / s) + np.log(s).sum() + d * math.log(2 * math.pi))
        else:
            root = np.linalg.cholesky(s)
            out[:, c] = math.log(w) - 0.5 * (((away @ np.linalg.inv(root).T) ** 2).sum(1) + d * math.log(2 * math.pi)) - np.log(np.diag(root)).sum()
    return out


def memberships(log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the components in each row, and the row's log density."""
    top = log.max(1, keepdims=True)
    norm = top + np.log(np.exp(log - top).sum(1, keepdims=True))
    return np.exp(log - norm), norm[:, 0]


def _maximised(s: np.ndarray, k: int, d: int, diagonal: bool, reg: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and spreads from the sums of a pass."""
    n = s[:, 0] + 1e-10
    means = s[:, 1 : 1 + d] / n[:, None]
    second = s[:, 1 + d :] / n[:, None]
    if diagonal:
        return n / n.sum(), means, np.maximum(second - means**2, 0) + reg
    return n / n.sum(), means, second.reshape(k, d, d) - means[:, :, None] * means[:, None, :] + reg * np.eye(d)


def outside(h: np.ndarray, fold: int, folds: int, seed: int) -> np.ndarray:
    """Whether rows lie outside a fold."""
    return (uniform(h, seed * 7 + 3) * folds).astype(int) != fold


def partitions(points: DataFrame, d: int, tasks: list[tuple[int, int]], folds: int = 10, seed: int = 42) -> list[np.ndarray]:
    """Centres of the k-means partitions at which the fits of :func:`many_mixtures` begin."""
    return many_kmeans(points, d, tasks, lambda h, x, t: x, rounds=30, seed=seed, family=lambda t: 0, takes=lambda h, fold: None if fold < 0 else outside(h, fold, folds, seed))[0]


def many_mixtures(df: DataFrame, cols: list[str], tasks: list[tuple[int, int]], folds: int = 10, diagonal: bool = True, rounds: int = 200, reg: float = 1e-5, gain: float = 1e-4, seed: int = 42, key: str = "row_id", points: DataFrame | None = None, centres: list[np.ndarray] | None = None) -> list[dict]:
    """A fit for each task (k, fold): fold -1 takes all rows, another the rows outside it. ``points`` (cached) and ``centres`` (of :func:`partitions`) can be shared.

    ``log_likelihood`` of its rows, ``n``, ``held`` (mean log density of the rows in the fold), ``entropy`` (1: every row is sure), ``converged``:
    whether a pass gained less than ``gain`` a row before ``rounds`` passes, and weights, means and spreads."""
    d, own_points = len(cols), points is None
    points = _points(df, cols, key).cache() if own_points else points
    centres = partitions(points, d, tasks, folds, seed) if centres is None else centres
    width = 1 + d + (d if diagonal else d * d)
    fitted: list[dict | None] = [None] * len(tasks)
    moving, last = list(range(len(tasks))), [-math.inf] * len(tasks)
    for step in range(rounds + 1):
        now = [(tasks[t], fitted[t] and tuple(fitted[t][x] for x in ("weights", "means", "spreads")), centres[t]) for t in moving]

        def add(total, h, x, now=now):
            for i, (task, parameters, begun) in enumerate(now):
                inside = np.zeros(len(x), bool) if task[1] < 0 else ~outside(h, task[1], folds, seed)
                if parameters is None:
                    shares, norm = np.eye(len(begun))[_nearest(x, begun[None])[1][0]], np.zeros(len(x))
                else:
                    shares, norm = memberships(log_densities(x, *parameters))
                own, y = shares[~inside], x[~inside]
                second = own.T @ (y * y) if diagonal else np.stack([(r.T @ r).ravel() for r in (y * s[:, None] for s in np.sqrt(own).T)])  # a product with itself is half the work
                total[2 * i] += np.hstack([own.sum(0)[:, None], own.T @ y, second])
                total[2 * i + 1] += [(~inside).sum(), norm[~inside].sum(), inside.sum(), norm[inside].sum(), (own * np.log(np.maximum(own, 1e-300))).sum()]

        sums, _ = _passed(points, d, [s for task, _, _ in now for s in ((task[0], width), (5,))], add)
        still = []
        for i, t in enumerate(moving):
            k, (n, log, held_n, held, sure) = tasks[t][0], sums[2 * i + 1]
            known = fitted[t]
            rest = known is not None and log - last[t] < gain * n
            if known is not None:
                last[t] = float(log)
                known |= {"n": int(n), "log_likelihood": float(log), "held": float(held / held_n) if held_n else math.nan, "entropy": float(1 + sure / (n * math.log(k))) if k > 1 and n else 1.0, "converged": bool(rest)}
            if not rest and step < rounds:
                weights, means, spreads = _maximised(sums[2 * i], k, d, diagonal, reg)
                fitted[t] = {**(known or {}), "weights": weights, "means": means, "spreads": spreads}
                still.append(t)
        moving = still
        if not moving:
            break
    if own_points:
        points.unpersist()
    return fitted


def free_parameters(k: int, d: int, diagonal: bool) -> int:
    return k - 1 + k * d + (k * d if diagonal else k * d * (d + 1) // 2)


def mixture_sweep(df: DataFrame, cols: list[str], ks=range(2, 9), diagonal: bool = True, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Per k, on all rows: log likelihood, BIC, AIC, normalised entropy, convergence."""
    rows = []
    for k, f in zip(ks, many_mixtures(df, cols, [(k, -1) for k in ks], diagonal=diagonal, seed=seed, key=key), strict=True):
        free = free_parameters(k, len(cols), diagonal)
        rows.append((k, f["log_likelihood"], free * math.log(f["n"]) - 2 * f["log_likelihood"], 2 * free - 2 * f["log_likelihood"], f["entropy"], f["converged"]))
    return df.sparkSession.createDataFrame(rows, SWEEP)


def automatic_k(df: DataFrame, cols: list[str], ks=range(1, 9), folds: int = 10, diagonal: bool = True, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Per k: mean held-out log density over the folds; chosen is the first k that the next one does not better."""
    ks = list(ks)
    fits = many_mixtures(df, cols, [(k, f) for k in ks for f in range(folds)], folds, diagonal, seed=seed, key=key)
    rows = []
    for i, k in enumerate(ks):
        own = [f for f in fits[i * folds : (i + 1) * folds] if not math.isnan(f["held"])]
        rows.append((k, float(np.mean([f["held"] for f in own])), len(own), sum(f["converged"] for f in own)))
    stop = next((i for i in range(len(rows) - 1) if rows[i + 1][1] <= rows[i][1]), len(rows) - 1)
    return df.sparkSession.createDataFrame([(*r, i == stop) for i, r in enumerate(rows)], FOLDS)


def assign(x: np.ndarray, fitted: dict) -> np.ndarray:
    """Memberships of rows."""
    return memberships(log_densities(x, fitted["weights"], fitted["means"], fitted["spreads"]))[0]
