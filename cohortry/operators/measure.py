"""Measurement structure: one aggregate over the rows gives the covariances, and the rest is algebra on d x d numbers."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.expressions import rounded, total
from cohortry.functions.special import chi2_sf


def alpha_expression(cols: list[str]) -> Column:
    """Cronbach's alpha as an aggregate; null for under two items."""
    k = len(cols)
    if k < 2:
        return F.lit(None).cast("double")
    return F.lit(k / (k - 1)) * (1 - reduce(lambda a, b: a + b, [F.var_samp(c) for c in cols]) / F.var_samp(total(cols)))


def alpha_if_deleted(df: DataFrame, items: list[str]) -> DataFrame:
    one = df.agg(*[rounded(alpha_expression([x for x in items if x != c])).alias(c) for c in items])
    return one.unpivot([], items, "item", "alpha_if_deleted")


def item_total(df: DataFrame, items: list[str]) -> DataFrame:
    """Correlation of each item with the sum of the others."""
    one = df.agg(*[rounded(F.corr(c, total(items) - F.col(c))).alias(c) for c in items])
    return one.unpivot([], items, "item", "r")


def correlations_long(df: DataFrame, items: list[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(items) for b in items[i + 1 :]]
    return df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rounded(F.corr(a, b)).alias("r")) for a, b in pairs]).alias("x")).select(F.inline("x"))


def covariance(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, int]:
    """Sample covariance matrix and n, from one aggregate of d (d + 1) / 2 numbers."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    row = df.agg(F.count("*"), *[F.covar_samp(cols[i], cols[j]) for i, j in pairs]).first()
    out = np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(pairs, row[1:], strict=True):
        out[i, j] = out[j, i] = v
    return out, row[0]


def correlation_of(cov: np.ndarray) -> np.ndarray:
    s = np.sqrt(np.diag(cov))
    return cov / np.outer(s, s)


def bartlett(r: np.ndarray, n: int) -> dict[str, float]:
    p = len(r)
    chi2 = -(n - 1 - (2 * p + 5) / 6) * math.log(max(np.linalg.det(r), 1e-12))
    dof = p * (p - 1) // 2
    return {"chi2": chi2, "dof": dof, "p": chi2_sf(chi2, dof)}


def kmo(r: np.ndarray) -> tuple[float, np.ndarray]:
    """Sampling adequacy, overall and per item, from partial correlations."""
    inverse = np.linalg.pinv(r)
    d = np.sqrt(np.diag(inverse))
    partial = -inverse / np.outer(d, d)
    off = ~np.eye(len(r), dtype=bool)
    r2, p2 = np.where(off, r * r, 0), np.where(off, partial * partial, 0)
    return float(r2.sum() / (r2.sum() + p2.sum())), r2.sum(0) / (r2.sum(0) + p2.sum(0))


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, descending, and vectors whose largest entry is positive."""
    values, vectors = np.linalg.eigh(matrix)
    order = values.argsort()[::-1]
    vectors = vectors[:, order]
    return values[order], vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(len(values))])


def pca(r: np.ndarray, target: float = 0.95) -> dict:
    values, vectors = eigen(r)
    cumulative = values.cumsum() / values.sum()
    return {"eigenvalues": values, "ratio": values / values.sum(), "cumulative": cumulative, "n_above_one": int((values > 1).sum()), "n_target": int(np.searchsorted(cumulative, target) + 1), "components": vectors}


def parallel_eigenvalues(n: int, p: int, seed: int) -> np.ndarray:
    """Eigenvalues of the correlations of n normal draws of p variables.

    Their scatter matrix has the Wishart law with n - 1 degrees of freedom and is drawn as such (Bartlett), in memory of p x p for any n;
    only n <= p, where it is singular, takes the draws themselves.
    """
    rng = np.random.default_rng([seed, n, p])
    if n <= p:
        return np.linalg.eigvalsh(np.corrcoef(rng.normal(size=(n, p)), rowvar=False))[::-1]
    a = np.tril(rng.normal(size=(p, p)), -1) + np.diag(np.sqrt(rng.chisquare(n - 1 - np.arange(p))))
    a /= np.sqrt((a**2).sum(1, keepdims=True))
    return np.linalg.eigvalsh(a @ a.T)[::-1]


def principal_axis(r: np.ndarray, m: int, rounds: int = 200, tolerance: float = 1e-6) -> np.ndarray:
    """Loadings of m factors by iterated principal axes, from squared multiple correlations."""
    h = 1 - 1 / np.diag(np.linalg.pinv(r))
    for _ in range(rounds):
        reduced = r.copy()
        np.fill_diagonal(reduced, h)
        values, vectors = eigen(reduced)
        loadings = vectors[:, :m] * np.sqrt(np.clip(values[:m], 0, None))
        new = np.clip((loadings**2).sum(1), 0, 1)
        if np.abs(new - h).max() < tolerance:
            break
        h = new
    return loadings


def varimax(loadings: np.ndarray, kaiser: bool = True, gamma: float = 1.0, rounds: int = 500, tolerance: float = 1e-8) -> np.ndarray:
    """Rotated loadings; ``kaiser``: rows are scaled to unit length meanwhile."""
    h = np.sqrt((loadings**2).sum(1)) if kaiser else np.ones(len(loadings))
    h = np.where(h > 0, h, 1)
    a = loadings / h[:, None]
    for _ in range(rounds):
        most = 0.0
        for i in range(a.shape[1]):
            for j in range(i + 1, a.shape[1]):  # the best angle in each plane has a closed form
                u, v = a[:, i] ** 2 - a[:, j] ** 2, 2 * a[:, i] * a[:, j]
                top = 2 * (u @ v) - gamma * 2 * u.sum() * v.sum() / len(a)
                angle = math.atan2(top, u @ u - v @ v - gamma * (u.sum() ** 2 - v.sum() ** 2) / len(a)) / 4
                c, d = math.cos(angle), math.sin(angle)
                a[:, [i, j]] = a[:, [i, j]] @ np.array([[c, -d], [d, c]])
                most = max(most, abs(angle))
        if most < tolerance:
            break
    return a * h[:, None]


def efa(r: np.ndarray, m: int) -> dict:
    """Rotated factors, signed to positive sums and ordered by what they explain; communalities; primary and secondary loadings."""
    rotated = varimax(principal_axis(r, m))
    rotated = rotated * np.where(rotated.sum(0) < 0, -1, 1)
    rotated = rotated[:, (rotated**2).sum(0).argsort()[::-1]]
    by_size = np.sort(np.abs(rotated), axis=1)
    second = by_size[:, -2] if m > 1 else np.zeros(len(r))
    return {"loadings": rotated, "communality": (rotated**2).sum(1), "assigned": np.abs(rotated).argmax(1), "primary": by_size[:, -1], "secondary": second, "cross_loading": second >= 0.30}


def salient(loadings: np.ndarray, items: list[str], least: float = 0.40) -> list[dict[str, list[str]]]:
    return [{"plus": [i for i, v in zip(items, col, strict=True) if v >= least], "minus": [i for i, v in zip(items, col, strict=True) if v <= -least]} for col in loadings.T]


def name_factors(loadings: np.ndarray, items: list[str], facets: dict[str, str]) -> list[str]:
    """The facet of the strongest item of each factor; a name met again gets a number."""
    names: list[str] = []
    for col in loadings.T:
        base = facets.get(items[int(np.abs(col).argmax())], items[int(np.abs(col).argmax())])
        names.append(base if base not in names else f"{base}{sum(n.startswith(base) for n in names) + 1}")
    return names


def measurement_report(df: DataFrame, items: list[str], weak: float = 0.20) -> dict:
    """Alpha, Bartlett, KMO, correlations and an item table; all from one covariance pass."""
    cov, n = covariance(df, items)
    r, k = correlation_of(cov), len(items)
    alpha = lambda c: len(c) / (len(c) - 1) * (1 - np.diag(c).sum() / c.sum())
    rows = []
    for i, item in enumerate(items):
        rest = [j for j in range(k) if j != i]
        with_rest = cov[i, rest].sum() / math.sqrt(cov[i, i] * cov[np.ix_(rest, rest)].sum())
        rows.append({"item": item, "r": float(with_rest), "alpha_if_deleted": float(alpha(cov[np.ix_(rest, rest)])), "weak": bool(with_rest < weak)})
    strong = [i for i, x in enumerate(rows) if not x["weak"]]
    off = r[~np.eye(k, dtype=bool)]
    overall, per_item = kmo(r)
    return {"n": n, "alpha": float(alpha(cov)), "core_alpha": float(alpha(cov[np.ix_(strong, strong)])) if len(strong) > 1 else None, "kmo": overall, "kmo_items": per_item, "bartlett": bartlett(r, n), "mean_r": float(off.mean()), "mean_abs_r": float(np.abs(off).mean()), "max_r": float(off.max()), "min_r": float(off.min()), "items": rows, "correlation": r}


def verdict(alpha: float, adequacy: float) -> str:
    scale = "one scale" if alpha >= 0.70 else "a loose scale" if alpha >= 0.60 else "no single scale"
    return f"{scale}; {'factorable' if adequacy >= 0.60 else 'barely factorable' if adequacy >= 0.50 else 'not factorable'}"


def project(df: DataFrame, cols: list[str], components: np.ndarray, k: int = 2) -> DataFrame:
    """Scores on the first k components of standardised columns, as dot products."""
    dot = lambda w: reduce(lambda a, b: a + b, [F.col(c) * float(v) for c, v in zip(cols, w, strict=True)])
    return df.withColumns({f"pc{i + 1}": dot(components[:, i]) for i in range(k)})
