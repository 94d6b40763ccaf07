"""Tail probabilities, without scipy: regularised incomplete gamma and beta functions and what follows from them; the gamma function's logarithm and its slope for arrays."""

from __future__ import annotations

import math

import numpy as np

TINY, STEPS = 1e-300, 500


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:  # series of the lower function
        term = total = 1 / a
        for n in range(1, STEPS):
            term *= x / (a + n)
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1 / TINY, 1 / b
    h = d
    for n in range(1, STEPS):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b or TINY)
        c = b + an / c or TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return min(1.0, scale * h)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(STEPS):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or TINY)
        c = 1 + top / c or TINY
        f *= c * d
        if i and abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def chi2_sf(x: float, dof: float) -> float:
    return gamma_q(dof / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_two_sided(t: float, dof: float) -> float:
    return beta_i(dof / 2, 0.5, dof / (dof + t * t))


def binomial_two_sided(k: int, n: int) -> float:
    """Exact test of k successes in n against one half."""
    if n == 0:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
    return min(1.0, 2 * sum(math.exp(log(i)) for i in range(min(k, n - k) + 1))) if 2 * k != n else 1.0


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs."""
    if n < 3 or abs(r) >= 1:
        return float(abs(r) < 1)
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series eight further on."""
    y = x + 8.0
    steps = np.ones_like(y)
    for i in range(8):
        steps *= x + i
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y - np.log(steps)


def digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by the slope of the same series."""
    y = x + 8.0
    steps = np.zeros_like(y)
    for i in range(8):
        steps += 1 / (x + i)
    z = 1 / (y * y)
    return np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - steps
