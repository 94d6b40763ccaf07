"""Numbers of tables of large dishes, against exact distributions."""

from __future__ import annotations

import numpy as np
import pytest

from cohortry.llm import seating


@pytest.mark.parametrize("discount", [0.05, 0.3, 0.5, 0.8, 0.95])
def test_numbers_of_seatings(discount):
    exact = seating.log_stirling(1_500, discount)
    t = np.arange(1, 1_480)
    got = seating.log_seatings(np.full(len(t), 1_500), t, discount)
    assert np.abs(got - exact[1_500, t]).max() < 0.03
    assert np.allclose(np.exp(exact[:12, :12]), seating.stirling(11, discount))


@pytest.mark.parametrize("c", [40, 3_000])
@pytest.mark.parametrize("discount, parent, others", [(0.8, 0.01, 20_000), (0.8, 1e-4, 500), (0.4, 0.2, 50), (0.6, 0.5, 100_000)])
def test_draws_follow_the_exact_distribution(c, discount, parent, others):
    n = 3_000
    got = seating.tables_of_many(np.full(n, c), np.ones(n, np.int64), np.arange(n), np.full(n, others + 1), np.full(n, parent), 1.0, discount, 5)
    w = seating.log_stirling(c, discount)[c, 1:] + np.cumsum(np.log((1 + discount * (others + np.arange(c))) * parent))
    p = np.exp(w - w.max())
    p /= p.sum()
    t = np.arange(1, c + 1)
    mean = p @ t
    sd = np.sqrt(p @ (t - mean) ** 2)
    assert abs(got.mean() - mean) < 0.1 * sd + 1e-9 and abs(got.std() - sd) < 0.06 * sd + 1e-9
