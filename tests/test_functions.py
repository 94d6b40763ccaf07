"""Special functions against known values, and properties of agreement measures."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortry.functions import special
from cohortry.operators import associate, cluster, measure, stability


@pytest.mark.parametrize("got, want", [(special.chi2_sf(3.841458820694124, 1), 0.05), (special.chi2_sf(18.307038053275146, 10), 0.05), (special.chi2_sf(0.5, 4), 0.9735009788392561), (special.f_sf(4.413873419170566, 1, 18), 0.05), (special.t_two_sided(2.2281388519649385, 10), 0.05), (special.t_two_sided(0.0, 5), 1.0), (special.binomial_two_sided(2, 10), 0.109375), (special.binomial_two_sided(5, 10), 1.0), (special.beta_i(2, 3, 0.4), 0.5248)])
def test_tails(got, want):
    assert got == pytest.approx(want, rel=2e-4)


def test_f_against_its_density():
    x = np.linspace(1.0, 400.0, 4_000_001)
    d1, d2 = 3, 7
    log = math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2) + d1 / 2 * math.log(d1 / d2)
    density = np.exp(log) * x ** (d1 / 2 - 1) * (1 + d1 * x / d2) ** (-(d1 + d2) / 2)
    assert special.f_sf(1.0, d1, d2) == pytest.approx(np.trapezoid(density, x), abs=1e-5)


@given(st.floats(0.3, 60), st.floats(0.01, 120))
@settings(max_examples=60, deadline=None)
def test_gamma_recurrence(a, x):
    assert special.gamma_q(a + 1, x) == pytest.approx(special.gamma_q(a, x) + math.exp(a * math.log(x) - x - math.lgamma(a + 1)), abs=1e-10)


labels = st.lists(st.integers(0, 4), min_size=5, max_size=60)


@given(labels, st.permutations(range(5)))
@settings(max_examples=60, deadline=None)
def test_agreement_ignores_names(a, names):
    if len(set(a)) > 1:
        same = stability.contingency(a, [names[x] for x in a])
        assert associate.ari_of_table(same) == pytest.approx(1)
        assert associate.ami_of_table(same) == pytest.approx(1)


#: Published confusion matrices, their adjusted Rand index and best agreement.
GOLDEN = [([[29, 302, 30], [257, 3, 116], [44, 13, 193]], 0.4590, 0.762), ([[7, 168, 186], [46, 46, 284], [107, 2, 141]], 0.1093, 0.566), ([[64, 264, 33], [149, 60, 167], [184, 38, 28]], 0.2152, 0.623), ([[44, 288, 29], [5, 156, 215], [14, 42, 194]], 0.2018, 0.524)]


@pytest.mark.parametrize("table, ari, agreement", GOLDEN)
def test_published_matrices(table, ari, agreement):
    assert associate.ari_of_table(table) == pytest.approx(ari, abs=5e-4)
    assert associate.best_agreement(table) == pytest.approx(agreement, abs=5e-4)


def test_chi2_and_kappa():
    r = associate.chi2_of_table([[324, 281, 319], [6, 37, 20]])
    assert (r["chi2"], r["dof"]) == (pytest.approx(26.32, abs=0.01), 2) and r["v_plain"] == pytest.approx(0.163, abs=5e-4) and r["p"] == pytest.approx(1.9e-6, rel=0.05)
    assert associate.chi2_of_table([[10, 20], [30, 15]])["chi2"] == pytest.approx(6.752232, abs=1e-6)  # corrected at one degree of freedom
    accuracy, kappa = associate.kappa_of_table([[319, 25, 17], [44, 298, 34], [34, 38, 178]])
    assert accuracy == pytest.approx(0.805471, abs=1e-6) and kappa == pytest.approx(0.7029, abs=1e-4)
    assert associate.ari_of_table([[134, 72, 116], [99, 105, 102], [34, 60, 53], [63, 80, 67], [0, 1, 1]]) == pytest.approx(0.0099, abs=5e-4)


def blobs(n=60, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.array([[4, 4, 4], [0, 0, 0], [-4, 4, -4]])
    where = np.repeat([0, 1, 2], n)
    return centres[where] + rng.normal(0, 0.6, (3 * n, 3)), where


def test_trees_of_a_block():
    z, where = blobs(12)
    merges = cluster.merge_tree(z, "average")
    assert len(merges) == len(z) - 1 and (np.diff(merges[:, 2]) >= -1e-9).all() and cluster.cophenetic(z, merges) > 0.8
    assert associate.ari_of_table(stability.contingency(cluster.cut_tree(merges, len(z), 3), where)) == 1
    # Ward's lowest merge is the closest pair
    d = np.sqrt(cluster.squared_distances(z, z)) + np.diag([np.inf] * len(z))
    assert cluster.merge_tree(z, "ward")[0, 2] == pytest.approx(d.min())
    with pytest.raises(ValueError, match="up to"):
        cluster.merge_tree(np.zeros((cluster.MOST_PAIRS + 1, 1)))


def test_factors_recover_structure():
    rng = np.random.default_rng(1)
    f = rng.normal(size=(4000, 2))
    x = np.hstack([f[:, [0]] + 0.6 * rng.normal(size=(4000, 3)), f[:, [1]] + 0.6 * rng.normal(size=(4000, 3))])
    r = np.corrcoef(x, rowvar=False)
    found = measure.efa(r, 2)
    assert len({*found["assigned"][:3]}) == len({*found["assigned"][3:]}) == 1 and found["assigned"][0] != found["assigned"][3]
    assert not found["cross_loading"].any() and measure.kmo(r)[0] > 0.6 and measure.bartlett(r, 4000)["p"] < 1e-6
    assert measure.pca(r)["cumulative"][-1] == pytest.approx(1)
    turned = measure.varimax(found["loadings"])
    assert np.allclose((turned**2).sum(1), found["communality"])
    assert measure.name_factors(found["loadings"], list("abcdef"), dict.fromkeys("abcdef", "x")) == ["x", "x2"]
