"""Evidence from bands against plain loops."""

import numpy as np

from cohortry.operators import associate, bands, stability


def test_evidence_of_bands_is_that_of_plain_loops(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(1, 6, (300, 4))
    items = ["p", "q", "r", "s"]
    df = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(x)], "row_id long, p int, q int, r int, s int").selectExpr("*", "1 as k", "2 as band", "3 as n").repartition(3)
    got = {r.k: r for r in bands.evidence(df, items, [2, 3, 5]).collect()}
    cut = lambda v, k: np.minimum(k - 1, np.floor((v - v.min()) * k / (v.max() - v.min()))).astype(int)
    whole, rest, half = x.sum(1), x[:, :3].sum(1), x[:, :2].sum(1)
    for k, r in got.items():
        label = cut(whole, k)
        m = np.array([whole[label == c].mean() for c in range(k)])
        d = np.abs(whole[:, None] - m)
        a = d[np.arange(300), label]
        d[np.arange(300), label] = np.inf
        b = d.min(1)
        within, n = (a * a).sum(), np.bincount(label)
        spread = np.array([a[label == c].mean() for c in range(k)])
        worst = [max((spread[i] + spread[j]) / abs(m[i] - m[j]) for j in range(k) if j != i) for i in range(k)]
        centres = np.array([x[label == c].mean(0) for c in range(k)]) - x.mean(0)
        shape = (n[:, None] * (centres - centres.mean(1, keepdims=True)) ** 2).sum() / (n[:, None] * centres**2).sum()
        want = [((b - a) / np.maximum(a, b)).mean(), np.mean(worst), ((n * (m - whole.mean()) ** 2).sum() / (k - 1)) / (within / (300 - k)), 300 * np.log(within / 300) + k * np.log(300), associate.ari_of_table(stability.contingency(label, cut(rest, k))), associate.ari_of_table(stability.contingency(label, cut(half, k))), shape, n.min() / 300]
        assert np.allclose([r.silhouette, r.davies_bouldin, r.calinski_harabasz, r.bic_gmm, r.bootstrap_ari, r.cross_algo_ari, r.differentiation, r.min_size_frac], want, atol=2e-6)
    curves = {(r.k, r.ref): r.log_w for r in bands.curves(df, items, [1, 3], 4).collect()}
    assert abs(curves[1, -1] - np.log(whole.var())) < 1e-9 and set(curves) == {(k, f) for k in (1, 3) for f in (-1, 0, 1, 2, 3)}
