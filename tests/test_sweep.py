"""The whole-table sweep against indices of a block, and agreement of given labelings."""

import numpy as np
import pytest

from cohortry.operators import associate, cluster, stability, sweep, validity


def blobs(n=60, seed=2):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, 0.5, (n, 3)) for c in ((0, 0, 0), (5, 0, 1), (0, 5, 4))])


COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(blobs())], "row_id long, a double, b double, c double").repartition(3).cache()


def test_every_algorithm_and_its_indices(spark, rows):
    x = blobs()
    got = {(r.algorithm, r.k): r for r in sweep.sweep(rows, COLS, [2, 3]).collect()}
    assert set(got) == {(a, k) for a in sweep.ALGORITHMS for k in (2, 3)}
    want = cluster.indices(x, np.repeat([0, 1, 2], 60))
    with_labels = rows.selectExpr("*", "cast(row_id div 60 as int) as cluster")
    simple = validity.simplified_silhouette(with_labels, COLS).first()[0]
    for a in sweep.ALGORITHMS:
        r = got[a, 3]
        assert (r.n_clusters_found, r.min_size, r.max_size, r.degenerate) == (3, 60, 60, False), a
        assert abs(r.silhouette - simple) < 1e-6 and abs(r.davies_bouldin - want["davies_bouldin"]) < 1e-9 and abs(r.calinski_harabasz - want["calinski_harabasz"]) < 1e-6
        assert abs(r.differentiation - want["differentiation"]) < 1e-9 and abs(r.between_ss - want["between_ss"]) < 1e-6
    full = cluster.gaussian_mixture(x, 3)
    assert abs(got["gmm_full", 3].bic - full["bic"]) < 0.1 and abs(got["gmm_full", 3].aic - full["aic"]) < 0.1 and got["gmm_full", 3].converged and got["kmeans", 3].converged
    assert abs(got["kmeans", 3].inertia - cluster.kmeans(x, 3)[2]) < 1e-6
    table = sweep.sweep(rows, COLS, [2], ("kmeans",)).selectExpr("*", "cast(null as string) as error")
    assert stability.exclusions(table).count() == 0
    assert [(r.algorithm, r.ks) for r in stability.exclusions(table.drop("degenerate").selectExpr("*", "true as degenerate")).collect()] == [("kmeans", [2])]
    assert sweep.seed_stability(rows, COLS, 3, 4).first().min_ari == 1


def test_agreement_of_algorithms(rows):
    got = sweep.cross_algorithm(rows, COLS, [3], ("kmeans", "gmm_diag", "ward")).collect()
    assert {(r.k, r.a, r.b, r.ari) for r in got} == {(3, "kmeans", "gmm_diag", 1.0), (3, "kmeans", "ward", 1.0), (3, "gmm_diag", "ward", 1.0)}


def test_agreement_of_given_labelings(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(3)), str(rng.integers(2)), int(rng.integers(4)) if i % 5 else None) for i in range(200)]
    got = {(r.a, r.b): r for r in sweep.compare_labelings(spark.createDataFrame(rows, "p int, q string, `r s` int"), ["p", "q", "r s"]).collect()}
    assert set(got) == {("p", "q"), ("p", "r s"), ("q", "r s")}
    for (a, b), (i, j) in {("p", "q"): (0, 1), ("p", "r s"): (0, 2), ("q", "r s"): (1, 2)}.items():
        own = [(str(r[i]), str(r[j])) for r in rows if r[i] is not None and r[j] is not None]
        table = stability.contingency([x for x, _ in own], [y for _, y in own])
        assert abs(got[a, b].ari - associate.ari_of_table(table)) < 1e-12 and abs(got[a, b].ami - associate.ami_of_table(table)) < 1e-12


def test_passes_of_few_partitions_are_added_on_the_driver(spark, monkeypatch):
    from cohortry.operators import resample

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(300, 3)))], "row_id long, a double, b double, c double").repartition(5)
    points, grouped = resample._points(df, ["a", "b", "c"], "row_id").cache(), []
    group_by = type(points).groupBy
    monkeypatch.setattr(type(points), "groupBy", lambda self, *a: (grouped.append(a), group_by(self, *a))[1])

    def add(total, h, x):
        total[0] += x.T @ x
        total[1] += x.sum(0)
        return [(3, x[0])]

    tree, drawn = resample._passed(points, 3, [(3, 3), (3,)], add, direct=0)
    assert grouped
    grouped.clear()
    sums, same = resample._passed(points, 3, [(3, 3), (3,)], add)
    assert not grouped and all((a == b).all() for a, b in zip(tree, sums, strict=True))
    assert [(t, r.tolist()) for t, r in drawn] == [(t, r.tolist()) for t, r in same] and len(same) > 1


def test_mixtures_of_a_sweep_begin_at_the_same_partitions(spark, monkeypatch):
    from cohortry.operators import mixture, sweep

    rng, begun = np.random.default_rng(6), []
    x = np.vstack([rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    df, cols = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double"), ["a", "b"]
    kmeans = mixture.many_kmeans
    monkeypatch.setattr(mixture, "many_kmeans", lambda *a, **k: (begun.append(a), kmeans(*a, **k))[1])
    found = sweep.fits(df, cols, [2, 3], starts=1)
    assert len(begun) == 1 and [(f.algorithm, f.k) for f in found] == [(a, k) for a in sweep.ALGORITHMS for k in (2, 3)]
    alone = mixture.many_mixtures(df, cols, [(2, -1), (3, -1)], diagonal=False)
    both = [f for f in found if f.algorithm == "gmm_full"]
    assert all(np.allclose(a["means"], f.rule[2]) and np.allclose(a["spreads"], f.rule[3]) for a, f in zip(alone, both, strict=True))


@pytest.mark.parametrize("tied", [False, True])
def test_assignment_by_equality_is_that_by_labels(tied):
    from cohortry.operators import resample

    rng = np.random.default_rng(7)
    v = rng.integers(0, 3, (90, 4)).astype(float) if tied else rng.normal(size=(90, 4))
    centres = [v[rng.integers(0, 90, k)] + (0 if tied else 0.1) for k in (2, 2, 3, 5)]
    for taken in (None, rng.random((4, 90)) < 0.7):
        own, lost = resample._owned(v, centres, taken)
        at = 0
        for f, c in enumerate(centres):
            d = ((v[:, None] - c) ** 2).sum(2)
            there = np.ones(90, bool) if taken is None else taken[f]
            assert (own[at : at + len(c)].T == np.eye(len(c))[d.argmin(1)] * there[:, None]).all()
            assert lost[f] == pytest.approx((d.min(1) * there).sum())
            at += len(c)
