"""Mixtures, agglomeration and medoids on whole tables, against plain versions on small ones."""

import itertools
import math

import numpy as np
import pytest

from cohortry.operators import agglomerate, associate, cluster, medoid, mixture, resample, stability


def blobs(n=80, seed=1):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, s, (n, 3)) for c, s in (((0, 0, 0), 0.4), ((5, 0, 1), 0.7), ((0, 5, 4), 0.5))])


COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(blobs())], "row_id long, a double, b double, c double").repartition(5).cache()


@pytest.mark.parametrize("diagonal", [True, False])
def test_mixture_is_that_of_the_block(rows, diagonal):
    x = blobs()
    (got,) = mixture.many_mixtures(rows, COLS, [(3, -1)], diagonal=diagonal, gain=1e-6)
    want = cluster.gaussian_mixture(x, 3, diagonal)
    assert got["converged"] and got["n"] == 240 and abs(got["log_likelihood"] - want["log_likelihood"]) < 0.05
    labels = mixture.assign(x, got).argmax(1)
    assert associate.ari_of_table(stability.contingency(labels, np.repeat([0, 1, 2], 80))) == 1


def test_mixture_sums_are_those_of_one_step(rows):
    """One pass from given parameters equals the textbook step."""
    x = blobs()
    (f,) = mixture.many_mixtures(rows, COLS, [(2, -1)], rounds=2)
    (g,) = mixture.many_mixtures(rows, COLS, [(2, -1)], rounds=3)
    r, log = mixture.memberships(mixture.log_densities(x, f["weights"], f["means"], f["spreads"]))
    assert np.allclose(g["means"], r.T @ x / r.sum(0)[:, None]) and np.allclose(g["weights"], r.mean(0)) and abs(f["log_likelihood"] - log.sum()) < 1e-6
    assert np.allclose(g["spreads"], r.T @ (x * x) / r.sum(0)[:, None] - g["means"] ** 2 + 1e-5)


def test_held_out_density_and_automatic_k(rows):
    x = blobs()
    folds = 4
    both = resample._points(rows, COLS, "row_id").collect()
    h, y = np.array([r.h for r in both], np.int64).view(np.uint64), np.array([r.x for r in both])
    part = (resample.uniform(h, 42 * 7 + 3) * folds).astype(int)
    fits = mixture.many_mixtures(rows, COLS, [(3, f) for f in range(folds)], folds)
    for f, got in enumerate(fits):
        norm = mixture.memberships(mixture.log_densities(y, got["weights"], got["means"], got["spreads"]))[1]
        assert got["n"] == (part != f).sum() and abs(got["held"] - norm[part == f].mean()) < 1e-9 and abs(got["log_likelihood"] - norm[part != f].sum()) < 1e-6
    table = {r.k: r for r in mixture.automatic_k(rows, COLS, range(1, 6), folds).collect()}
    assert [k for k, r in table.items() if r.chosen] == [3] and table[3].log_density > table[2].log_density > table[1].log_density
    sweep = {r.k: r for r in mixture.mixture_sweep(rows, COLS, range(2, 5)).collect()}
    assert min(sweep, key=lambda k: sweep[k].bic) == 3 and sweep[3].entropy > 0.99 and all(r.converged for r in sweep.values())
    free = mixture.free_parameters(3, 3, True)
    assert free == 2 + 9 + 9 and abs(sweep[3].bic - sweep[3].aic - free * (math.log(len(x)) - 2)) < 1e-6


@pytest.mark.parametrize("linkage", ["ward", "average", "complete"])
def test_tree_of_a_small_table_is_exact(rows, linkage):
    x = blobs()
    labels = {r.row_id: r.cluster for r in agglomerate.agglomerate(rows, COLS, 4, linkage).collect()}
    merges = cluster.merge_tree(x, linkage)
    assert associate.ari_of_table(stability.contingency([labels[i] for i in range(len(x))], cluster.cut_tree(merges, len(x), 4))) == 1
    f = agglomerate.features(resample._points(rows, COLS, "row_id"), 3)
    assert f.radius == 0 and len(f.n) == len(x) and np.allclose(agglomerate.weighted_tree(f, linkage)[:, 2], merges[:, 2])
    assert abs(agglomerate.cophenetic(f, agglomerate.weighted_tree(f, linkage)) - cluster.cophenetic(x, merges)) < 1e-9


def test_features_keep_counts_and_sums_and_find_the_groups(rows):
    x = blobs()
    f = agglomerate.features(resample._points(rows, COLS, "row_id"), 3, most=20, fan_in=2)
    assert len(f.n) <= 20 and f.n.sum() == len(x) and np.allclose(f.sums.sum(0), x.sum(0)) and abs(f.squares.sum() - (x * x).sum()) < 1e-6 and f.radius > 0
    labels = {r.row_id: r.cluster for r in agglomerate.agglomerate(rows, COLS, 3, most=20).collect()}
    assert associate.ari_of_table(stability.contingency([labels[i] for i in range(len(x))], np.repeat([0, 1, 2], 80))) == 1
    report = {r.linkage: r for r in agglomerate.hierarchy(rows, COLS, range(2, 4), most=50).collect()}
    assert set(report) == {"ward", "complete", "average"} and sum(r.reported for r in report.values()) == 1 and report["ward"].cophenetic > 0.7 and len(report["ward"].heights) == 10


def test_features_of_repeated_rows_and_of_none(spark):
    same = spark.createDataFrame([(i, float(i % 3)) for i in range(300)], "row_id long, a double").repartition(4)
    f = agglomerate.features(resample._points(same, ["a"], "row_id"), 1, most=50)
    assert sorted(f.n) == [100, 100, 100] and f.radius == 0
    assert agglomerate.agglomerate(same.filter("row_id < 0"), ["a"], 3).collect() == []
    assert agglomerate.agglomerate(same, ["a"], 5).select("cluster").distinct().count() == 3


def people(n=60, seed=4):
    rng = np.random.default_rng(seed)
    return [(i, float(rng.integers(1, 6)), float(rng.normal()) if i % 11 else None, str(rng.choice(list("abc"))), str(rng.choice(["x", "y"])) if i % 7 else None) for i in range(n)]


def test_medoids_of_a_small_table_cannot_be_bettered_by_a_swap(spark):
    data = people()
    df = spark.createDataFrame(data, "row_id long, p double, q double, r string, s string").repartition(3)
    chosen, table = medoid.medoids(df, ["p", "q"], ["r", "s"], [2, 3], candidates=100)
    points, numbers, _ = medoid.gower_points(df, ["p", "q"], ["r", "s"], "row_id")
    x = np.array([r.x for r in points.collect()], float)
    spread = {1: max(r[1] for r in data) - min(r[1] for r in data), 2: max(r[2] for r in data if r[2] is not None) - min(r[2] for r in data if r[2] is not None)}
    plain = lambda a, b: (sum(abs(a[j] - b[j]) / spread[j] if a[j] is not None and b[j] is not None else 1 for j in (1, 2)) + sum(a[j] != b[j] for j in (3, 4))) / 4
    d = medoid.gower(x, x, numbers)
    assert sorted(np.round(d.ravel(), 9)) == sorted(round(plain(a, b), 9) for a in data for b in data)
    for r in table.collect():
        cost = lambda m: medoid.gower(x, m, numbers).min(1).sum()
        m = chosen[r.k]
        assert r.rested and abs(cost(m) - r.cost) < 1e-9
        assert all(cost(np.vstack([m[:i], x[j : j + 1], m[i + 1 :]])) >= r.cost - 1e-9 for i, j in itertools.product(range(r.k), range(len(x))))


def test_medoids_with_few_candidates_come_near_the_optimum(spark):
    x = blobs(200)
    df = spark.createDataFrame([(i, *map(float, r), "g") for i, r in enumerate(x)], "row_id long, a double, b double, c double, g string").repartition(4)
    chosen, table = medoid.medoids(df, COLS, ["g"], [3], candidates=30)
    row = table.first()
    labels = medoid.gower(np.array([[*(r / np.ptp(x, axis=0)), 0.0] for r in x]), np.hstack([chosen[3][:, :3], np.zeros((3, 1))]), 3).argmin(1)
    assert row.rested and row.silhouette > 0.7 and associate.ari_of_table(stability.contingency(labels, np.repeat([0, 1, 2], 200))) == 1


def test_medoids_measure_equal_rows_once(spark, monkeypatch):
    df = spark.range(3_000).selectExpr("id AS row_id", "id % 4 AS p", "id % 5 AS q", "CAST(id % 3 AS string) AS r")
    seen, passed = [], medoid._passed
    monkeypatch.setattr(medoid, "_passed", lambda points, size, shapes, add: (seen.append((size, points.count())), passed(points, size, shapes, add))[1])
    chosen, table = medoid.medoids(df, ["p", "q"], ["r"], [2, 3], candidates=30)
    assert {n for size, n in seen if size == 4} == {60} and sum(n > 60 for _, n in seen) <= 3
    x = np.array([r["x"] for r in medoid.gower_points(df, ["p", "q"], ["r"], "row_id")[0].collect()])
    for r in table.collect():
        d = np.sort(medoid.gower(x, chosen[r.k], 2), 1)
        assert math.isclose(r.cost, d[:, 0].sum()) and math.isclose(r.silhouette, float((1 - d[:, 0] / d[:, 1]).mean()))
