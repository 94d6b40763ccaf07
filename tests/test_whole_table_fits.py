"""Seeding in passes over all rows, sums in a tree, and information at any size."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import associate, cluster, resample


def blobs(n=300, seed=3):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, 0.3, (m, 3)) for c, m in (((0, 0, 0), n), ((6, 0, 0), n), ((0, 6, 6), 7))])  # the last is small


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(blobs())], "row_id long, a double, b double, c double").repartition(5)


COLS = ["a", "b", "c"]


def test_seeds_reach_a_small_cluster_and_nothing_is_fitted_on_the_driver(rows, monkeypatch):
    monkeypatch.setattr(cluster, "kmeans", lambda *a, **b: pytest.fail("a fit on the driver"))
    points = resample._points(rows, COLS, "row_id")
    seeds = resample.seeded(points, 3, [(3, i) for i in range(6)], lambda h, x, t: x)
    x = blobs()
    for s in seeds:
        owner = cluster.squared_distances(s, np.array([[0, 0, 0], [6, 0, 0], [0, 6, 6]], float)).argmin(1)
        assert sorted(owner) == [0, 1, 2]
    centres = resample.fit(rows, COLS, 3, starts=3)
    assert sorted(np.bincount(cluster.squared_distances(x, centres).argmin(1))) == [7, 300, 300]
    boot = resample.bootstrap(rows, COLS, [2, 3], 4).collect()
    assert {r.k: r.unrested for r in boot} == {2: 0, 3: 0}


def test_sums_do_not_depend_on_partitions_or_on_the_tree(rows):
    def add(total, h, x):
        total[0] += np.round(x).sum(0)
        total[1][0, 0] += len(x)
        return [(int(v) % 2, np.array([float(v)])) for v in h % 97 if v < 3]

    one = resample._passed(resample._points(rows, COLS, "row_id").coalesce(1), 3, [(3,), (2, 2)], add)
    many = resample._passed(resample._points(rows, COLS, "row_id").repartition(9), 3, [(3,), (2, 2)], add, fan_in=2)
    assert all((a == b).all() for a, b in zip(one[0], many[0], strict=True)) and one[0][1][0, 0] == 607
    assert [(t, tuple(x)) for t, x in one[1]] == [(t, tuple(x)) for t, x in many[1]] and one[1]


def test_seeding_of_equal_rows_and_of_fewer_rows_than_centres(spark):
    same = spark.createDataFrame([(i, 1.0) for i in range(20)], "row_id long, a double")
    assert np.allclose(resample.fit(same, ["a"], 3, starts=2), 1.0)
    two = spark.createDataFrame([(0, 1.0), (1, 5.0)], "row_id long, a double")
    assert {1.0, 5.0} <= set(np.round(resample.fit(two, ["a"], 3, starts=4).ravel(), 9)) | {3.0}


def full_expected(r, c, n):
    lg, out = math.lgamma, 0.0
    for x in range(max(1, r + c - n), min(r, c) + 1):
        out += x / n * math.log(n * x / (r * c)) * math.exp(lg(r + 1) + lg(c + 1) + lg(n - r + 1) + lg(n - c + 1) - lg(n + 1) - lg(x + 1) - lg(r - x + 1) - lg(c - x + 1) - lg(n - r - c + x + 1))
    return out


@pytest.mark.parametrize(("r", "c", "n"), [(1, 1, 2), (1, 5, 9), (3, 4, 7), (40, 50, 60), (300, 700, 1000), (999, 999, 1000), (2, 900, 1000), (1500, 1300, 3000)])
def test_expected_information_is_the_full_sum(r, c, n):
    assert abs(associate.expected_information(r, c, n) - full_expected(r, c, n)) < 1e-9


def test_expected_information_at_any_size():
    began = time.time()
    n = 10**9
    for r, c in ((n // 3, n // 4), (5, n // 2), (10**6, 10**7), (n - 3, n // 2)):
        assert 0 <= associate.expected_information(r, c, n) < 1e-8
    assert time.time() - began < 0.05
    table = [[n // 3, 10], [7, n // 5]]
    assert 0.99 < associate.ami_of_table(table) < 1
    # where the sum over the window and the moments meet: the moments at a size that the window still reaches
    r, c, m = 60_000, 70_000, 200_000
    mean, variance = r * c / m, r * c / m * (1 - r / m) * (m - c) / (m - 1)
    moments = (variance / (2 * mean) - variance * (m - 2 * r) * (m - 2 * c) / (m * (m - 2)) / (6 * mean**2) + (3 * variance**2 + variance) / (12 * mean**3)) / m
    assert abs(associate.expected_information(r, c, m) - moments) < 1e-9 * moments + 1e-15


def test_columns_of_the_bootstrap(rows):
    got = resample.bootstrap(rows.withColumn("h", F.lit(1)).withColumn("x", F.lit(2)), COLS, [2], 3)
    assert {"k", "n", "mean_ari", "mean_ami", "unrested"} <= set(got.columns)
