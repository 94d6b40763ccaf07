"""Exact neighbours in blocks, and spectral clusters on their graph."""

import numpy as np
import pytest

from cohortry.operators import associate, cluster, neighbours, stability


def rings(n=90, seed=6):
    rng = np.random.default_rng(seed)
    angle = rng.uniform(0, 2 * np.pi, 2 * n)
    radius = np.repeat([1.0, 4.0], n) + rng.normal(0, 0.1, 2 * n)
    return np.column_stack([radius * np.cos(angle), radius * np.sin(angle)])


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rings())], "row_id long, a double, b double").repartition(3).cache()


@pytest.mark.parametrize("block_rows", [13, 4096])
def test_neighbours_are_those_of_all_pairs(rows, block_rows):
    x = rings()
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in neighbours.nearest_rows(rows, ["a", "b"], 5, block_rows=block_rows).collect():
        got.setdefault(r.row_id, []).append((r.distance, r.other))
    assert len(got) == len(x)
    for i, found in got.items():
        want = np.argsort(d[i], kind="stable")[:5]
        assert [o for _, o in sorted(found)] == list(want) and np.allclose([v for v, _ in sorted(found)], d[i][want])


def test_ties_copies_and_few_rows(spark):
    df = spark.createDataFrame([(i, float(i // 3)) for i in range(7)], "row_id long, a double")
    got = {}
    for r in neighbours.nearest_rows(df, ["a"], 3, block_rows=2).collect():
        got.setdefault(r.row_id, []).append((r.distance, r.other))
    assert sorted(got[0]) == [(0.0, 1), (0.0, 2), (1.0, 3)] and sorted(got[6]) == [(1.0, 3), (1.0, 4), (1.0, 5)]
    assert neighbours.nearest_rows(df.filter("row_id = 0"), ["a"], 3).collect() == [] == neighbours.nearest_rows(df.filter("row_id < 0"), ["a"], 3).collect()


def test_vectors_of_a_graph_and_clusters_of_rings(spark, rows):
    x = rings()
    near = np.argsort(((x[:, None] - x) ** 2).sum(2), 1, kind="stable")[:, :16]
    a = np.zeros((len(x), len(x)))
    np.put_along_axis(a, near, 1, 1)
    a = (a + a.T) / 2
    s = 1 / np.sqrt(a.sum(1))
    want = np.linalg.eigvalsh(a * s[:, None] * s)[::-1][:3]
    i, j = np.nonzero(a)
    edges = spark.createDataFrame([(int(p), int(q), float(a[p, q])) for p, q in zip(i, j, strict=True)], "i long, j long, weight double")
    _, values = neighbours.spectral_vectors(edges, 3)
    assert np.allclose(values, want, atol=1e-4)
    labels = {r.row_id: r.cluster for r in neighbours.spectral(rows, ["a", "b"], 2, starts=3).collect()}
    got = [labels[i] for i in range(len(x))]
    assert associate.ari_of_table(stability.contingency(got, np.repeat([0, 1], 90))) == 1
    assert associate.ari_of_table(stability.contingency(got, cluster.spectral(x, 2))) == 1


@pytest.mark.parametrize("values", ["near", "shifted", "tiny", "huge", "copies"])
def test_neighbours_are_exact_where_products_blur(values):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(70, 5)), rng.normal(size=(2_300, 5))
    scale, shift = {"shifted": (1e-3, 1e6), "tiny": (1e-20, 0), "huge": (1e18, 0)}.get(values, (1, 0))
    x, y = x * scale + shift, y * scale + shift
    if values == "copies":
        x, y = np.round(x), np.round(y)
    y[5], x[3, 2] = np.nan, np.nan
    a, b = np.arange(70), 1_000 + np.arange(2_300)
    for p, q, keys, other, same in ((x, y, a, b, False), (y, x, b, a, False), (y, y, b, b, True)):
        got = [np.concatenate(c) for c in zip(*neighbours.nearest_of(keys, p, other, q, 4, same, values=1 << 16), strict=True)]
        ends = np.cumsum(got[1])
        for i in range(0, len(p), 7):
            d = np.sqrt(((p[i] - q) ** 2).sum(1))
            d = np.where((np.arange(len(q)) == i) & same, np.inf, d)
            d = np.where(np.isnan(d), np.inf, d)
            want = [j for j in np.argsort(d, kind="stable")[:4] if np.isfinite(d[j])]
            mine = slice(ends[i] - got[1][i], ends[i])
            assert got[0][i] == keys[i] and got[3][mine].tolist() == other[want].tolist() and got[2][mine] == pytest.approx(d[want], rel=1e-12)
