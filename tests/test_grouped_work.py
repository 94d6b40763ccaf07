"""Work that grows with the rows: fits that share a pass's products, and pairs of groups of rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import neighbours, resample, topics, validity


def test_tasks_of_a_family_are_measured_together():
    x, h, called = np.arange(40.0).reshape(20, 2), np.arange(20, dtype=np.uint64), []
    tasks = [(k, i) for k in (2, 3) for i in (-1, 0, 1)]
    together = resample.Together(tasks, lambda h, x, t: (called.append(t), x)[1], lambda t: 0, lambda h, i: None if i < 0 else h % 2 == i)
    seen = {t: [] for t in range(6)}
    for group, rows, v, taken in together.blocks(h, x, [k for k, _ in tasks]):
        for n, t in enumerate(group):
            seen[t] += v[:, 0].tolist() if taken is None else v[taken[n], 0].tolist()
    assert len(called) == 1
    assert all(seen[t] == [r[0] for i, r in enumerate(x) if tasks[t][1] < 0 or i % 2 == tasks[t][1]] for t in seen)
    c = np.random.default_rng(1).normal(size=(4, 3, 2))
    d, label = resample._nearest(x, c)
    want = ((x[None, :, None] - c[:, None]) ** 2).sum(3)
    assert np.allclose(d, want.min(2)) and (label == want.argmin(2)).all()


def test_silhouette_of_odd_rows(spark):
    """Rows without a label or a value have 0 and are no one's neighbours, as in the SQL; equal rows are at a distance of exactly 0."""
    rows = [(0, 0, 1e6, 1.0), (1, 0, 1e6, 1.0), (2, 1, 1e6 + 4, 1.0), (3, 1, 1e6 + 4, 1.0), (4, None, 1e6, 1.0), (5, 0, None, 1.0), (6, 2, 1e6 + 9, 1.0)]
    df = spark.createDataFrame(rows, "row_id long, cluster int, a double, b double").repartition(3)
    got = {r.row_id: (r.a, r.b, r.silhouette) for r in validity.silhouette_rows(df, ["a", "b"], block_rows=2).collect()}
    assert got == {0: (0.0, 4.0, 1.0), 1: (0.0, 4.0, 1.0), 2: (0.0, 4.0, 1.0), 3: (0.0, 4.0, 1.0), 4: (None, None, 0.0), 5: (None, None, 0.0), 6: (None, 5.0, 0.0)}


@pytest.mark.parametrize("block_rows", [2, 1_000])
def test_gower_nearest_against_brute_force(spark, block_rows):
    """Many equal rows, ties and gaps: nearest by rounded distance, then key; null distances last."""
    rng = np.random.default_rng(2)
    rows = [(int(i), int(rng.integers(4)), None if i % 17 == 3 else int(rng.integers(3)), None if i % 13 == 5 else "abc"[rng.integers(3)]) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, y int, z int, s string").repartition(3)
    got = sorted(tuple(r) for r in validity.gower_nearest(df, ["y", "z"], ["s"], F.col("row_id") % 5 == 0, block_rows=block_rows).collect())

    def distance(p, q):
        return None if None in (*p, *q) else round((abs(p[1] - q[1]) / 3 + abs(p[2] - q[2]) / 2 + (p[3] != q[3])) / 3, 6)

    want = []
    for p in rows[::5]:
        best = sorted(((distance(p, q) is None, distance(p, q) or 0.0, q[0]) for q in rows if q[0] != p[0]))[:3]
        want += [(p[0], o, None if gap else d, n + 1) for n, (gap, d, o) in enumerate(best)]
    assert got == sorted(want)


def test_parts_are_sent_once_to_each_group(spark):
    """However many parts there are, a part is sent to as many pairs as there are groups."""
    rows = spark.range(400).selectExpr("id AS row_id", "id * id % 97 AS a").repartition(4)
    packed = neighbours.blocks(rows, ["a"], "row_id", 2).withColumnRenamed("block", "part")
    sent = validity.paired(packed, 5, 2)
    assert packed.count() >= 200 and sent.count() == 5 * packed.count() and sent.select("i", "j").distinct().count() == 15


def test_vocabulary_by_count_then_name(spark):
    rows = spark.createDataFrame([(["b", "a", "a"],), (["a", "b", "c"],), (["d", "a", "c"],), (["d", "e"],), ([],)], "_t array<string>")
    assert topics.vocabulary(rows, 2, 0.6, 10) == ["a", "b", "c", "d"]
    assert topics.vocabulary(rows, 2, 0.5, 2) == ["b", "c"] and topics.vocabulary(rows, 1, 2, 10) == ["b", "c", "d", "e"]


def test_a_pass_measures_a_block_once_for_all_its_fits(monkeypatch):
    rng = np.random.default_rng(8)
    x, sizes = rng.normal(size=(501, 4)), [1, 2, 2, 5, 5, 5, 9]
    fits, seen = [rng.normal(size=(k, 4)) for k in sizes], []
    for some, near, label in resample._nearest_each(x, fits):
        want = [((x[:, None] - fits[n]) ** 2).sum(2) for n in some]
        assert (label == [w.argmin(1) for w in want]).all() and np.allclose(near, [w.min(1) for w in want])
        seen.append(some)
    assert seen == [[0], [1, 2], [3, 4, 5], [6]]
    tasks, passes = [(k, i) for i in (-1, 0) for k in (1, 3)], []

    def passed(points, size, shapes, add):
        total = [np.zeros(s) for s in shapes]
        add(total, np.arange(501, dtype=np.uint64), x)
        passes.append(total)
        return total, []

    calls, each = [], resample._nearest_each
    monkeypatch.setattr(resample, "_passed", passed)
    monkeypatch.setattr(resample, "seeded", lambda *a, **b: [fits[0], fits[3][:3]] * 2)
    monkeypatch.setattr(resample, "_nearest_each", lambda v, c: (calls.append(len(c)), each(v, c))[1])
    resample.many_kmeans(None, 4, tasks, lambda h, x, t: x, rounds=1, family=lambda t: 0, takes=lambda h, i: None if i < 0 else h % 2 == 0)
    assert calls == [4] and [t[:, 0].sum() for t in passes[0]] == [501, 501, 251, 251]
    label = ((x[:, None] - fits[3][:3]) ** 2).sum(2).argmin(1)
    assert np.allclose(passes[0][3][:, 2:], [x[::2][label[::2] == c].sum(0) for c in range(3)]) and np.allclose(passes[0][0][0, 1], ((x - fits[0]) ** 2).sum())
