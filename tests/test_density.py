"""Density clusters against a plain single-linkage hierarchy of all pairs."""

import numpy as np
import pytest

from cohortry.operators import associate, density, stability


def moons(n=40, seed=8):
    rng = np.random.default_rng(seed)
    t = rng.uniform(0, np.pi, n)
    x = np.vstack([np.column_stack([np.cos(t), np.sin(t)]), np.column_stack([1 - np.cos(t), 0.4 - np.sin(t)]) + [0, -0.6], rng.normal([4, 3], 0.15, (n // 2, 2))])
    return np.vstack([x + rng.normal(0, 0.07, x.shape), rng.uniform(-3, 6, (25, 2))])


def plain(x, least, samples):
    """Labels from the full tree: merges of all pairs in order, condensed from the top, by excess of mass."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    core = np.sort(d, 1)[:, samples]
    w = np.maximum(np.maximum(core[:, None], core), d)
    order = sorted((w[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    root, node, children, height, size = list(range(n)), list(range(n)), {}, {}, {i: 1 for i in range(n)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for v, i, j in order:
        a, b = find(i), find(j)
        if a != b:
            new = n + len(children)
            children[new], height[new], size[new] = (node[a], node[b]), v, size[node[a]] + size[node[b]]
            root[b], node[a] = a, new

    def points(t):
        return [t] if t < n else points(children[t][0]) + points(children[t][1])

    birth, falls, parts, owner, stack, made = {0: 0.0}, {0: []}, {0: []}, {}, [(n + len(children) - 1, 0)], 1
    while stack:
        t, c = stack.pop()
        if t < n:
            continue
        lam = 1 / height[t]
        big = [s for s in children[t] if size[s] >= least]
        for s in children[t]:
            if s not in big:
                falls[c] += [(p, lam) for p in points(s)]
        if len(big) == 2:
            for s in big:
                birth[made], falls[made], parts[made] = lam, [], []
                parts[c].append((made, size[s]))
                stack.append((s, made))
                made += 1
        elif big:
            stack.append((big[0], c))
    best, kept = {}, {}
    for c in reversed(range(made)):
        mass = sum(lam - birth[c] for _, lam in falls[c]) + sum(k * (birth[s] - birth[c]) for s, k in parts[c])
        below = sum(best[s] for s, _ in parts[c])
        kept[c] = c != 0 and (not parts[c] or mass >= below)
        best[c] = mass if kept[c] else below
    labels = np.full(n, -1)

    def mark(c, own):
        own = c if own is None and kept[c] else own
        for p, _ in falls[c]:
            if own is not None:
                labels[p] = own
        for s, _ in parts[c]:
            mark(s, own)

    mark(0, None)
    return labels


@pytest.mark.parametrize(("seed", "least"), [(8, 8)])
def test_labels_are_those_of_the_full_tree(spark, seed, least):
    x = moons(seed=seed)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "row_id long, a double, b double").repartition(3)
    got = {r.row_id: r for r in density.density_clusters(df, ["a", "b"], least, 4, neighbours=len(x) - 1).collect()}
    want = plain(x, least, 4)
    mine = np.array([got[i].cluster for i in range(len(x))])
    assert len(got) == len(x) and ((mine == -1) == (want == -1)).all()
    assert associate.ari_of_table(stability.contingency(mine, want)) == 1 and len(set(want)) >= 3
    sizes = np.bincount(mine[mine >= 0])
    assert list(sizes) == sorted(sizes, reverse=True)


def test_groups_that_never_meet_and_rows_that_reach_none(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 40), rng.normal(1000, 1, 40), [5000.0, 5001.0]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "row_id long, a double")
    got = {r.row_id: r for r in density.density_clusters(df, ["a"], least=20, samples=2, neighbours=3).collect()}
    assert {got[i].cluster for i in range(40)} | {got[i].cluster for i in range(40, 80)} <= {0, 1, -1} and got[80].cluster == got[81].cluster == -1
    few = density.density_clusters(df.filter("row_id < 5"), ["a"], least=20, samples=2, neighbours=3).collect()
    assert {r.cluster for r in few} == {-1} and len(few) == 5
