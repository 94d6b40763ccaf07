"""The fingerprints, groups and tallies of the pipeline's near-dedup."""

from __future__ import annotations

import numpy as np

from cohortry.llm import near


def test_bits_are_counted():
    words = np.random.default_rng(1).integers(0, 1 << 63, (777, 2), dtype=np.uint64)
    for n in (0, 1, 2, 3, 5, 777):
        want = [int(((words[:n, w] >> np.uint64(b)) & np.uint64(1)).sum()) for w in range(2) for b in range(64)]
        assert near.bit_counts(words[:n]).tolist() == want


def test_fingerprint_is_the_majority_in_parts_too():
    hashes = np.random.default_rng(2).integers(0, 1 << 63, 1_301, dtype=np.uint64)
    assert (near.fingerprint(hashes) == near.fingerprint(hashes, at_once=100)).all()
    assert not near.fingerprint(hashes[:0]).any()


def test_pairs_at_the_bound_share_a_group_and_pass_the_tallies():
    rng, groups = np.random.default_rng(3), near.position_groups()
    assert (np.bincount(groups.ravel()) == 2).all()
    for n, both in ((50, 45), (90, 80), (400, 356)):
        for _ in range(100):
            all_ = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = near.fingerprint(all_[:n]), near.fingerprint(all_[n - both :])
            same = a.view(np.uint8) == b.view(np.uint8)
            assert same[groups].all(1).any() and int(a[0] ^ b[0]).bit_count() <= near.MOST_BITS
            assert same[: 8 * near.FIRST_WORDS].sum() >= near.least_shared(8 * near.FIRST_WORDS, 8) and same.sum() >= near.least_shared(8 * near.WORDS, 8)


def test_lists_hold_the_bytes_of_their_group(spark):
    fp = near.fingerprint(np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rows = spark.createDataFrame([(5, 59, fp.view(np.int64).tolist())], "mark long, n int, bytes array<long>")
    got = sorted(r.key for turn in range(near.TURNS) for r in near.listed(rows, turn).collect())
    at = fp.view(np.uint8).astype(int)
    assert got == sorted((g << 24) | at[x] | at[y] << 8 | at[z] << 16 for g, (x, y, z) in enumerate(near.position_groups().tolist()))


def test_mixed_lists_are_found_without_a_join(spark):
    rows = [(m, 60, 0, key, root) for key, roots in {1: [7] * 200, 2: [7] * 200 + [9], 3: [5, 6, 7]}.items() for m, root in enumerate(roots)]
    found = near.mixed(spark.createDataFrame(rows, "mark long, n int, word long, key long, root long").repartition(3))
    assert sorted(tuple(r) for r in found.collect()) == sorted(r for r in rows if r[3] > 1)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_verified_grow_as_the_documents_not_as_the_pairs_of_a_group(spark, monkeypatch):
    base = [f"w{i}" for i in range(150)]
    docs = spark.createDataFrame([(d, " ".join([*base[: 2 * d], f"x{d}", *base[2 * d + 1 :]])) for d in range(70)] + [(100, " ".join(f"y{i}" for i in range(90)))], "doc_id long, text string")
    seen, verified = [], near.verified
    monkeypatch.setattr(near, "verified", lambda docs, pairs, tenths: (seen.append(pairs.count()), verified(docs, pairs, tenths))[1])
    assert sorted(r.doc_id for r in near.keep_one(docs).collect()) == [0, 100]
    assert 69 <= sum(seen) <= 2 * 71


def test_each_pair_is_met_in_the_first_of_its_lists(spark):
    rng, groups = np.random.default_rng(5), near.position_groups()
    a, b = rng.integers(0, 2, (2, 40, near.WORDS * 8), dtype=np.uint8)  # bytes of two values, so that every eighth group is shared
    same = (a == b)[:, groups].all(2)
    at = rng.integers(0, len(groups), 40)
    at[:3] = 0, len(groups) - 1, same[2].argmax()
    rows = [(n, x.view(np.int64).tolist(), y.view(np.int64).tolist(), int(g)) for n, (x, y, g) in enumerate(zip(a, b, at, strict=True))]
    got = spark.createDataFrame(rows, "n int, a array<long>, b array<long>, g int").select("n", near.met_before(near.F.col("a"), near.F.col("b"), near.F.col("g")).alias("m")).collect()
    assert {r.n: r.m for r in got} == {n: bool(same[n, :g].any()) for n, g in enumerate(at)}
