"""Hard negatives against all pairs in plain integers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cohortry.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    clean = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            clean.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for k, (i, v, label) in enumerate(clean):
        if i % 50 == 0:
            scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for m, (j, w, other) in enumerate(clean) if m != k]
            for ps, j, _ in sorted(s for s in scored if s[2] == label)[:5]:
                inside = sorted(s for s in scored if s[2] != label and 50 * -ps <= 100 * -s[0] <= 95 * -ps)[:3]
                out += [(i, j, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(inside)]
    return sorted(out)


def as32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def made_rows(seed, n=700):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(37)] for _ in range(4)]
    rows = []
    for i in range(n):
        label = rng.choice([0, 0, 0, 1, 2, 9])
        rows.append((i, [as32(c + rng.gauss(0, 0.1)) for c in centres[label % 4]], label))
    rows += [(50, rows[50][1], rows[50][2]), (100, [as32(0.5)] * 37, 1), (150, [], 1), (200, [as32(0.1)] * 40, 2), (250, None, 1), (300, [1.0, None], 1), (350, [float("nan")] * 3, 1), (400, [float("inf")], 1), (450, [1.0], None), (None, [1.0], 1)]
    rows += [(1000 + 50 * k, rows[3][1], rows[3][2]) for k in range(6)] + [(2000 + k, rows[3][1], 5) for k in range(30)]
    return rows


@pytest.mark.parametrize(("seed", "chunk", "blocks"), [(1, 32, (256, 2048)), (2, 8, (3, 17))])
def test_negatives_are_those_of_all_pairs(spark, seed, chunk, blocks):
    rows = made_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS at", "2 AS block", "3 AS anchor").repartition(5)
    got = negatives.mine(df, chunk=chunk, blocks=blocks).collect()
    assert sorted(map(tuple, got)) == brute(rows) and len(got) > 100


def test_no_rows(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert negatives.mine(spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], SCHEMA)).collect() == []


def test_large_components_stay_exact(spark):
    rows = [(50, [2.0**17, -(2.0**17) + 0.125], 1), (1, [2.0**17, 1.0], 1), (2, [2.0**16, -3.0], 2), (3, [2.0**16 + 1, -5.5], 2)]
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows) and got


def test_no_tiles_are_shuffled(spark):
    """What cells leave is bounded by anchors and groups of rows, not by pairs of blocks; ties over many tiles stand as in all pairs."""
    rng = random.Random(5)
    rows = [(i, [as32(rng.choice([0.25, 0.5, 1.0])) for _ in range(6)], rng.choice([1, 2, 3])) for i in range(1_500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = negatives.mine(df, chunk=4, blocks=(4, 8))
    assert sorted(map(tuple, got.collect())) == brute(rows)
    candidates = negatives._positives(*[b.withColumn("wanted", F.lit(None).cast("binary")) for b in packed(df)], 5, 4)
    assert candidates.count() <= 30 * 5 and candidates.filter("place > 5").count() == 0


def packed(df):
    found = negatives.numbered(negatives._integers(df, True), ["label", "vec_id"], "test-rows")
    own = negatives.numbered(found.filter("vec_id % 50 = 0").withColumnRenamed("at", "row_at"), ["label", "vec_id", "row_at"], "test-anchors").withColumnRenamed("at", "anchor_at").withColumnRenamed("row_at", "at")
    return negatives._packed(own, "anchor_at", 4), negatives._packed(found, "at", 8)


def test_scores_of_all_kinds_compare():
    import numpy as np

    best, ids = negatives.Best(1, 2), np.arange(4)
    best.add(np.array([[2**60 + 1, 2**60, 5, 2**60]]), np.ones((1, 4), bool), ids, ids)
    best.add(np.array([[2.0**52, 7.0, 1.0, 0.0]]), np.ones((1, 4), bool), ids, ids)
    best.add(np.array([[9, 8, 7, 6]], np.float32), np.ones((1, 4), bool), ids, ids)
    assert best.entries[1:3].tolist() == [[2**60 + 1, 2**60], [0, 1]]
    assert negatives._share(np.array([7, -7, 2**58]), 95, True).tolist() == [math.ceil(6.65), math.ceil(-6.65), -(-(2**58) * 95 // 100)]
    assert negatives._share(np.array([7, -7, 2**58]), 50, False).tolist() == [3, -4, 2**57]
