"""Operators beside those of test_operators: ranks, quantiles, groups, backgrounds, records, verdicts, distributed fits."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.operators import associate, describe, features, measure, naming, order, resample, select, supervised, text, validity
from cohortry.sources import sinks, survey


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 0.4, (90, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    return spark.createDataFrame([(i, float(a), float(b), i // 90, "xyz"[i // 90], "uv"[i % 2]) for i, (a, b) in enumerate(x)], "row_id long, a double, b double, cluster int, kind string, other string").cache()


def test_ranks_and_quantiles(spark):
    rng = np.random.default_rng(1)
    values = [float(v) for v in np.exp(rng.normal(0, 3, 300)).round(1)] + [None, 0.0, 0.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id long, v double")
    got = {r.row_id: r.rank for r in order.average_ranks(df, "v", "rank").collect()}
    want = pd.Series(values, dtype=float).rank()
    assert got == {i: r for i, r in want.items() if not math.isnan(r)}
    few = {r.row_id: r.upto for r in df.join(order.running_counts(df, "v", cells=3), F.col("v") == F.col("value")).collect()}
    assert few == {i: (pd.Series(values) <= values[i]).sum() for i in got}
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    assert np.allclose(order.quantiles(df, "v", shares).first().edges, pd.Series(values, dtype=float).quantile(shares))
    assert order.quantiles(df.filter("v IS NULL"), "v", [0.5]).first().edges == [None]
    assert order.average_ranks(df.limit(0), "v", "rank").count() == 0
    assert features.quantile_cut(df.filter("v IS NULL"), "v", [0.5], ["lo", "hi"], "bin").first().bin is None


def test_values_are_dealt_within_groups(spark):
    df = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("v"), F.lit("k").alias("stays"))
    group = supervised.hash_groups(df, "row_id", 3, rows_per_group=10)
    assert df.select(group.alias("g")).agg(F.max("g")).first()[0] == 39
    rows = supervised.dealt(df, "v", group, "row_id", 5).collect()
    assert sorted(r.v for r in rows) == [2 * i for i in range(400)] and sum(r.v == 2 * r.row_id for r in rows) < 150


def test_themes_in_one_pass(spark):
    df = spark.createDataFrame([(1, "money and exams", "a"), (2, "money", "a"), (3, "nothing else here", "b"), (4, " ", "b"), (5, None, "a"), (6, "exam", None)], "row_id long, t string, g string")
    tagged = text.tag(df, "t", {"money": ("money",), "exams": ("exams?",)})
    assert {tuple(r) for r in text.prevalence(tagged).collect()} == {("money", 2, 50.0), ("exams", 2, 50.0)}
    assert {tuple(r) for r in text.theme_by_group(tagged, "g", 1).collect()} == {("a", "money", 2, 100.0), ("a", "exams", 2, 50.0)}
    assert {tuple(r) for r in text.paired_shift(tagged, text.tag(df.withColumn("t", F.lit("money")), "t", {"money": ("money",)})).collect()} == {("money", 4, 50.0, 100.0, 2, 0), ("exams", 4, 50.0, 0.0, 0, 2)}
    assert text.prevalence(tagged.limit(0)).count() == 0


def test_backgrounds(spark):
    df = spark.createDataFrame([(1, " Art ", "Yes / ja", "low "), (2, None, "no", None), (3, "x", None, "high")], "row_id long, dept string, late string, band string")
    made = features.build_background(df, ["dept"], {"late": "yes"}, {"band": ["low", "high"]})
    assert [tuple(r) for r in made.orderBy("row_id").collect()] == [(1, "Art", 1, "low", 1), (2, None, 0, None, None), (3, "x", 0, "high", 2)]
    with pytest.raises(Exception, match="band: no band: mid"):
        features.build_background(spark.createDataFrame([("mid",)], "band string"), [], {}, {"band": ["low", "high"]}).collect()


def test_decision_record(spark):
    ev = select.evidence_table(spark, [(2, 0.3, 1.0, 90.0, 10.0, 0.9, 0.5, 0.6, 0.2), (3, 0.4, 0.9, 95.0, 9.0, 0.8, 0.6, 0.7, 0.2), (4, 0.2, 1.2, 80.0, 11.0, 0.3, 0.4, 0.8, 0.1)])
    gap = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.4, 0.1), (3, 0.3, 0.1)], "k int, gap double, s double")
    curve = spark.createDataFrame([(2, 10.0), (3, 4.0), (4, 3.0)], "k int, sse double")
    got = select.decision_record(ev, select.screen_and_vote(ev), gap, curve)
    assert got["k"] == 3 and got["survivors"] == [2, 3] and got["screened_out"] == {4: "unstable"}
    assert got["picks"] == {"silhouette": 3, "davies_bouldin": 3, "calinski_harabasz": 3, "bic_gmm": 3, "bootstrap_ari": 2, "cross_algo_ari": 3, "differentiation": 4, "elbow": 3, "gap": 1}
    assert got["disagree"] == ["bootstrap_ari", "differentiation", "gap"] and got["weak_structure"] and got["framing"] == "segments of a continuum"
    assert [select.verdict(x) for x in (0.1, 0.3, 0.6, 0.8)] == ["no structure", "weak structure", "reasonable structure", "strong structure"]
    assert measure.verdict(0.75, 0.7) == "one scale; factorable" and measure.verdict(0.5, 0.4) == "no single scale; not factorable"


def test_fits_on_all_rows(groups):
    centres = resample.fit(groups, ["a", "b"], 3, starts=4)
    assert np.allclose(sorted(map(tuple, centres.round(0))), [(0, 0), (0, 4), (4, 0)]) and list(centres.mean(1)) == sorted(centres.mean(1), reverse=True)
    held = resample.holdout(groups.filter("row_id % 3 > 0"), groups.filter("row_id % 3 = 0"), ["a", "b"], centres, starts=4)
    assert held["ari_frozen_fresh"] == 1 and held["drift_ok"] and held["proportions_ok"] and held["silhouette_holdout"] > 0.8


def test_normalised_entropy(spark):
    sure = spark.createDataFrame([([1.0, 0.0],), ([0.5, 0.5],)], "p array<double>")
    assert validity.normalised_entropy(sure, "p").first()[0] == 0.5


def test_external_checks(groups):
    out = {r["variable"]: r for r in [{"variable": next(v for v in x.values() if v in ("kind", "other")), **x} for x in associate.classes_to_clusters(groups, "cluster", ["kind", "other"])]}
    assert out["kind"]["p"] < 1e-9 and out["other"]["p"] > 0.5
    eta = {r["item"]: r for r in associate.eta_with_p(groups, ["a", "b"])}
    assert eta["a"]["p"] < 1e-9 and eta["a"]["eta_squared"] > 0.9
    row = associate.welch(groups.withColumn("f", (F.col("cluster") == 1).cast("int")), "f", "a").first()
    assert row["mean1"] > 3.5 and associate.welch_p(row) < 1e-9


def test_supervised_sets(groups):
    df = groups.withColumn("noise", F.rand(3))
    assert supervised.cross_validate(df, ["a", "b"], "cluster", supervised.logistic(), 3, scaled=True)["accuracy"] > 0.95
    sets = supervised.feature_sets(df, {"a": ["a"], "a, b": ["a", "b"], "all": ["a", "b", "noise"]}, "cluster", n=2)
    assert [s["verdict"] for s in sets][:2] == ["adds", "adds"] and sets[2]["verdict"] != "adds" and sets[1]["lift"] > 0.5
    null = supervised.label_permutation(df, ["a", "b"], "cluster", 4)
    assert null["accuracy"] > 0.95 and null["null_mean"] < 0.6 and null["p"] == 0.2
    assert supervised.tree(impurity="entropy").getImpurity() == "entropy"


def test_loadings_cards_and_tables(spark, groups, tmp_path):
    assert measure.salient(np.array([[0.8, 0.1], [-0.5, 0.4]]), ["p", "q"]) == [{"plus": ["p"], "minus": ["q"]}, {"plus": ["q"], "minus": []}]
    r = measure.project(groups, ["a", "b"], np.eye(2)[:, ::-1]).filter("row_id = 0").first()
    assert (r.pc1, r.pc2) == (r.b, r.a)
    cards = naming.cards(spark.createDataFrame([(0, "n"), (1, "m")], "cluster int, persona string"), spark.createDataFrame([(1, "do")], "cluster int, advice string"))
    assert {tuple(r) for r in cards.collect()} == {(0, "n", None), (1, "m", "do")}
    one = spark.createDataFrame([(3, 0.5)], "n long, share double")
    assert {tuple(r) for r in describe.quality_table(one, spark.createDataFrame([(7,)], "runs int")).collect()} == {("n", "3"), ("share", "0.5"), ("runs", "7")}
    assert sinks.rules_text([{"rule": "a <= 1", "label": 0.0, "n": 3, "purity_pct": 100.0}, {"rule": "a > 1", "label": 1.0, "n": 9, "purity_pct": 66.6667}]) == "a > 1 => 1 (n=9, purity 66.7 %)\na <= 1 => 0 (n=3, purity 100.0 %)\n"
    sinks.save_table(one, str(tmp_path / "t"))
    assert (tmp_path / "t").read_bytes() == b"\xef\xbb\xbfn,share\n3,0.5\n"
    assert survey.sheet(spark, pd.DataFrame({"x": ["1", None], "y": [float("nan"), 2]}, dtype=object)).collect() == [("1", None), (None, "2")]
