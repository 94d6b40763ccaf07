"""Operators on small frames: goldens, properties, schema checks, sinks, scoring and streaming."""

import csv
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import associate, describe, features, measure, naming, select, stability, supervised, text, topics, validity
from cohortry.operators.cluster import indices
from cohortry.operators.fanout import block, run_tasks
from cohortry.plans import catalogue, segmentation
from cohortry.sources import sinks, survey
from cohortry.streaming import score as scoring

ITEMS = [f"q{i}" for i in range(6)]


@pytest.fixture(scope="module")
def answers(spark):
    rng = np.random.default_rng(4)
    level = rng.integers(0, 3, 240)
    rows = [(i, *[int(np.clip(1 + 2 * level[i] * (j < 3) + 2 * (2 - level[i]) * (j >= 3) + rng.integers(0, 2), 1, 5)) for j in range(6)], "ab"[i % 2], int(level[i])) for i in range(240)]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{q} int" for q in ITEMS) + ", grp string, cluster int").cache()


#: Published evidence per k (in the order of select.EVIDENCE) and a published gap curve.
EVIDENCE = [(2, 0.1682, 2.0890, 142.0799, 11690.7602, 0.8659, 0.3641, 0.4067, 0.4333), (3, 0.1390, 1.9708, 120.7618, 11748.5476, 0.8114, 0.3392, 0.5992, 0.2478), (4, 0.1338, 1.8361, 106.9322, 8968.6794, 0.5843, 0.1839, 0.6812, 0.1754), (5, 0.1315, 1.8338, 100.0347, 10312.6403, 0.4833, 0.1999, 0.6528, 0.1391), (6, 0.1369, 1.7270, 95.4536, 9193.7936, 0.5605, 0.2066, 0.6680, 0.1246), (7, 0.1412, 1.6338, 92.2068, 8052.2096, 0.6407, 0.1971, 0.6902, 0.1159), (8, 0.1400, 1.5708, 88.7523, 7192.1438, 0.6508, 0.1833, 0.7055, 0.1014)]
GAPS = [(1, 1.345825, 0.012470), (2, 1.339336, 0.013495), (3, 1.320001, 0.014258), (4, 1.311313, 0.014642), (5, 1.312535, 0.013433), (6, 1.312995, 0.011866), (7, 1.326548, 0.014543), (8, 1.330037, 0.015978)]


def test_vote_matches_the_published_decision(spark):
    got = {r.k: r for r in select.screen_and_vote(select.evidence_table(spark, EVIDENCE)).collect()}
    assert [k for k, r in got.items() if r.chosen] == [3]
    assert {k: round(r.mean_rank, 6) for k, r in got.items() if r.mean_rank} == {3: 1.857143, 4: 2.0, 6: 2.142857}
    assert {k: r.reasons for k, r in got.items() if r.reasons} == {2: "level only", 5: "unstable", 7: "above cap", 8: "above cap"}
    assert select.one_se_rule(spark.createDataFrame(GAPS, "k int, gap double, s double")).first()[0] == 1
    assert tuple(select.runner_up(select.screen_and_vote(select.evidence_table(spark, EVIDENCE))).first()) == (4, 0.142857)
    worst = [(*r[:5], 0.1, *r[6:]) for r in EVIDENCE]  # nobody survives: the smallest k
    assert [r.k for r in select.screen_and_vote(select.evidence_table(spark, worst)).collect() if r.chosen] == [2]
    both = select.evidence_table(spark, EVIDENCE)
    spaces = both.withColumn("space", F.lit("x")).unionByName(both.withColumn("differentiation", F.col("differentiation") + 0.01).withColumn("space", F.lit("y")))
    assert [r.space for r in select.choose_space(spaces).collect() if r.chosen] == ["y"]


def test_measures(answers):
    x = np.array([r[1:7] for r in answers.orderBy("row_id").collect()], float)
    report = measure.measurement_report(answers, ITEMS)
    k = 6
    assert report["alpha"] == pytest.approx(k / (k - 1) * (1 - x.var(0, ddof=1).sum() / x.sum(1).var(ddof=1)))
    assert answers.agg(measure.alpha_expression(ITEMS)).first()[0] == pytest.approx(report["alpha"])
    assert answers.select(*[(F.col(c) + 7).alias(c) for c in ITEMS]).agg(measure.alpha_expression(ITEMS)).first()[0] == pytest.approx(report["alpha"])  # shifts do not matter
    assert np.allclose(report["correlation"], np.corrcoef(x, rowvar=False))
    assert answers.agg(measure.alpha_expression(["q0"])).first()[0] is None


def test_validity_agrees_with_numpy(answers):
    x = np.array([r[1:7] for r in answers.orderBy("row_id").collect()], float)
    want = indices(x, np.array([r.cluster for r in answers.orderBy("row_id").collect()]))
    rows = {r.cluster: r for r in validity.silhouette(answers, ITEMS).collect()}
    assert rows["ALL"].silhouette == pytest.approx(want["silhouette"], abs=1e-6)
    assert validity.davies_bouldin(answers, ITEMS).first().davies_bouldin == pytest.approx(want["davies_bouldin"], abs=1e-6)
    assert validity.calinski_harabasz(answers, ITEMS).first().calinski_harabasz == pytest.approx(want["calinski_harabasz"], abs=1e-5)
    d = validity.differentiation(answers, ITEMS).first()
    assert d.differentiation == pytest.approx(want["differentiation"], abs=1e-6) and d.ss_level + d.ss_shape == pytest.approx(want["between_ss"], abs=1e-5) and 0 <= d.differentiation <= 1
    assert validity.silhouette(answers, ITEMS, block_rows=50).filter("cluster = 'ALL'").first().silhouette == pytest.approx(want["silhouette"], abs=1e-6)


def test_average_ranks_and_modal(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "z"), (2, "a")], "g int, v string")
    assert {r.g: r.modal_v for r in describe.modal(df, "g", "v").collect()} == {1: "y", 2: "a"}
    r = associate.correlation(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (2.0, 3.0), (4.0, 9.0)], "a double, b double"), "a", "b", ranks=True)
    assert r["r"] == pytest.approx(0.8333333) and 0 < r["p"] < 1


def test_holdout_is_exact_and_stable(answers):
    a = features.split_holdout(answers, "grp").groupBy("grp", "split").count().collect()
    assert {(r.grp, r.split): r["count"] for r in a} == {("a", "holdout"): 36, ("a", "train"): 84, ("b", "holdout"): 36, ("b", "train"): 84}
    pick = lambda d: {r.row_id for r in features.split_holdout(d, "grp").filter("split = 'holdout'").collect()}
    assert pick(answers) == pick(answers.repartition(7))


def test_encoding_and_spaces(answers):
    assert features.encode_background(answers, ["grp"], ["cluster"], exclude=("clus",)).columns == ["row_id", "grp_a", "grp_b"]
    spaces = features.feature_spaces(answers, ITEMS, {"two": {"u": ITEMS[:3], "v": ITEMS[3:]}}, "cluster")
    assert {k: c for k, (_, c) in spaces.items()} == {"items": ITEMS, "two": ["u", "v"], "two+cluster": ["u", "v", "cluster"]}
    m, s = spaces["two"][0].agg(F.avg("u"), F.stddev_pop("u")).first()
    assert abs(m) < 1e-9 and s == pytest.approx(1)
    with pytest.raises(ValueError, match="no item"):
        features.assign_subscales(np.array([[1, 0], [1, 0]]), ["a", "b"], ["x", "y"])
    assert features.assign_subscales(np.array([[1, 0], [0, 1], [1, 0]]), list("abc"), ["x", "y"], alone="c") == {"x": ["a"], "y": ["b"], "c": ["c"]}


def test_schema_and_sources(spark, tmp_path):
    spec = survey.SurveySpec(("year", "a", "note"), {0: "year", 1: "item"}, items=("a",), texts=("note",))
    path = tmp_path / "s.csv"
    path.write_text('﻿Which year,Item one,Note\n1st,4,"two\nlines"\n2nd,x,\n', encoding="utf-8")
    df = survey.read_survey(spark, str(path), spec)
    assert [tuple(r) for r in df.collect()] == [("1st", 4, "two\nlines"), ("2nd", None, None)]
    assert survey.clean_export(df, spec).collect()[1].note == ""
    with pytest.raises(ValueError, match="columns"):
        survey.validate_schema(df.drop("note"), spec)
    with pytest.raises(ValueError, match="keyword"):
        survey.validate_schema(df.select("a", "year", "note"), spec)
    assert survey.resolve_path(folders=(str(tmp_path),)) == str(path)
    with pytest.raises(FileNotFoundError):
        survey.resolve_path(folders=(str(tmp_path / "none"),))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1.5, "it's", "a\nb", 9), (None, None, None, 9)], "x double, n string, t string, skipped int")
    sinks.write_arff(df, str(tmp_path / "a"), "my data", ["x"], {"n": ["it's"]}, ["t"])
    lines = (tmp_path / "a").read_text().splitlines()
    at = lines.index("@data")
    assert lines[0] == "@relation 'my data'" and lines[3] == "@attribute n {'it\\'s'}" and set(lines[at + 1 :]) == {"1.5,'it\\'s','a b'", "?,?,?"}
    sinks.save_json({"a": np.float64("nan"), "b": np.arange(2)}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": None, "b": [0, 1]}
    sinks.save_table(df.select("x"), str(tmp_path / "t"))
    assert list(csv.reader((tmp_path / "t").open(encoding="utf-8-sig")))[0] == ["x"]
    assert "## k" in sinks.summary({"k": {"a": 1}})


def test_response_style(spark):
    rows = [tuple([3] * 12), (1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 1, 2), (1, *[5] * 8, 1, 2, 3)]
    cols = [f"i{j}" for j in range(12)]
    r = describe.response_style(spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols)), cols).first()
    assert (r.n_straight, r.n_flat, r.longest_run, r.n_long_runs) == (1, 1, 12, 2) and r.pct_all_points == pytest.approx(100 / 3, abs=1e-4)


def test_themes(spark):
    texts = ["Too many deadlines, no sleep", "labé exams.", "examsx", None, "  ", "PRÜFUNG!", "n/a", "bus\nsleep"]
    t = text.tag(spark.createDataFrame(list(enumerate(texts)), "row_id long, text string"), "text")
    got = [r.themes for r in t.orderBy("row_id").collect()]
    assert got == [["workload", "sleep"], ["exams"], [], [], [], ["exams"], [], ["sleep", "travel"]]
    assert text.coverage(t).first().n_answered == 6 and text.untagged(t, "text").count() == 2
    assert text.fingerprint(text.THEMES) == text.fingerprint(dict(text.THEMES)) != text.fingerprint({"a": ("b",)})
    from cohortry.functions.expressions import non_answer

    assert [r[0] for r in t.orderBy("row_id").select(F.coalesce(non_answer(F.col("text")), F.lit(False))).collect()] == [False] * 6 + [True, False]
    hits = text.probes(t, "text", {"p": r"(?i)no (?!sleep)", "q": "sleep"}).orderBy("row_id").collect()
    assert (hits[0].p, hits[0].q) == (0, 1)
    assert text.patterns_table(spark, text.THEMES).count() == len(text.THEMES)
    assert associate.mcnemar(1, 9) == pytest.approx(0.021484375)


def test_theme_tests(spark):
    rows = [(i, "exam" if i % 2 else "rent", "u" if i % 2 else "v") for i in range(60)]
    t = text.tag(spark.createDataFrame(rows, "row_id long, text string, g string"), "text")
    got = {r["theme"]: r for r in text.theme_tests(t, "g", ["exams", "money", "sleep"])}
    assert set(got) == {"exams", "money"} and got["exams"]["significant"] and got["exams"]["peak"] == "u"


def test_names_and_advice(spark):
    #: Published standardised profiles.
    z = {0: (0.26, 0.46, 0.17, 0.47, 0.67, -0.70), 1: (0.18, 0.12, 0.46, -0.38, -0.12, 0.68), 2: (-0.65, -0.84, -0.94, -0.10, -0.78, -0.02)}
    dims = ["Evaluation", "Workload", "FutureMacro", "SupportGap", "Financial", "CGPA"]
    prof = spark.createDataFrame([(c, d, v) for c, vs in z.items() for d, v in zip(dims, vs, strict=True)], "cluster int, item string, z double")
    named = {r.cluster: r.defining for r in naming.persona_names(prof, {d: (f"low {d}", f"high {d}") for d in dims}).collect()}
    assert named == {0: "CGPA low, Financial high, SupportGap high", 1: "CGPA high, FutureMacro high, SupportGap low", 2: "FutureMacro low, Workload low, Financial low"}
    twice = naming.persona_names(prof, {"Workload": ("a", "a")}, least=0.4)
    assert sorted(r.persona for r in twice.collect()) == ["Average profile", "a", "a (2)"]
    advice = {r.cluster: r.advice for r in naming.recommendations(prof, [("Financial", "high", "aid"), ("CGPA", "high", "stretch")]).collect()}
    assert advice == {0: "aid", 1: "stretch", 2: "monitor"}
    ranks = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "cluster int, strain_rank int")
    assert {r.cluster: r.persona for r in naming.ranked_names(prof, {d: d for d in dims}, ranks).collect()}[0] == "P1: Financial + SupportGap, low CGPA"


def test_fits_as_tasks(spark, answers):
    _, z = block(answers, ITEMS)
    matrix = stability.consensus(spark, z, 3, 5)
    assert matrix.filter("i = j AND rate <> 1").count() == 0 and matrix.filter("rate < 0 OR rate > 1").count() == 0
    _, keys = block(answers, ["cluster"])
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(keys[:, 0])], "row int, cluster int")
    assert all(r.consensus > 0.7 for r in stability.consensus_by_cluster(matrix, labels).collect())
    failed = run_tasks(spark, __import__("pandas").DataFrame({"id": [0, 1]}), lambda t, z: [{"id": 1 // t["id"]}], z, "id int").collect()
    assert [(r.id, bool(r.error)) for r in sorted(failed, key=lambda r: r.id)] == [(0, True), (1, False)]
    horn = stability.parallel_analysis(spark, 240, 6, [4.0, 1.0, 0.4, 0.3, 0.2, 0.1], 20).orderBy("pc").collect()
    assert [r.retain for r in horn] == [True, False, False, False, False, False]


def test_supervised(answers):
    rules = supervised.tree_rules(answers, ITEMS, "cluster")
    assert sum(r["n"] for r in rules) == 240 and min(r["purity_pct"] for r in rules) > 60
    cv = supervised.cross_validate(answers, ITEMS, "cluster", n=3)
    assert cv["accuracy"] > 0.9 and cv["macro_f1"] > 0.9
    assert supervised.baseline(answers, "cluster").first().share < 0.5
    noisy = answers.withColumn("noise", F.rand(1))
    imp = supervised.permutation_importance(noisy, ["noise", *ITEMS[:2]], "cluster", 2, trees=20)
    assert imp[-1]["feature"] == "noise"


def test_topics(spark):
    rows = [(i, "apple banana apple fruit" if i % 2 else "engine wheel engine motor") for i in range(40)] + [(99, "zzz")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    counted, terms = topics.term_counts(df, "text", least=4, most=0.9, pairs=False)
    weights = topics.tfidf(counted, terms).cache()
    assert weights.groupBy("row_id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).filter(F.abs(F.col("n") - 1) > 1e-9).count() == 0
    found = topics.nmf(weights, len(terms), 2, 15, top=2, terms=terms)
    assert {frozenset(t["terms"]) for t in found} == {frozenset({"apple", "banana"}), frozenset({"engine", "wheel"})} or {t["terms"][0] for t in found} == {"apple", "engine"}
    assert topics.empty_rate(df, weights, F.lit("latin")).first().pct_empty == pytest.approx(100 / 41, abs=1e-5)
    assert len(topics.lda(counted, terms, 2, 3)[0]) == 2


@pytest.fixture(scope="module")
def bundle():
    return scoring.Bundle(["q0", "q1"], ["q1"], {"s": ["q0", "q1"]}, {"s": 3.0, "band": 1.5}, {"s": 1.0, "band": 0.5}, [[1.0, 0.0], [-1.0, 0.0]], ["up", "down"], "band", ["lo", "hi"])


def test_scoring(spark, bundle, tmp_path):
    df = spark.createDataFrame([(5, 1, "hi"), (1, 5, "lo")], "q0 int, q1 int, band string")
    got = scoring.score(df, bundle).collect()
    assert [(r.cluster, r.persona) for r in got] == [(0, "up"), (1, "down")] and got[0].distance_to_own_centroid == pytest.approx(math.sqrt(2), abs=1e-3)
    bundle.save(spark, str(tmp_path / "b"))
    assert scoring.Bundle.load(spark, str(tmp_path / "b")) == bundle
    with pytest.raises(ValueError, match="missing"):
        scoring.score(df.drop("q1"), bundle)
    for bad in ((6, 1, "hi"), (None, 1, "hi"), (5, 1, "??"), (5, 1, None)):
        with pytest.raises(Exception, match="no answer|unknown band"):
            scoring.score(spark.createDataFrame([bad], "q0 int, q1 int, band string"), bundle).collect()


def test_streams(spark, bundle, tmp_path):
    spark.createDataFrame([(5, 1, "hi", "2024-01-01 10:00:00"), (1, None, "lo", "2024-01-02 10:00:00"), (9, 5, "lo", "2024-01-02 11:00:00")], "q0 int, q1 int, band string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("q0 int, q1 int, band string, ts timestamp").parquet(str(tmp_path / "in"))
    q = scoring.profile_only(stream.filter("q1 = 1"), bundle).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert [r.persona for r in spark.table("scored").collect()] == ["up"]
    q = scoring.audit_stream(stream, "ts", ["q0", "q1"]).writeStream.outputMode("complete").format("memory").queryName("audited").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.nulls, r.out_of_range) for r in spark.table("audited").orderBy("day").collect()] == [(1, 0, 0), (2, 1, 1)]


def test_whole_run(spark, answers, tmp_path):
    fast = segmentation.Settings(ks=range(2, 4), starts=2, resamples=3, references=2, simulations=10, seeds=2, algorithms=("kmeans", "gmm_full"), secondary_k=4)
    themes = answers.select("row_id", F.array(F.lit("t"), F.concat(F.lit("u"), F.col("grp"))).alias("themes"))
    run = segmentation.run(answers.drop("cluster"), ITEMS, ["q3"], ["grp"], fast, themes=themes)
    cards = run.tables["cards"].collect()
    assert len(cards) == run.facts["k"] and all(r.modal_grp is not None and 0 < r.pct_modal_grp <= 100 and r.themes.startswith("t") and r.advice for r in cards)
    assert run.facts["secondary"]["k"] == 4 and run.facts["secondary"]["ari"] <= 1 and run.tables["secondary_personas"].count() == 4
    assert run.labelled.count() == 240 and run.facts["k"] in (2, 3)
    # scoring the stored rows again gives the stored persona
    stored = {r.row_id: r.persona for r in run.labelled.collect()}
    assert stored == {r.row_id: r.persona for r in scoring.score(answers, run.bundle).collect()}
    assert set(stored.values()) <= set(run.bundle.names)
    segmentation.persist(run, answers, str(tmp_path / "out"))
    kept = spark.read.parquet(str(tmp_path / "out/assignments"))
    assert kept.count() == 240 and {"cluster", "persona", "split", "distance_to_own_centroid", "silhouette"} <= set(kept.columns)
    assert kept.filter("silhouette < 0 or silhouette > 1").count() == 0 and "=>" in spark.read.text(str(tmp_path / "out/rules"), wholetext=True).first()[0]
    assert scoring.Bundle.load(spark, str(tmp_path / "out/scorer")) == run.bundle
    assert json.loads(spark.read.text(str(tmp_path / "out/results")).first()[0])["k"] == run.facts["k"]


def test_random_eigenvalues_follow_the_true_size(spark, monkeypatch):
    from cohortry.operators import measure
    from cohortry.plans import catalogue

    for n in (60, 400):
        drawn = np.mean([np.linalg.eigvalsh(np.corrcoef(np.random.default_rng([7, i]).normal(size=(n, 12)), rowvar=False))[::-1] for i in range(300)], axis=0)
        assert np.allclose(np.mean([measure.parallel_eigenvalues(n, 12, i) for i in range(300)], axis=0), drawn, atol=0.03)
    assert measure.parallel_eigenvalues(10**9, 12, 1)[0] < 1.001
    assert abs(measure.parallel_eigenvalues(5, 12, 1).sum() - 12) < 1e-6
    asked = []
    monkeypatch.setattr(stability, "parallel_analysis", lambda *a: asked.append(a))
    monkeypatch.setattr(measure, "covariance", lambda *a: (np.eye(12), 150_000))
    monkeypatch.setattr(catalogue, "aligned", lambda *a: None)
    catalogue.QUERIES["parallel_analysis"](spark, "")
    assert asked[0][1] == 150_000 and len(asked[0]) == 4  # all rows, and the default of 500 simulations


def test_fits_take_all_dimensions_and_terms(spark, monkeypatch):
    from cohortry.operators import resample, topics
    from cohortry.plans import catalogue

    frame, asked = spark.range(1).withColumnRenamed("id", "row_id"), {}
    cols = [f"x{i}" for i in range(64)]
    monkeypatch.setattr(catalogue, "vectors", lambda *a: (frame.select("row_id", *[F.lit(0.0).alias(c) for c in cols]), cols))
    monkeypatch.setattr(resample, "fit", lambda df, cols, *a: (asked.update(kmeans=(len(cols), *a)), np.zeros((3, 64)))[1])
    catalogue.QUERIES["kmeans_k3"](spark, "")
    assert asked["kmeans"] == (64, 3, 25)
    monkeypatch.setattr(catalogue, "read", lambda *a: frame.withColumnRenamed("row_id", "doc_id"))
    monkeypatch.setattr(topics, "term_counts", lambda df, col, **a: (asked.update(terms=a), (df, ["a"]))[1])
    monkeypatch.setattr(topics, "lda", lambda counted, terms, *a: (asked.update(lda=a), ([{"topic": 0, "terms": ["a"]}], 0.0))[1])
    catalogue.QUERIES["lda_topics"](spark, "")
    assert asked["terms"] == {} and asked["lda"] == ()  # the operators' defaults: 1,500 words and pairs, 6 topics, 20 rounds


def test_resampling_of_whole_tables(spark):
    from cohortry.operators import resample

    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.3, (120, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 4, 4))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double, c double").repartition(3)
    cols = ["a", "b", "c"]
    points = resample._points(df, cols, "row_id")
    centres, inertia, rested = resample.many_kmeans(points, 3, [(3, 0)], lambda h, v, t: v)
    assert rested == [True]
    want = sum(((x[i : i + 120] - x[i : i + 120].mean(0)) ** 2).sum() for i in (0, 120, 240))
    assert abs(inertia[0] - want) < 1e-6 * want
    boot = {r.k: r for r in resample.bootstrap(df, cols, [2, 3], 8).collect()}
    assert boot[3].n == 8 and boot[3].unrested == 0 and boot[3].mean_ari > 0.99 and boot[3].above_75 == 1
    curve = {r.k: r.gap for r in resample.gap(df, cols, range(1, 5), 5).collect()}
    assert max(curve, key=curve.get) == 3


def test_exact_pairs_in_blocks(spark):
    from cohortry.operators import validity

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, i % 3, float(rng.normal(i % 3)), float(rng.normal())) for i in range(60)], "row_id long, cluster int, a double, b double")
    rows = lambda n: sorted(tuple(r) for r in validity.silhouette_rows(df, ["a", "b"], block_rows=n).collect())
    assert np.allclose(np.array(rows(7), float), np.array(rows(1000), float))
    near = lambda n: sorted(tuple(r) for r in validity.gower_nearest(df, ["a", "b"], ["cluster"], F.col("row_id") % 2 == 0, block_rows=n).collect())
    assert near(4) == near(1000) and len(near(4)) == 90
