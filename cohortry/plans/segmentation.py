"""A whole segmentation run: survey in, tables, labels and a scorer out."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.expressions import total
from cohortry.operators import associate, describe, features, measure, naming, resample, select, stability, supervised
from cohortry.operators import sweep as sweeps
from cohortry.sources import sinks
from cohortry.streaming.score import Bundle, score


@dataclass
class Settings:
    """Effort of the resampling steps. Spaces and k are selected on all training rows; the final model is fitted on them and labels all rows.

    ``secondary_k``: a second number of segments to report beside the chosen one."""

    ks: range = range(2, 9)
    cap: int = 6
    starts: int = 25
    resamples: int = 200
    references: int = 50
    simulations: int = 500
    seeds: int = 20
    algorithms: tuple[str, ...] = sweeps.ALGORITHMS
    holdout: float = 0.30
    fit_scope: str = "all"
    seed: int = 42
    k: int | None = None
    secondary_k: int | None = None
    least_eta: float = 0.01


FAST = Settings(starts=5, resamples=10, references=5, simulations=50, seeds=4)


@dataclass
class Run:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    facts: dict[str, object] = field(default_factory=dict)
    labelled: DataFrame | None = None
    bundle: Bundle | None = None


def evidence(train: DataFrame, cols: list[str], s: Settings) -> tuple[DataFrame, DataFrame]:
    """Evidence per k for one space from all training rows, and the sweep that it comes from."""
    swept, pairs = sweeps.swept(train, cols, s.ks, s.algorithms, seed=s.seed, starts=min(10, s.starts))
    boot = resample.bootstrap(train, cols, s.ks, s.resamples, seed=s.seed).select("k", F.col("mean_ari").alias("bootstrap_ari"))
    cross = pairs.groupBy("k").agg(F.avg("ari").alias("cross_algo_ari"))
    km = swept.filter("algorithm = 'kmeans'").select("k", "silhouette", "davies_bouldin", "calinski_harabasz", "differentiation", "min_size_frac", "min_size", "inertia")
    bic = swept.filter("algorithm = 'gmm_full'").select("k", F.col("bic").alias("bic_gmm"), F.col("entropy").alias("entropy_gmm"))
    both = km.join(bic, "k", "left").join(boot, "k").join(cross, "k", "left").withColumn("cross_algo_ari", F.coalesce("cross_algo_ari", F.lit(0.0)))
    return both.select("k", *select.CRITERIA, "min_size_frac", "entropy_gmm", "min_size", "inertia"), swept


@dataclass
class Space:
    """A standardised space: its columns (the subscales, or the items where there are none) and rows with their split."""

    scales: dict[str, list[str]]
    cols: list[str]
    means: dict[str, float]
    sds: dict[str, float]
    z: DataFrame

    @property
    def train(self) -> DataFrame:
        return self.z.filter("split = 'train'").select("row_id", *self.cols)


def space(split: DataFrame, items: list[str], scales: dict[str, list[str]], s: Settings) -> Space:
    cols = list(scales) or items
    scored = features.subscales(split, scales) if scales else split
    scope = scored if s.fit_scope == "all" else scored.filter("split = 'train'")
    stats = scope.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    means, sds = dict(zip(cols, stats[: len(cols)], strict=True)), dict(zip(cols, stats[len(cols) :], strict=True))
    z = scored.withColumns({c: (F.col(c) - means[c]) / (sds[c] or 1.0) for c in cols})
    return Space(scales, cols, means, sds, z)


def named_profiles(survey: DataFrame, bundle: Bundle, z: DataFrame, least_eta: float) -> tuple[DataFrame, DataFrame]:
    """Standardised profiles of the scored rows, and names from the dimensions whose eta squared is at least ``least_eta``."""
    cols = bundle.columns
    rows = score(survey, bundle).select("row_id", "cluster").join(z.select("row_id", *cols), "row_id")
    strong = [r["item"] for r in associate.eta_squared(rows, cols).collect() if (r["eta_squared"] or 0) >= least_eta]  # one row per column
    profiles = describe.z_profile(rows, cols)
    return profiles, naming.persona_names(profiles, {c: (f"low {c}", f"high {c}") for c in cols}, strong)


def run(
    survey: DataFrame, items: list[str], reversed_items: list[str], background: list[str], settings: Settings | None = None, scales: dict[str, list[str]] | None = None, facets: dict[str, str] | None = None,
    spaces: dict[str, dict[str, list[str]]] | None = None, advice: list[tuple[str, str, str]] | None = None, themes: DataFrame | None = None,
) -> Run:
    """survey: row_id, items as answered, background. Subscales are the factors unless given.

    ``spaces``: further sets of subscales by name (an empty one stands for the items); the space is chosen among them and the
    given or found subscales (``main``). ``advice``: rules of :func:`naming.recommendations`. ``themes``: row_id and an array of the
    themes in what a row wrote, whose three commonest stand on the cluster's card.
    """
    s, out, spark = settings or Settings(), Run(), survey.sparkSession
    rows = features.align(survey, reversed_items).cache()
    out.tables["response_style"] = describe.response_style(survey, items)
    out.tables["item_descriptives"] = describe.item_descriptives(survey, items)
    out.tables["standardisation"] = describe.standardisation_evidence(rows, items)
    report = measure.measurement_report(rows, items)
    r = report.pop("correlation")
    out.facts["measurement"] = report
    out.facts["pca"] = measure.pca(r)
    parallel = stability.parallel_analysis(spark, report["n"], len(items), list(out.facts["pca"]["eigenvalues"]), s.simulations, s.seed).cache()
    out.tables["parallel_analysis"] = parallel
    if scales is None:
        factors = measure.efa(r, max(2, parallel.filter("retain").count()))
        out.facts["efa"] = factors
        scales = features.assign_subscales(factors["loadings"], items, measure.name_factors(factors["loadings"], items, facets or {}))
    out.tables["subscales"] = describe.subscale_report(rows, scales)
    split = features.split_holdout(features.tertiles(rows.withColumn("_strain", total(items).cast("double")), "_strain"), "stratum", s.holdout, s.seed).cache()
    made = {name: space(split, items, sub, s) for name, sub in {"main": scales, **(spaces or {})}.items()}
    found = {name: evidence(sp.train, sp.cols, s) for name, sp in made.items()}
    both = reduce(DataFrame.unionByName, [ev.withColumn("space", F.lit(name)) for name, (ev, _) in found.items()]).cache()
    out.tables |= {"space_evidence": both, "spaces": select.choose_space(both, s.cap).cache()}
    out.facts["space"] = out.tables["spaces"].filter("chosen").first()["space"]
    sp = made[out.facts["space"]]
    scales, cols, means, sds, z = sp.scales, sp.cols, sp.means, sp.sds, sp.z
    ev, out.tables["sweep"] = both.filter(F.col("space") == out.facts["space"]).drop("space"), found[out.facts["space"]][1]
    out.tables["exclusions"] = stability.exclusions(out.tables["sweep"].withColumn("error", F.lit(None).cast("string")))
    decision = select.screen_and_vote(ev, s.cap).cache()
    gap = resample.gap(sp.train, cols, range(1, s.ks.stop), s.references, s.seed).cache()
    k = s.k or decision.filter("chosen").first()["k"]
    out.tables |= {"evidence": ev, "decision": decision, "gap": gap, "gap_choice": select.one_se_rule(gap), "picks": select.own_picks(ev), "runner_up": select.runner_up(decision), "seed_stability": sweeps.seed_stability(sp.train, cols, k, s.seeds)}
    out.facts["decision"] = select.decision_record(ev, decision, gap, out.tables["sweep"].filter("algorithm = 'kmeans'").select("k", F.col("inertia").alias("sse")))
    fitted, held = z.filter("split = 'train'"), z.filter("split = 'holdout'")
    centres = resample.fit(fitted, cols, k, s.starts, s.seed)
    out.facts |= {"k": k, "holdout": resample.holdout(fitted, held, cols, centres, s.starts, s.seed)}

    def scorer(centres: np.ndarray) -> Bundle:
        return Bundle(items, reversed_items, scales, means, sds, centres.tolist(), [f"P{i}" for i in range(len(centres))])

    out.bundle = scorer(centres)
    # names go by the numbers of the stored centres, which are those that scoring gives
    profiles, named = named_profiles(survey, out.bundle, z, s.least_eta)
    names = {row["cluster"]: row["persona"] for row in named.collect()}  # k rows
    out.bundle.names = [names.get(i, f"P{i}") for i in range(k)]
    second = out.tables["runner_up"].first()
    if second and second["k"] != k:
        out.tables["runner_up_personas"] = named_profiles(survey, scorer(resample.fit(fitted, cols, second["k"], s.starts, s.seed)), z, s.least_eta)[1]
    if s.secondary_k and s.secondary_k != k:
        other = scorer(resample.fit(fitted, cols, s.secondary_k, s.starts, s.seed))
        out.tables["secondary_profiles"], out.tables["secondary_personas"] = named_profiles(survey, other, z, s.least_eta)
        two = score(survey, out.bundle).select("row_id", "cluster").join(score(survey, other).select("row_id", F.col("cluster").alias("_second")), "row_id")
        out.facts["secondary"] = {"k": s.secondary_k, "ari": associate.agreement(two, "cluster", "_second").first()["ari"]}
    out.labelled = score(survey, out.bundle).join(split.select("row_id", "split"), "row_id")
    both = out.labelled.select("row_id", "cluster", *background).join(z.select("row_id", *cols), "row_id").cache()
    parts = [named, describe.cluster_profiles(both, []).select("cluster", "n", "pct"), naming.recommendations(profiles, advice or [])]
    parts += [naming.common_level(both, c) for c in background] + ([naming.top_themes(both, themes)] if themes is not None else [])
    out.tables |= {"profiles": describe.cluster_profiles(both, cols), "eta_squared": associate.eta_squared(both, cols), "personas": named, "cards": naming.cards(*parts)}
    out.facts["rules"] = supervised.tree_rules(rows.join(both.select("row_id", "cluster"), "row_id"), items, "cluster")
    out.facts["external"] = associate.classes_to_clusters(both, "cluster", background)
    return out


def assignments(run: Run, survey: DataFrame) -> DataFrame:
    """row_id, cluster, persona, split, what was answered, standardised subscales (3 digits), distances, and each row's silhouette with centroids in place of rows."""
    aligned = features.align(survey, run.bundle.reversed_items)
    scored = features.subscales(aligned, run.bundle.subscales) if run.bundle.subscales else aligned
    z = scored.select("row_id", *[F.round((F.col(c) - run.bundle.means[c]) / (run.bundle.sds[c] or 1.0), 3).alias(f"z_{c}") for c in run.bundle.columns])
    near, more = F.col("distance_to_own_centroid"), F.col("margin_to_next")
    silhouette = F.when(near + more > 0, F.round(more / (near + more), 3)).otherwise(0.0)
    return run.labelled.withColumn("silhouette", silhouette).join(z, "row_id")


def persist(run: Run, survey: DataFrame, path: str) -> None:
    """Under ``path``: the assignments and every table as Parquet, the scorer, and facts with small tables as one JSON document and a summary."""
    spark = survey.sparkSession
    assignments(run, survey).write.mode("overwrite").parquet(f"{path}/assignments")
    for name, table in run.tables.items():
        table.write.mode("overwrite").parquet(f"{path}/tables/{name}")
    run.bundle.save(spark, f"{path}/scorer")
    facts = sinks.jsonable(run.facts)
    text = [(json.dumps(facts, ensure_ascii=False),)], [(sinks.summary(facts),)], [(sinks.rules_text(run.facts["rules"]),)]
    for rows, name in zip(text, ("results", "summary", "rules"), strict=True):
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
