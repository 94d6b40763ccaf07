"""The registered queries and their oracles. Each query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.functions.expressions import row_mean, rounded, total
from cohortry.operators import associate, bands, describe, features, measure, select, stability, text, validity
from cohortry.sources.survey import ITEM_NAMES, REVERSED, SUBSCALES, SURVEY_SQL, survey

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.align(survey(spark, sf_dir), REVERSED)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aligned survey with a rule-made cluster."""
    s = total(ITEM_NAMES)
    return aligned(spark, sf_dir).withColumn("cluster", F.when(s >= 40, 0).when(s >= 33, 1).otherwise(2))


SIZE = 64


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    return validity.vector_columns(read(spark, sf_dir, "embeddings").withColumnRenamed("label", "cluster").withColumnRenamed("vec_id", "row_id"), "embedding", SIZE)


# SQL pieces
I = ITEM_NAMES  # noqa: E741
SUM = " + ".join(I)
LONG = lambda table, cols=I, keys="": f"(SELECT {keys}item, value::DOUBLE AS value FROM {table} UNPIVOT INCLUDE NULLS (value FOR item IN ({', '.join(cols)})))"
VEC = f"{', '.join(f'embedding[{i + 1}]::DOUBLE AS x{i}' for i in range(SIZE))}"
XS = [f"x{i}" for i in range(SIZE)]
EMB = f"vec AS (SELECT vec_id AS row_id, label AS cluster, {VEC} FROM embeddings), vl AS (SELECT row_id, cluster, item, value FROM vec UNPIVOT (value FOR item IN ({', '.join(XS)})))"
#: Word edges as in text.theme_pattern; fixed text of the themes used by the queries.
TOPICS = {"function": ("the", "der", "die", "la", "le", "el"), "linking": ("and", "und", "et", "y"), "insult": ("idiot", "trash", "scum", "worthless", "loser", "pathetic"), "negation": ("not", "nicht", "pas"), "address": (r"https?", "www", "mail[0-9]*"), "number": (r"[0-9]+",)}


def _fires(col: str, terms: tuple[str, ...]) -> str:
    return rf"regexp_matches({col}, '(?i)(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])(?:{'|'.join(terms)})(?:[^\p{{L}}\p{{M}}\p{{N}}_]|$)')"


WS = r"[ \t\n\x0B\f\r]"
TAGGED = "tg AS (SELECT doc_id AS row_id, lang, source, text, length(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) > 0 AS answered, " + ", ".join(f"CASE WHEN {_fires('text', t)} THEN 1 ELSE 0 END AS {k}" for k, t in TOPICS.items()) + " FROM documents)"
TAG_LONG = "tl AS (SELECT row_id, lang, theme FROM tg UNPIVOT (v FOR theme IN (" + ", ".join(TOPICS) + ")) WHERE v = 1 AND answered)"


def tagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tag(read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id"), "text", TOPICS)


@query(SURVEY_SQL + f""" SELECT item, count(value)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
 round((avg(value ** 3) - 3 * avg(value) * avg(value ** 2) + 2 * avg(value) ** 3) / var_pop(value) ** 1.5, 6) AS skew,
 round(100.0::DOUBLE * avg((value >= 4)::INT), 6) AS pct_agree, round(100.0::DOUBLE * avg((value <= 2)::INT), 6) AS pct_disagree, round(100.0::DOUBLE * avg((value = 5)::INT), 6) AS pct_top_box,
 {", ".join(f"count(*) FILTER (value = {i})::BIGINT AS n_{i}" for i in range(1, 6))}, median(value) AS median, (avg(value) >= 4 AND 100.0 * avg((value = 5)::INT) >= 45) AS ceiling FROM {LONG("survey")} GROUP BY item""")
def item_descriptives(spark, sf_dir):
    return describe.item_descriptives(survey(spark, sf_dir), ITEM_NAMES)


@query(SURVEY_SQL + " SELECT row_id, " + ", ".join(I) + " FROM aligned")
def reverse_code(spark, sf_dir):
    return aligned(spark, sf_dir).select("row_id", *ITEM_NAMES)


@query("""WITH e AS (SELECT *, row(event_id, ts, user_id, event_type, value, props) AS w, row(event_id, user_id, event_type, value, props) AS u FROM events),
d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)
SELECT count(*)::BIGINT AS n_rows, sum((event_type IS NULL)::INT + (user_id IS NULL)::INT)::BIGINT AS null_closed, sum((value IS NULL)::INT)::BIGINT AS null_items, sum((props IS NULL)::INT)::BIGINT AS null_texts,
 (count(*) - count(DISTINCT w))::BIGINT AS duplicates, (count(*) - count(DISTINCT u))::BIGINT AS duplicates_untimed, sum(coalesce((value NOT BETWEEN 1 AND 5)::INT, 0))::BIGINT AS out_of_range, sum(coalesce((value <> floor(value))::INT, 0))::BIGINT AS fractional,
 min(ts) AS first_time, max(ts) AS last_time, (floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) + 1)::BIGINT AS window_days,
 (SELECT day::VARCHAR FROM d ORDER BY n DESC, day LIMIT 1) AS peak_day, (SELECT max(n) FROM d)::BIGINT AS peak_n FROM e""")
def quality_audit(spark, sf_dir):
    return describe.audit_quality(read(spark, sf_dir, "events"), ["event_type", "user_id"], ["value"], ["props"], "ts").withColumn("peak_day", F.col("peak_day").cast("string"))


def _runs() -> str:
    parts = ", ".join(f"CASE WHEN {b} = {a} THEN 1 ELSE 0 END AS e{k}" for k, (a, b) in enumerate(zip(I, I[1:], strict=False)))
    best = [f"({' + '.join(f'(CASE WHEN ' + ' AND '.join(f'e{j} = 1' for j in range(s, t + 1)) + ' THEN 1 ELSE 0 END)' for t in range(s, len(I) - 1))} + 1)" for s in range(len(I) - 1)]
    return f"(SELECT *, greatest({', '.join(best)}) AS run FROM (SELECT *, {parts} FROM survey))"


@query(SURVEY_SQL + f""", r AS (SELECT *, [{", ".join(I)}] AS a FROM {_runs()}), s AS (SELECT *, len(list_distinct(a)) AS k, list_aggregate(a, 'stddev_pop') AS sd, len(list_filter(a, lambda x: x = 5)) / 12.0::DOUBLE AS top FROM r)
SELECT count(*) FILTER (k = 1)::BIGINT AS n_straight, round(100.0::DOUBLE * avg((k = 1)::INT), 6) AS pct_straight, count(*) FILTER (sd < 0.35)::BIGINT AS n_flat, round(avg(sd), 6) AS mean_sd, round(min(sd), 6) AS min_sd,
 max(run)::INT AS longest_run, count(*) FILTER (run >= 8)::BIGINT AS n_long_runs, round(100.0::DOUBLE * avg(top), 6) AS pct_top_box, round(100.0::DOUBLE * avg((k = 5)::INT), 6) AS pct_all_points FROM s""")
def response_style(spark, sf_dir):
    return describe.response_style(survey(spark, sf_dir), ITEM_NAMES)


@query("SELECT o_orderpriority AS level, count(*)::BIGINT AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM orders GROUP BY 1")
def level_distribution(spark, sf_dir):
    return describe.distribution(read(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query(SURVEY_SQL + f", v AS (SELECT item, avg(value) AS m, stddev_samp(value) AS s, var_samp(value) AS v FROM {LONG('aligned')} GROUP BY 1) SELECT item, round(m, 6) AS mean, round(s, 6) AS sd, round(v, 6) AS variance, round(v / min(v) OVER (), 6) AS weight_vs_smallest FROM v")
def std_evidence(spark, sf_dir):
    return describe.standardisation_evidence(aligned(spark, sf_dir), ITEM_NAMES)


@query(SURVEY_SQL + """, l AS (SELECT 'living' AS variable, living AS level, count(*) AS n FROM survey GROUP BY 2 UNION ALL SELECT 'department', department, count(*) FROM survey GROUP BY 2),
k AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, level) AS k FROM l)
SELECT variable, count(*)::BIGINT AS levels, max(n)::BIGINT AS largest, min(n)::BIGINT AS smallest, round(max(n)::DOUBLE / min(n), 6) AS ratio, round(100.0::DOUBLE * (sum(n) FILTER (k <= 3)) / sum(n), 6) AS top3_pct, count(*) FILTER (n < 25)::BIGINT AS small_levels FROM k GROUP BY 1""")
def imbalance(spark, sf_dir):
    return describe.imbalance(survey(spark, sf_dir), ["living", "department"])


@query("SELECT p_partkey AS row_id, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS size_z, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS price_z FROM part")
def zscore(spark, sf_dir):
    z = features.standardise(read(spark, sf_dir, "part"), ["p_size", "p_retailprice"], "_z")
    return z.select(F.col("p_partkey").alias("row_id"), rounded(F.col("p_size_z")).alias("size_z"), rounded(F.col("p_retailprice_z")).alias("price_z"))


@query(SURVEY_SQL + f", q AS (SELECT quantile_cont(({SUM})::DOUBLE, [1/3.0::DOUBLE, 2/3.0::DOUBLE]) AS e FROM aligned) SELECT row_id, CASE WHEN {SUM} <= e[1] THEN 'low' WHEN {SUM} <= e[2] THEN 'mid' ELSE 'high' END AS stratum FROM aligned, q")
def tertile_strata(spark, sf_dir):
    return features.tertiles(aligned(spark, sf_dir).withColumn("strain", total(ITEM_NAMES).cast("double")), "strain").select("row_id", "stratum")


@query(SURVEY_SQL + " SELECT row_id, " + ", ".join(f"round(({' + '.join(c)}) / {float(len(c))}::DOUBLE, 6) AS {n}" for n, c in SUBSCALES.items()) + " FROM aligned")
def subscale_scores(spark, sf_dir):
    return features.subscales(aligned(spark, sf_dir), SUBSCALES).select("row_id", *[rounded(F.col(n)).alias(n) for n in SUBSCALES])


@query("SELECT c_custkey AS row_id, " + ", ".join(f"(c_mktsegment = '{v}')::INT AS seg_{v}" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def one_hot(spark, sf_dir):
    d = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("seg"))
    return features.one_hot(d, "seg", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).drop("seg")


def _alpha(cols) -> str:
    return f"{len(cols)}.0::DOUBLE / {len(cols) - 1} * (1 - ({' + '.join(f'var_samp({c})' for c in cols)}) / var_samp({' + '.join(cols)}))"


@query(SURVEY_SQL + f" SELECT round({_alpha(I)}, 6) AS alpha FROM aligned")
def cronbach_alpha(spark, sf_dir):
    return aligned(spark, sf_dir).agg(rounded(measure.alpha_expression(ITEM_NAMES)).alias("alpha"))


@query(SURVEY_SQL + ", a AS (SELECT " + ", ".join(f"{_alpha([x for x in I if x != c])} AS {c}" for c in I) + f" FROM aligned) SELECT item, round(value, 6) AS alpha_if_deleted FROM a UNPIVOT (value FOR item IN ({', '.join(I)}))")
def alpha_if_deleted(spark, sf_dir):
    return measure.alpha_if_deleted(aligned(spark, sf_dir), ITEM_NAMES)


@query(SURVEY_SQL + ", a AS (SELECT " + ", ".join(f"corr({c}, {SUM} - {c}) AS {c}" for c in I) + f" FROM aligned) SELECT item, round(value, 6) AS r FROM a UNPIVOT (value FOR item IN ({', '.join(I)}))")
def item_total(spark, sf_dir):
    return measure.item_total(aligned(spark, sf_dir), ITEM_NAMES)


@query(SURVEY_SQL + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM aligned" for i, a in enumerate(I) for b in I[i + 1 :]))
def corr_matrix_long(spark, sf_dir):
    return measure.correlations_long(aligned(spark, sf_dir), ITEM_NAMES)


@query(SURVEY_SQL + " " + " UNION ALL ".join(f"SELECT '{n}' AS subscale, {len(c)} AS n_items, round({_alpha(c)}, 6) AS alpha, {f'round(2 * corr({c[0]}, {c[1]}) / (1 + corr({c[0]}, {c[1]})), 6)' if len(c) == 2 else 'NULL::DOUBLE'} AS spearman_brown, round(avg(({' + '.join(c)}) / {float(len(c))}::DOUBLE), 6) AS mean, round(stddev_samp(({' + '.join(c)}) / {float(len(c))}::DOUBLE), 6) AS sd FROM aligned" for n, c in SUBSCALES.items()))
def subscale_report(spark, sf_dir):
    return describe.subscale_report(aligned(spark, sf_dir), SUBSCALES)


@query("SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def crosstab_long(spark, sf_dir):
    return describe.crosstab(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


def _chi2(table: str, a: str, b: str) -> str:
    return f"""c AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
ra AS (SELECT a, sum(n) AS ra FROM c GROUP BY 1), cb AS (SELECT b, sum(n) AS cb FROM c GROUP BY 1), al AS (SELECT sum(n) AS t, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof, count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM c),
g AS (SELECT t, dof, r, k, abs(coalesce(n, 0) - ra * cb / t) AS gap, ra * cb / t AS e FROM ra CROSS JOIN cb CROSS JOIN al LEFT JOIN c USING (a, b)),
x AS (SELECT any_value(t) AS t, any_value(dof) AS dof, any_value(r) AS r, any_value(k) AS k, sum(CASE WHEN dof = 1 THEN greatest(gap - 0.5::DOUBLE, 0) ** 2 ELSE gap ** 2 END / e) AS chi2 FROM g),
y AS (SELECT *, greatest(0, chi2 / t - dof / (t - 1)) AS phi, least(r - (r - 1) ** 2 / (t - 1), k - (k - 1) ** 2 / (t - 1)) - 1 AS m FROM x),
z AS (SELECT *, CASE WHEN m > 0 THEN sqrt(phi / m) ELSE 0 END AS v FROM y)
SELECT t::BIGINT AS n, r, k AS c, dof, round(chi2, 6) AS chi2, round(sqrt(chi2 / (t * (least(r, k) - 1))), 6) AS v_plain, round(v, 6) AS cramers_v, CASE WHEN v < 0.1 THEN 'negligible' WHEN v < 0.2 THEN 'small' WHEN v < 0.3 THEN 'moderate' ELSE 'large' END AS effect FROM z"""


@query("WITH oc AS (SELECT o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey), " + _chi2("oc", "o_orderpriority", "c_mktsegment"))
def chi2_cramers_v(spark, sf_dir):
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return associate.chi2_cells(joined, "o_orderpriority", "c_mktsegment")


@query(SURVEY_SQL + ", " + _chi2("survey", "gender", "backlog"))
def chi2_yates(spark, sf_dir):
    return associate.chi2_cells(survey(spark, sf_dir), "gender", "backlog")


@query(SURVEY_SQL + """, c AS (SELECT cluster AS a, year AS b, count(*)::DOUBLE AS n FROM lab GROUP BY ALL), r AS (SELECT a, sum(n) AS n, max(n) AS m FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS n FROM c GROUP BY 1),
o AS (SELECT (SELECT sum(n) FROM c) AS t, (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(n * (n - 1) / 2) FROM r) AS i, (SELECT sum(n * (n - 1) / 2) FROM k) AS j, (SELECT sum(m) FROM r) AS major, (SELECT max(n) FROM k) AS base,
 (SELECT -sum(n / t * ln(n / t)) FROM r, (SELECT sum(n) AS t FROM c)) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM k, (SELECT sum(n) AS t FROM c)) AS hb, (SELECT -sum(n / t * ln(n / t)) FROM c, (SELECT sum(n) AS t FROM c)) AS hab)
SELECT t::BIGINT AS n, round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 6) AS ari, round(2 * (ha + hb - hab) / (ha + hb), 6) AS nmi, round(major / t, 6) AS majority_accuracy, round(base / t, 6) AS baseline FROM o""")
def label_agreement(spark, sf_dir):
    return associate.agreement(labelled(spark, sf_dir), "cluster", "year")


@query(SURVEY_SQL + f""", l AS (SELECT cluster, item, value::DOUBLE AS value FROM lab UNPIVOT (value FOR item IN ({", ".join(I)}))), g AS (SELECT item, avg(value) AS g, count(*) AS t FROM l GROUP BY 1), p AS (SELECT item, cluster, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS w FROM l GROUP BY ALL),
s AS (SELECT item, sum(n * (m - g) ** 2) AS b, sum(w) AS w, any_value(t) AS t, count(*) AS k FROM p JOIN g USING (item) GROUP BY 1), e AS (SELECT *, b / (b + w) AS eta FROM s)
SELECT item, round(eta, 6) AS eta_squared, round((b / (k - 1)) / (w / (t - k)), 6) AS f, (k - 1)::BIGINT AS dof_between, (t - k)::BIGINT AS dof_within, CASE WHEN eta <= .01 THEN 'negligible' WHEN eta <= .06 THEN 'small' WHEN eta <= .14 THEN 'medium' ELSE 'large' END AS effect FROM e""")
def eta_squared(spark, sf_dir):
    return associate.eta_squared(labelled(spark, sf_dir), ITEM_NAMES)


@query(f"WITH {EMB} SELECT cluster, count(*)::BIGINT AS n, {', '.join(f'round(avg({x}), 6) AS {x}' for x in XS)}, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM vec GROUP BY 1")
def cluster_profiles(spark, sf_dir):
    df, cols = vectors(spark, sf_dir)
    return describe.cluster_profiles(df, cols)


@query("SELECT count(*)::BIGINT AS k, min(n)::BIGINT AS min_size, max(n)::BIGINT AS max_size, round(min(n)::DOUBLE / sum(n), 6) AS min_frac, round(max(n)::DOUBLE / sum(n), 6) AS max_frac FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def cluster_sizes(spark, sf_dir):
    return describe.cluster_sizes(read(spark, sf_dir, "embeddings"), "label")


@query(SURVEY_SQL + f" SELECT CASE WHEN grouping(cluster) = 1 THEN 'ALL' ELSE cluster::VARCHAR END AS cluster, count(*)::BIGINT AS n, {', '.join(f'round(avg({i}), 6) AS {i}' for i in I)} FROM lab GROUP BY ROLLUP (lab.cluster)")
def profile_table(spark, sf_dir):
    return describe.profile_table(labelled(spark, sf_dir), ITEM_NAMES)


@query(SURVEY_SQL + f", l AS (SELECT cluster, item, value::DOUBLE AS value FROM lab UNPIVOT (value FOR item IN ({', '.join(I)}))), g AS (SELECT item, avg(value) AS m, stddev_samp(value) AS s FROM l GROUP BY 1) SELECT cluster, item, round((avg(value) - any_value(m)) / any_value(s), 6) AS z FROM l JOIN g USING (item) GROUP BY ALL")
def z_profile(spark, sf_dir):
    return describe.z_profile(labelled(spark, sf_dir), ITEM_NAMES)


@query(SURVEY_SQL + """ SELECT CASE WHEN grouping(cluster) = 1 THEN 'SAMPLE' ELSE cluster::VARCHAR END AS cluster, count(*)::BIGINT AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM lab), 6) AS pct, round(avg(year), 6) AS mean_year, round(avg(band), 6) AS mean_band, round(100.0::DOUBLE * avg(backlog), 6) AS pct_backlog,
 round(100.0::DOUBLE * count(*) FILTER (living = 'BUILDING') / count(*), 6) AS pct_BUILDING, round(100.0::DOUBLE * count(*) FILTER (living = 'MACHINERY') / count(*), 6) AS pct_MACHINERY FROM lab GROUP BY ROLLUP (lab.cluster)""")
def background_composition(spark, sf_dir):
    return describe.background_composition(labelled(spark, sf_dir), "cluster", ["year", "band"], ["backlog"], "living", ["BUILDING", "MACHINERY"])


@query("SELECT o_orderpriority AS a, count(*)::BIGINT AS n, " + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = '{v}') / count(*), 6) AS pct_{v}" for v in "FOP") + " FROM orders GROUP BY 1")
def composition(spark, sf_dir):
    return describe.composition(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", list("FOP"))


@query(SURVEY_SQL + f""", mo AS (SELECT cluster, living AS modal_living FROM (SELECT cluster, living, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, living) AS k FROM lab GROUP BY cluster, living) WHERE k = 1)
SELECT lab.cluster, count(*)::BIGINT AS n, round(avg(({SUM}) / 12.0::DOUBLE), 6) AS mean_strain, round(stddev_samp(({SUM}) / 12.0::DOUBLE), 6) AS sd_strain, round(100.0::DOUBLE * avg(backlog), 6) AS pct_backlog, any_value(modal_living) AS modal_living FROM lab JOIN mo USING (cluster) GROUP BY lab.cluster""")
def cluster_summary(spark, sf_dir):
    return describe.cluster_summary(labelled(spark, sf_dir).withColumn("strain", row_mean(ITEM_NAMES)), "cluster", "strain", ["living"], ["backlog"])


@query(SURVEY_SQL + f", s AS (SELECT cluster, avg(({SUM}) / 12.0::DOUBLE) AS s FROM lab GROUP BY 1) SELECT cluster, round(s, 6) AS strain, row_number() OVER (ORDER BY s DESC, cluster)::INT AS strain_rank FROM s")
def strain_order(spark, sf_dir):
    return describe.order_by_strain(labelled(spark, sf_dir), ITEM_NAMES)


Z_SQL = SURVEY_SQL + ", z AS (SELECT row_id, cluster, " + ", ".join(f"({i} - avg({i}) OVER ()) / stddev_pop({i}) OVER () AS {i}" for i in I) + f" FROM lab), l AS (SELECT cluster, item, value FROM z UNPIVOT (value FOR item IN ({', '.join(I)}))), p AS (SELECT cluster, item, count(*) AS n, avg(value) AS m FROM l GROUP BY ALL), g AS (SELECT item, avg(value) AS g FROM l GROUP BY 1), d AS (SELECT cluster, n, m - g AS delta, avg(m - g) OVER (PARTITION BY cluster) AS lev FROM p JOIN g USING (item)), o AS (SELECT sum(n * lev ** 2) AS a, sum(n * (delta - lev) ** 2) AS b FROM d) SELECT round(a, 6) AS ss_level, round(b, 6) AS ss_shape, round(a + b, 6) AS between_ss, round(b / (a + b), 6) AS differentiation FROM o"


@query(Z_SQL)
def profile_differentiation(spark, sf_dir):
    return validity.differentiation(features.standardise(labelled(spark, sf_dir), ITEM_NAMES), ITEM_NAMES)


@query(f"WITH {EMB}, p AS (SELECT cluster, item, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS w FROM vl GROUP BY ALL), g AS (SELECT item, avg(value) AS g FROM vl GROUP BY 1), o AS (SELECT sum(n * (m - g) ** 2) AS b, sum(w) AS w, count(DISTINCT cluster) AS k, (SELECT count(*) FROM vec) AS n FROM p JOIN g USING (item)) SELECT k, n, round(b, 6) AS between_ss, round(w, 6) AS within_ss, round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM o")
def calinski_harabasz(spark, sf_dir):
    return validity.calinski_harabasz(*vectors(spark, sf_dir))


@query(f"WITH {EMB}, c AS (SELECT cluster, item, avg(value) AS m FROM vl GROUP BY ALL), d AS (SELECT row_id, vl.cluster, sqrt(sum((value - m) ** 2)) AS d FROM vl JOIN c USING (cluster, item) GROUP BY ALL), s AS (SELECT cluster, avg(d) AS s FROM d GROUP BY 1), pr AS (SELECT a.cluster AS i, b.cluster AS j, sqrt(sum((a.m - b.m) ** 2)) AS m FROM c a JOIN c b ON a.item = b.item AND a.cluster <> b.cluster GROUP BY ALL), r AS (SELECT i, max((x.s + y.s) / m) AS r FROM pr JOIN s x ON x.cluster = i JOIN s y ON y.cluster = j GROUP BY 1) SELECT count(*)::BIGINT AS k, round(avg(r), 6) AS davies_bouldin FROM r")
def davies_bouldin(spark, sf_dir):
    return validity.davies_bouldin(*vectors(spark, sf_dir))


SIL = "WITH e AS (SELECT vec_id AS i, label AS c, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.i, a.c, b.c AS o, avg(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.i <> b.i GROUP BY ALL), r AS (SELECT i, c, max(d) FILTER (c = o) AS a, min(d) FILTER (c <> o) AS b FROM p GROUP BY ALL), s AS (SELECT *, coalesce((b - a) / greatest(a, b), 0) AS s FROM r)"


@query(SIL + " SELECT CASE WHEN grouping(c) = 1 THEN 'ALL' ELSE c::VARCHAR END AS cluster, count(*)::BIGINT AS n, round(avg(s), 6) AS silhouette, round(100.0::DOUBLE * avg((s < 0)::INT), 6) AS pct_negative FROM s GROUP BY ROLLUP (c)")
def silhouette_exact(spark, sf_dir):
    return validity.silhouette(*vectors(spark, sf_dir))


@query(f"WITH {EMB}, c AS (SELECT cluster AS o, item, avg(value) AS m FROM vl GROUP BY ALL), d AS (SELECT row_id, cluster, o, sqrt(sum((value - m) ** 2)) AS d FROM vl JOIN c USING (item) GROUP BY ALL), r AS (SELECT row_id, min(d) FILTER (o = cluster) AS a, min(d) FILTER (o <> cluster) AS b FROM d GROUP BY 1) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM r")
def silhouette_simplified(spark, sf_dir):
    return validity.simplified_silhouette(*vectors(spark, sf_dir))


@query(f"WITH {EMB}, c AS (SELECT cluster, count(*)::BIGINT AS n, {', '.join(f'avg({x}) AS {x}' for x in XS)} FROM vec GROUP BY 1) SELECT cluster AS old, (row_number() OVER (ORDER BY round(({' + '.join(XS)}) / 64, 9) DESC, {', '.join(f'round({x}, 6)' for x in XS)}) - 1)::INT AS new, n FROM c")
def canonical_labels(spark, sf_dir):
    return validity.canonical_labels(*vectors(spark, sf_dir))


@query(f"WITH {EMB}, c AS (SELECT cluster AS c, item, avg(value) AS m FROM vl WHERE cluster < 3 GROUP BY ALL), d AS (SELECT row_id, c, sqrt(sum((value - m) ** 2)) AS d FROM vl JOIN c USING (item) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, c) AS k FROM d) SELECT row_id, max(c) FILTER (k = 1)::INT AS cluster, round(max(d) FILTER (k = 1), 6) AS distance, round(max(d) FILTER (k = 2) - max(d) FILTER (k = 1), 6) AS margin FROM k GROUP BY 1")
def nearest_centroid(spark, sf_dir):
    """All rows against the centroids of the first three labels."""
    df, cols = vectors(spark, sf_dir)
    centres = validity.centroids(df.filter("cluster < 3"), cols).orderBy("cluster").collect()  # three rows
    return validity.nearest_centroid(df, cols, [[r[c] for c in cols] for r in centres])


@query(SURVEY_SQL + """, r AS (SELECT (max(year) - min(year))::DOUBLE AS y, (max(band) - min(band))::DOUBLE AS b FROM survey), p AS (SELECT a.row_id AS q, s.row_id AS other, round((abs(s.year - a.year) / y + abs(s.band - a.band) / b + (s.living <> a.living)::INT + (s.department <> a.department)::INT) / 4.0::DOUBLE, 6) AS distance FROM survey a JOIN survey s ON a.row_id <> s.row_id, r WHERE a.row_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, other) AS place FROM p) SELECT q, other, distance, place::INT AS place FROM k WHERE place <= 3""")
def gower_nearest(spark, sf_dir):
    return validity.gower_nearest(survey(spark, sf_dir), ["year", "band"], ["living", "department"], F.col("row_id") % 50 == 0)


KS = range(2, 9)
HALF, REST = " + ".join(I[:6]), " + ".join(I[:-1])
_band_sql = lambda x: f"least(k - 1, floor(({x} - min({x}) OVER (PARTITION BY k)) * k / greatest(max({x}) OVER (PARTITION BY k) - min({x}) OVER (PARTITION BY k), 1)::DOUBLE))::INT"
_rand_sql = lambda o: f"""(SELECT ca.k, (ca.ij - ra.i * rb.j / (n * (n - 1) / 2)) / ((ra.i + rb.j) / 2 - ra.i * rb.j / (n * (n - 1) / 2)) AS ari FROM (SELECT k, sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM (SELECT k, band, {o}, count(*)::DOUBLE AS n FROM ba GROUP BY ALL) GROUP BY 1) ca
 JOIN (SELECT k, sum(n * (n - 1) / 2) AS i FROM (SELECT k, band, count(*)::DOUBLE AS n FROM ba GROUP BY ALL) GROUP BY 1) ra ON ra.k = ca.k JOIN (SELECT k, sum(n * (n - 1) / 2) AS j FROM (SELECT k, {o}, count(*)::DOUBLE AS n FROM ba GROUP BY ALL) GROUP BY 1) rb ON rb.k = ca.k)"""  # noqa: E731
#: Evidence per k of equal bands of the total, from the rows of the survey view.
EV_SQL = SURVEY_SQL + f""", sc AS (SELECT k, {SUM} AS whole, {REST} AS rest, {HALF} AS half, {", ".join(I)} FROM aligned, (SELECT unnest(range({KS.start}, {KS.stop})) AS k)),
ba AS (SELECT *, {_band_sql("whole")} AS band, {_band_sql("rest")} AS rest_band, {_band_sql("half")} AS half_band FROM sc),
bm AS (SELECT k, band, count(*)::DOUBLE AS n, avg(whole) AS m FROM ba GROUP BY ALL),
rw AS (SELECT ba.k, ba.band, whole, max(abs(whole - m)) FILTER (bm.band = ba.band) AS a, min(abs(whole - m)) FILTER (bm.band <> ba.band) AS b, count(*) / count(DISTINCT bm.band) AS c FROM ba JOIN bm ON ba.k = bm.k GROUP BY ba.k, ba.band, whole),
si AS (SELECT k, sum(c * CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) / sum(c) AS silhouette, sum(c * a * a) AS w, sum(c) AS n FROM rw GROUP BY 1),
sp AS (SELECT k, band, sum(c * a) / sum(c) AS s FROM rw GROUP BY ALL),
db AS (SELECT k, avg(r) AS d FROM (SELECT x.k, x.band, max((p.s + q.s) / abs(x.m - y.m)) AS r FROM bm x JOIN bm y ON x.k = y.k AND x.band <> y.band JOIN sp p ON p.k = x.k AND p.band = x.band JOIN sp q ON q.k = y.k AND q.band = y.band GROUP BY ALL) GROUP BY 1),
gr AS (SELECT k, sum(n * (m - g) ** 2) AS b, count(*) AS f, min(n) / sum(n) AS z FROM (SELECT *, sum(n * m) OVER (PARTITION BY k) / sum(n) OVER (PARTITION BY k) AS g FROM bm) GROUP BY 1),
it AS (SELECT k, band, item, count(*)::DOUBLE AS n, avg(value) AS m FROM ba UNPIVOT (value FOR item IN ({", ".join(I)})) GROUP BY ALL),
de AS (SELECT k, band, n, m - sum(n * m) OVER (PARTITION BY k, item) / sum(n) OVER (PARTITION BY k, item) AS d FROM it),
sh AS (SELECT k, sum(n * (d - l) ** 2) / sum(n * d ** 2) AS v FROM (SELECT *, avg(d) OVER (PARTITION BY k, band) AS l FROM de) GROUP BY 1),
ev AS (SELECT si.k, round(silhouette, 6) AS silhouette, round(d, 6) AS davies_bouldin, round((b / (f - 1)) / (w / (n - f)), 6) AS calinski_harabasz, round(n * ln(w / n) + si.k * ln(n), 6) AS bic_gmm, round(r1.ari, 6) AS bootstrap_ari, round(r2.ari, 6) AS cross_algo_ari, round(v, 6) AS differentiation, round(z, 6) AS min_size_frac, round(w, 6) AS sse
 FROM si JOIN db ON db.k = si.k JOIN gr ON gr.k = si.k JOIN sh ON sh.k = si.k JOIN {_rand_sql("rest_band")} r1 ON r1.k = si.k JOIN {_rand_sql("half_band")} r2 ON r2.k = si.k)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.evidence(aligned(spark, sf_dir), ITEM_NAMES, KS)


@query(EV_SQL + " SELECT * FROM ev")
def band_evidence(spark, sf_dir):
    return evidence(spark, sf_dir)


@query(EV_SQL + f""", m AS (SELECT *, concat_ws('; ', CASE WHEN min_size_frac < .05 THEN 'small cluster' END, CASE WHEN bootstrap_ari < .5 THEN 'unstable' END, CASE WHEN differentiation < .5 THEN 'level only' END, CASE WHEN k > 6 THEN 'above cap' END) AS reasons FROM ev),
r AS (SELECT k, {" + ".join(f"rank() OVER (ORDER BY {c} {'DESC' if up else 'ASC'}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE" for c, up in select.CRITERIA.items())} AS s FROM m WHERE reasons = '')
SELECT m.k, reasons, round(s / 7.0::DOUBLE, 6) AS mean_rank, row_number() OVER (ORDER BY (reasons = '') DESC, round(s / 7.0::DOUBLE, 6) NULLS LAST, m.k) = 1 AS chosen FROM m LEFT JOIN r USING (k)""")
def screen_and_vote(spark, sf_dir):
    return select.screen_and_vote(evidence(spark, sf_dir))


PICKS_SQL = " UNION ALL ".join(f"(SELECT '{c}' AS criterion, k FROM ev ORDER BY {c} {'DESC' if up else 'ASC'}, k LIMIT 1)" for c, up in select.CRITERIA.items())


@query(EV_SQL + " " + PICKS_SQL)
def criterion_picks(spark, sf_dir):
    return select.own_picks(evidence(spark, sf_dir))


@query(EV_SQL + f", v AS ({PICKS_SQL}), n AS (SELECT k, count(*)::BIGINT AS votes, max((criterion = 'silhouette')::INT) AS preferred FROM v GROUP BY 1) SELECT k, votes, preferred, row_number() OVER (ORDER BY votes DESC, preferred DESC, k) = 1 AS chosen FROM n")
def modal_vote(spark, sf_dir):
    return select.modal_vote(select.own_picks(evidence(spark, sf_dir)))


CURVES_SQL = SURVEY_SQL + f""", sc AS (SELECT k, row_id % 10 AS part, {SUM} AS whole FROM aligned, (SELECT unnest(range(1, 9)) AS k)), ba AS (SELECT *, {_band_sql("whole")} AS band FROM sc),
rf AS (SELECT k, -1 AS ref, band, whole FROM ba UNION ALL SELECT k, part, band, whole FROM ba), bw AS (SELECT k, ref, band, count(*) AS n, var_pop(whole) * count(*) AS w FROM rf GROUP BY ALL), lw AS (SELECT k, ref, ln(sum(w) / sum(n)) AS log_w FROM bw GROUP BY ALL),
g AS (SELECT k, round(avg(log_w) FILTER (ref >= 0) - max(log_w) FILTER (ref < 0), 9) AS gap, round(stddev_pop(log_w) FILTER (ref >= 0) * sqrt(1 + 1 / 10.0::DOUBLE), 9) AS s FROM lw GROUP BY 1)"""


@query(CURVES_SQL + ", h AS (SELECT k, gap >= lead(gap) OVER (ORDER BY k) - lead(s) OVER (ORDER BY k) AS h FROM g) SELECT coalesce(min(k) FILTER (h), max(k)) AS k FROM h")
def one_se_rule(spark, sf_dir):
    found = stability.gap_summary(bands.curves(aligned(spark, sf_dir), ITEM_NAMES), 10)
    return select.one_se_rule(found.select("k", rounded(F.col("gap"), 9).alias("gap"), rounded(F.col("s"), 9).alias("s")))


@query(EV_SQL + ", e AS (SELECT min(k) AS k0, max(k) AS k1, min(sse) AS lo, max(sse) AS hi, arg_min(sse, k) AS y0, arg_max(sse, k) AS y1 FROM ev), c AS (SELECT k, (k - k0)::DOUBLE / (k1 - k0) AS x, (sse - lo) / (hi - lo) AS y, (y0 - lo) / (hi - lo) AS u0, (y1 - lo) / (hi - lo) AS u1 FROM ev, e), n AS (SELECT k, abs(u0 + (u1 - u0) * x - y) / sqrt(1 + (u1 - u0) ** 2) AS d FROM c) SELECT k AS knee, round(d, 6) AS distance FROM n ORDER BY round(d, 9) DESC, k LIMIT 1")
def knee_point(spark, sf_dir):
    return select.knee_point(evidence(spark, sf_dir))


@query(f"WITH {TAGGED} SELECT row_id, answered, list_sort(list_filter([{', '.join(f'CASE WHEN answered AND {k} = 1 THEN ' + chr(39) + k + chr(39) + ' END' for k in TOPICS)}], lambda x: x IS NOT NULL)) AS themes FROM tg".replace("list_sort(", "array_to_string(list_sort(").replace(") AS themes", "), ',') AS themes"))
def theme_tags(spark, sf_dir):
    return tagged_documents(spark, sf_dir).select("row_id", "answered", F.array_join(F.sort_array("themes"), ",").alias("themes"))


@query(f"WITH {TAGGED}, {TAG_LONG} SELECT theme, count(*)::BIGINT AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM tg WHERE answered), 1) AS pct FROM tl GROUP BY 1")
def theme_prevalence(spark, sf_dir):
    return text.prevalence(tagged_documents(spark, sf_dir))


@query(f"WITH {TAGGED}, s AS (SELECT {' + '.join(TOPICS)} AS k FROM tg WHERE answered) SELECT count(*)::BIGINT AS n_answered, round(100.0::DOUBLE * avg((k > 0)::INT), 6) AS pct_tagged, round(avg(k), 6) AS mean_themes, round(100.0::DOUBLE * avg((k > 1)::INT), 6) AS pct_multi, count(*) FILTER (k = 0)::BIGINT AS n_untagged FROM s")
def theme_coverage(spark, sf_dir):
    return text.coverage(tagged_documents(spark, sf_dir))


@query(f"WITH {TAGGED}, {TAG_LONG}, n AS (SELECT lang, count(*) AS n FROM tg WHERE answered GROUP BY 1 HAVING count(*) >= 20) SELECT lang AS \"group\", theme, any_value(n)::BIGINT AS n, round(100.0::DOUBLE * count(*) / any_value(n), 6) AS pct FROM tl JOIN n USING (lang) GROUP BY ALL")
def theme_by_group(spark, sf_dir):
    return text.theme_by_group(tagged_documents(spark, sf_dir), "lang")


@query(f"WITH {TAGGED}, q AS (SELECT row_id, insult, lang FROM tg WHERE answered), " + _chi2("q", "insult", "lang"))
def theme_group_test(spark, sf_dir):
    t = tagged_documents(spark, sf_dir).filter("answered").withColumn("insult", F.array_contains("themes", "insult").cast("int"))
    return associate.chi2_cells(t, "insult", "lang")


@query(rf"""WITH d AS (SELECT text, length(regexp_replace(coalesce(text, ''), '{WS}+', '', 'g')) > 0 AS a FROM documents),
r AS (SELECT a, CASE WHEN a THEN len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) END AS w, CASE WHEN a THEN length(text) END AS c, CASE WHEN a THEN (contains(lower(text), 'the ') OR contains(lower(text), ' und ')) END AS q, CASE WHEN a THEN lower(trim(text)) END AS t FROM d)
SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (a)::BIGINT AS n_answered, round(100.0::DOUBLE * avg(a::INT), 6) AS pct_answered, round(avg(w), 6) AS mean_words, quantile_cont(w, 0.5)::DOUBLE AS median_words, max(w)::INT AS max_words, round(avg(c), 6) AS mean_chars, round(100.0::DOUBLE * avg((w <= 2)::INT), 6) AS pct_short, round(100.0::DOUBLE * avg((w >= 10)::INT), 6) AS pct_long, count(*) FILTER (a)::BIGINT AS n_latin, 0::BIGINT AS n_other, 0::BIGINT AS n_mixed, count(*) FILTER (q)::BIGINT AS n_cue, count(DISTINCT t)::BIGINT AS n_distinct FROM r""")
def text_profile(spark, sf_dir):
    return text.text_profile(read(spark, sf_dir, "documents"), "text", ("the ", " und "))


TWO = """, dn AS (SELECT count(*) AS n FROM documents), a1 AS (SELECT row_id, text FROM survey, dn JOIN documents ON doc_id = row_id % n), a2 AS (SELECT row_id, text FROM survey, dn JOIN documents ON doc_id = (7 * row_id + 3) % n)"""


@query(SURVEY_SQL + TWO + f""", b AS (SELECT row_id, a1.text AS t1, a2.text AS t2 FROM a1 JOIN a2 USING (row_id) WHERE trim(a1.text) <> '' AND trim(a2.text) <> ''),
f AS ({" UNION ALL ".join(f"SELECT '{k}' AS theme, {_fires('t1', t)} AS x, {_fires('t2', t)} AS y FROM b" for k, t in TOPICS.items())})
SELECT theme, count(*)::BIGINT AS n, round(100.0::DOUBLE * avg(x::INT), 6) AS pct_before, round(100.0::DOUBLE * avg(y::INT), 6) AS pct_after, count(*) FILTER (y AND NOT x)::BIGINT AS gained, count(*) FILTER (x AND NOT y)::BIGINT AS dropped FROM f GROUP BY 1 HAVING bool_or(x OR y)""")
def paired_shift(spark, sf_dir):
    docs, people = tagged_documents(spark, sf_dir).select(F.col("row_id").alias("doc_id"), "answered", "themes"), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"))
    n = docs.count()
    first = people.withColumn("doc_id", F.col("row_id") % n).join(docs, "doc_id")
    second = people.withColumn("doc_id", (7 * F.col("row_id") + 3) % n).join(docs, "doc_id")
    return text.paired_shift(first, second)


@query("WITH x AS (SELECT toxic, n_chars::DOUBLE AS v FROM documents JOIN labels USING (doc_id)), s AS (SELECT count(*) FILTER (toxic = 1) AS n1, count(*) FILTER (toxic = 0) AS n0, avg(v) FILTER (toxic = 1) AS m1, avg(v) FILTER (toxic = 0) AS m0, var_samp(v) FILTER (toxic = 1) AS v1, var_samp(v) FILTER (toxic = 0) AS v0 FROM x) SELECT n1, n0, round(m1, 6) AS mean1, round(m0, 6) AS mean0, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round((v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)), 6) AS dof, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS d FROM s")
def welch_by_group(spark, sf_dir):
    both = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return associate.welch(both, "toxic", "n_chars")


@query(r"SELECT term, count(*)::BIGINT AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}]{3,}'))) AS term FROM documents) GROUP BY 1 HAVING count(*) >= 3")
def doc_frequency(spark, sf_dir):
    return text.document_frequency(read(spark, sf_dir, "documents"), "text", 3)


@query("SELECT ts::DATE::VARCHAR AS day, count(*)::BIGINT AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY ts::DATE")
def daily_counts(spark, sf_dir):
    return describe.distribution(read(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string")), "day").withColumnRenamed("level", "day")


PROMPTS = [("i1", "function"), ("i2", "insult"), ("i3", "negation"), ("i4", "linking"), ("i5", "number"), ("i6", "address")]


@query(SURVEY_SQL + f", {TAGGED}, {TAG_LONG}, p AS (SELECT theme, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM tg WHERE answered), 1) AS pct FROM tl GROUP BY 1), m AS (SELECT item, round(avg(value), 6) AS mean FROM {LONG('survey')} GROUP BY 1), j AS (SELECT m.item, l.theme, mean, coalesce(pct, 0) AS pct FROM m JOIN (VALUES {', '.join(str(x) for x in PROMPTS)}) AS l(item, theme) ON m.item = l.item LEFT JOIN p ON p.theme = l.theme), r AS (SELECT *, trunc(rank() OVER (ORDER BY mean DESC) + (count(*) OVER (PARTITION BY mean) - 1) / 2.0)::INT AS prompted_rank, trunc(rank() OVER (ORDER BY pct DESC) + (count(*) OVER (PARTITION BY pct) - 1) / 2.0)::INT AS volunteered_rank FROM j) SELECT *, prompted_rank - volunteered_rank AS gap FROM r")
def rank_gap(spark, sf_dir):
    prompted = describe.item_descriptives(survey(spark, sf_dir), ITEM_NAMES).select("item", "mean")
    return text.prompted_vs_volunteered(prompted, text.prevalence(tagged_documents(spark, sf_dir)), PROMPTS)


@query(SURVEY_SQL + ", o AS (SELECT row_id, living, row_number() OVER (PARTITION BY living ORDER BY md5('42:' || row_id), row_id) AS k, count(*) OVER (PARTITION BY living) AS n FROM survey) SELECT row_id, living, CASE WHEN k <= round(n * 0.3::DOUBLE) THEN 'holdout' ELSE 'train' END AS split FROM o")
def stratified_split(spark, sf_dir):
    return features.split_holdout(survey(spark, sf_dir), "living").select("row_id", "living", "split")


@query(SURVEY_SQL + ", o AS (SELECT cluster, row_number() OVER (PARTITION BY living ORDER BY md5('42:' || row_id), row_id) <= round(count(*) OVER (PARTITION BY living) * 0.3::DOUBLE) AS h FROM lab), p AS (SELECT cluster, count(*) FILTER (h) AS o, count(*) FILTER (NOT h) AS t FROM o GROUP BY 1), e AS (SELECT *, t * (SELECT sum(o) FROM p)::DOUBLE / (SELECT sum(t) FROM p) AS e FROM p) SELECT count(*)::BIGINT - 1 AS dof, round(sum((o - e) ** 2 / e), 6) AS chi2 FROM e")
def holdout_gof(spark, sf_dir):
    split = features.split_holdout(labelled(spark, sf_dir), "living")
    per = split.groupBy("cluster").agg(F.count_if(F.col("split") == "holdout").alias("o"), F.count_if(F.col("split") == "train").alias("t"))
    sums = per.agg(F.sum("o").alias("_o"), F.sum("t").alias("_t"))
    expected = F.col("t") * F.col("_o") / F.col("_t")
    return features.with_row(per, sums).agg((F.count("*") - 1).alias("dof"), rounded(F.sum(F.pow(F.col("o") - expected, 2) / expected)).alias("chi2"))


@query(f"WITH {EMB}, d AS (SELECT item, round(var_pop(value), 9) AS eigenvalue FROM vl GROUP BY 1), v AS (SELECT row_number() OVER (ORDER BY eigenvalue DESC, item)::INT AS pc, eigenvalue FROM d), c AS (SELECT pc, eigenvalue, round(eigenvalue / sum(eigenvalue) OVER (), 6) AS share, round(sum(eigenvalue) OVER (ORDER BY pc) / sum(eigenvalue) OVER (), 6) AS cumulative FROM v) SELECT *, pc = (SELECT min(pc) FROM c WHERE cumulative >= 0.95) AS reaches FROM c")
def explained_variance(spark, sf_dir):
    """The axes of a diagonal covariance are the columns, its eigenvalues their variances."""
    df, cols = vectors(spark, sf_dir)
    spread = describe.unpivot(df, [], cols).groupBy("item").agg(rounded(F.var_pop("value"), 9).alias("eigenvalue"))
    ranked = spread.select(F.row_number().over(W.orderBy(F.desc("eigenvalue"), "item")).alias("pc"), "eigenvalue")  # one row per column
    return select.explained(ranked)


@query("WITH q AS (SELECT quantile_cont(n_chars::DOUBLE, [0.25, 0.5, 0.75]) AS e FROM documents) SELECT doc_id, CASE WHEN n_chars <= e[1] THEN 'q1' WHEN n_chars <= e[2] THEN 'q2' WHEN n_chars <= e[3] THEN 'q3' ELSE 'q4' END AS bin FROM documents, q")
def length_bins(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    return features.quantile_cut(docs, "n_chars", [0.25, 0.5, 0.75], ["q1", "q2", "q3", "q4"], "bin").select("doc_id", "bin")


@query(SURVEY_SQL + " SELECT row_id, band, " + ", ".join(f"(living = '{v}')::INT AS living_{v}" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + ", (gender = 'even')::INT AS gender_even, (gender = 'odd')::INT AS gender_odd FROM survey")
def encode_background(spark, sf_dir):
    return features.encode_background(survey(spark, sf_dir), ["living", "gender", "department"], ["band", "year"], exclude=("department", "year"))


@query(SURVEY_SQL + f", s AS (SELECT {', '.join(f'({chr(32) + (chr(32) + chr(43) + chr(32)).join(c)}) / {float(len(c))}::DOUBLE AS {n}' for n, c in SUBSCALES.items())} FROM aligned) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM s" for i, a in enumerate(SUBSCALES) for b in list(SUBSCALES)[i + 1 :]))
def subscale_correlations(spark, sf_dir):
    return measure.correlations_long(features.subscales(aligned(spark, sf_dir), SUBSCALES), list(SUBSCALES))


@query(SURVEY_SQL + f", r AS (SELECT rank() OVER (ORDER BY {SUM}) + (count(*) OVER (PARTITION BY {SUM}) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY band) + (count(*) OVER (PARTITION BY band) - 1) / 2.0::DOUBLE AS b FROM aligned) SELECT round(corr(a, b), 6) AS r, count(*)::BIGINT AS n FROM r")
def spearman(spark, sf_dir):
    found = associate.correlation(aligned(spark, sf_dir).withColumn("strain", total(ITEM_NAMES)), "strain", "band", ranks=True)
    return spark.createDataFrame([(round(found["r"], 6), found["n"])], "r double, n long")


@query(SURVEY_SQL + f", {TAGGED}, b AS (SELECT ({SUM}) / 12.0::DOUBLE AS v, tg.* FROM aligned JOIN tg USING (row_id) WHERE answered), l AS (SELECT v, theme, x FROM b UNPIVOT (x FOR theme IN ({', '.join(TOPICS)}))), s AS (SELECT theme, count(*) FILTER (x = 1) AS n1, count(*) FILTER (x = 0) AS n0, avg(v) FILTER (x = 1) AS m1, avg(v) FILTER (x = 0) AS m0, var_samp(v) FILTER (x = 1) AS v1, var_samp(v) FILTER (x = 0) AS v0 FROM l GROUP BY 1) SELECT theme, n1, n0, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round((v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)), 6) AS dof, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS d FROM s WHERE n1 >= 20 AND n0 > 1")
def theme_strain(spark, sf_dir):
    strain = aligned(spark, sf_dir).select("row_id", row_mean(ITEM_NAMES).alias("strain"))
    return text.theme_strain(tagged_documents(spark, sf_dir).join(strain, "row_id"), "strain", list(TOPICS))


@query(SURVEY_SQL + f", x AS (SELECT ({SUM}) / 12.0::DOUBLE AS v, (coalesce(trim(text), '') <> '')::INT AS a FROM aligned LEFT JOIN documents ON doc_id = row_id), s AS (SELECT count(*) FILTER (a = 1) AS n1, count(*) FILTER (a = 0) AS n0, avg(v) FILTER (a = 1) AS m1, avg(v) FILTER (a = 0) AS m0, var_samp(v) FILTER (a = 1) AS v1, var_samp(v) FILTER (a = 0) AS v0 FROM x) SELECT n1, n0, round(m1, 6) AS mean1, round(m0, 6) AS mean0, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round((v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)), 6) AS dof, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS d FROM s")
def answered_vs_skipped(spark, sf_dir):
    from cohortry.functions.expressions import answered

    both = aligned(spark, sf_dir).join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text"), "row_id", "left")
    return associate.welch(both.select(row_mean(ITEM_NAMES).alias("strain"), answered(F.col("text")).cast("int").alias("answered")), "answered", "strain")


@query(f"WITH {TAGGED}, t AS (SELECT row_id, coalesce(list_min([{', '.join(f'CASE WHEN answered AND {k} = 1 THEN ' + chr(39) + k + chr(39) + ' END' for k in TOPICS)}]), 'none') AS theme FROM tg), b AS (SELECT label, theme FROM embeddings JOIN t ON vec_id = row_id), c AS (SELECT label AS a, theme AS b, count(*)::DOUBLE AS n FROM b GROUP BY ALL), r AS (SELECT a, sum(n) AS n, max(n) AS m FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS n FROM c GROUP BY 1), o AS (SELECT (SELECT sum(n) FROM c) AS t, (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(n * (n - 1) / 2) FROM r) AS i, (SELECT sum(n * (n - 1) / 2) FROM k) AS j, (SELECT sum(m) FROM r) AS major, (SELECT max(n) FROM k) AS base, (SELECT -sum(n / t * ln(n / t)) FROM r, (SELECT sum(n) AS t FROM c)) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM k, (SELECT sum(n) AS t FROM c)) AS hb, (SELECT -sum(n / t * ln(n / t)) FROM c, (SELECT sum(n) AS t FROM c)) AS hab) SELECT t::BIGINT AS n, round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 6) AS ari, round(2 * (ha + hb - hab) / (ha + hb), 6) AS nmi, round(major / t, 6) AS majority_accuracy, round(base / t, 6) AS baseline FROM o")
def embedding_theme_agreement(spark, sf_dir):
    themes = text.dominant_theme(tagged_documents(spark, sf_dir))
    both = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label").join(themes, "row_id")
    return associate.agreement(both, "label", "theme")


@query(SURVEY_SQL + " " + " UNION ALL ".join("(WITH " + _chi2("lab", v, "cluster").replace("SELECT t::BIGINT AS n", f"SELECT '{v}' AS variable, t::BIGINT AS n") + ")" for v in ("year", "gender", "living", "backlog")))
def external_validation(spark, sf_dir):
    df = labelled(spark, sf_dir)
    parts = [associate.chi2_cells(df, v, "cluster").select(F.lit(v).alias("variable"), "*") for v in ("year", "gender", "living", "backlog")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query(f'WITH a AS ({ORACLE_SQL["quality_audit"]}), s AS ({ORACLE_SQL["response_style"]}), t AS (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM (SELECT * FROM a, s)) SELECT "check", value FROM t UNPIVOT INCLUDE NULLS (value FOR "check" IN (COLUMNS(*)))')
def quality_table(spark, sf_dir):
    audit = describe.audit_quality(read(spark, sf_dir, "events"), ["event_type", "user_id"], ["value"], ["props"], "ts")
    return describe.quality_table(audit, describe.response_style(survey(spark, sf_dir), ITEM_NAMES))


# Fits and resampling: no SQL expresses them. Tests hold them against properties and small cases.


@query()
def kmeans_k3(spark, sf_dir):
    from cohortry.operators.resample import fit

    df, cols = vectors(spark, sf_dir)
    return validity.nearest_centroid(df, cols, fit(df, cols, 3, 25).tolist()).select("row_id", "cluster")


@query()
def algorithm_sweep(spark, sf_dir):
    from cohortry.operators.sweep import sweep

    df, cols = vectors(spark, sf_dir)
    return sweep(df.select("row_id", *cols), cols)


@query()
def bootstrap_ari(spark, sf_dir):
    from cohortry.operators.resample import bootstrap

    df, cols = vectors(spark, sf_dir)
    return bootstrap(df, cols, range(2, 9))


@query()
def gap_statistic(spark, sf_dir):
    from cohortry.operators.resample import gap

    df, cols = vectors(spark, sf_dir)
    return gap(df, cols)


@query()
def cross_algorithm_ari(spark, sf_dir):
    from cohortry.operators.sweep import cross_algorithm as cross

    df, cols = vectors(spark, sf_dir)
    return cross(df.select("row_id", *cols), cols, [3])


@query()
def em_automatic_k(spark, sf_dir):
    from cohortry.operators.mixture import automatic_k

    df, cols = vectors(spark, sf_dir)
    return automatic_k(df, cols)


@query()
def hierarchy_report(spark, sf_dir):
    from cohortry.operators.agglomerate import hierarchy

    df, cols = vectors(spark, sf_dir)
    return hierarchy(df, cols)


@query()
def ward_clusters(spark, sf_dir):
    from cohortry.operators.agglomerate import agglomerate

    df, cols = vectors(spark, sf_dir)
    return agglomerate(df, cols, 3)


@query()
def spectral_clusters(spark, sf_dir):
    from cohortry.operators.neighbours import spectral

    df, cols = vectors(spark, sf_dir)
    return spectral(df, cols, 3)


@query()
def density_clusters(spark, sf_dir):
    from cohortry.operators.density import density_clusters as found

    df, cols = vectors(spark, sf_dir)
    return found(df, cols)


@query()
def gower_medoids(spark, sf_dir):
    from cohortry.operators.medoid import medoids

    return medoids(survey(spark, sf_dir), ["year", "band"], ["living", "department"], range(2, 9))[1]


@query()
def parallel_analysis(spark, sf_dir):
    from cohortry.operators.stability import parallel_analysis as horn

    cov, n = measure.covariance(aligned(spark, sf_dir), ITEM_NAMES)
    return horn(spark, n, len(ITEM_NAMES), list(measure.pca(measure.correlation_of(cov))["eigenvalues"]))


@query()
def factor_loadings(spark, sf_dir):
    cov, _ = measure.covariance(aligned(spark, sf_dir), ITEM_NAMES)
    f = measure.efa(measure.correlation_of(cov), 3)
    rows = [(i, *map(float, row), float(c), int(a)) for i, row, c, a in zip(ITEM_NAMES, f["loadings"], f["communality"], f["assigned"], strict=True)]
    return spark.createDataFrame(rows, "item string, f1 double, f2 double, f3 double, communality double, assigned int")


@query()
def tree_rules(spark, sf_dir):
    from cohortry.operators.supervised import tree_rules as rules

    return spark.createDataFrame(rules(labelled(spark, sf_dir), ITEM_NAMES, "cluster"), "rule string, label double, n long, purity_pct double")


@query(f"""WITH z AS ({ORACLE_SQL["z_profile"]}), st AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, item) AS k FROM z WHERE abs(z) >= 0.35),
t AS (SELECT cluster, string_agg(CASE WHEN z > 0 THEN 'high ' ELSE 'low ' END || item, ' & ' ORDER BY k) AS name, string_agg(item || CASE WHEN z > 0 THEN ' high' ELSE ' low' END, ', ' ORDER BY k) AS defining FROM st WHERE k <= 3 GROUP BY 1),
n AS (SELECT cluster, coalesce(name, 'Average profile') AS name, coalesce(defining, '') AS defining FROM (SELECT DISTINCT cluster FROM z) LEFT JOIN t USING (cluster))
SELECT cluster, CASE WHEN k > 1 THEN name || ' (' || k || ')' ELSE name END AS persona, defining FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY cluster) AS k FROM n)""")
def persona_names(spark, sf_dir):
    from cohortry.operators.naming import persona_names as names

    return names(describe.z_profile(labelled(spark, sf_dir), ITEM_NAMES), {i: (f"low {i}", f"high {i}") for i in ITEM_NAMES})


@query()
def lda_topics(spark, sf_dir):
    from cohortry.operators.topics import lda, term_counts

    counted, terms = term_counts(read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id"), "text")
    found, perplexity = lda(counted, terms)
    return spark.createDataFrame([{**topic, "perplexity": perplexity} for topic in found], "topic int, terms array<string>, share double, perplexity double")
