"""Free text: multi-label themes by regular expressions, scripts, coverage, and tests of themes against groups."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.functions.expressions import answered, rounded
from cohortry.operators.associate import chi2_cells

#: Characters that a word may hold: a term is matched between others. Combining marks count as word characters.
_EDGE = r"[^\p{L}\p{M}\p{N}_]"
#: The default dictionary: theme to terms (regular expressions without groups). Callers bring their own for other surveys.
THEMES = {
    "workload": ("workload", "deadlines?", "assignments?", "homework", "overload(?:ed)?", "travail", "arbeit"),
    "exams": ("exams?", "tests?", "quiz(?:zes)?", "grades?", "prüfung(?:en)?", "examens?"),
    "time": ("time", "schedule", "hours?", "zeit", "temps", "tiempo"),
    "sleep": ("sleep", "tired", "insomnia", "schlaf", "sommeil"),
    "money": ("money", "fees?", "costs?", "rent", "geld", "argent", "dinero"),
    "family": ("family", "parents?", "home", "familie", "famille", "familia"),
    "friends": ("friends?", "lonel(?:y|iness)", "social", "freunde", "amis", "amigos"),
    "health": ("health", "ill(?:ness)?", "sick", "food", "gesundheit", "santé", "salud"),
    "future": ("future", "jobs?", "careers?", "zukunft", "avenir", "futuro"),
    "teaching": ("teachers?", "lectures?", "feedback", "courses?", "kurse?", "cours"),
    "housing": ("rooms?", "hostel", "flat", "noise", "wohnung", "logement"),
    "travel": ("commut(?:e|ing)", "bus(?:es)?", "traffic", "train"),
    "motivation": ("motivation", "focus", "bor(?:ed|ing)", "lazy"),
}


def theme_pattern(terms: tuple[str, ...] | list[str]) -> str:
    return f"(?iu)(?:^|{_EDGE})(?:{'|'.join(terms)})(?:{_EDGE}|$)"


def fingerprint(themes: dict[str, tuple[str, ...]]) -> str:
    """16 hex digits that change with any pattern."""
    return hashlib.sha256(json.dumps({k: list(v) for k, v in sorted(themes.items())}, ensure_ascii=False).encode()).hexdigest()[:16]


def patterns_table(spark: SparkSession, themes: dict[str, tuple[str, ...]]) -> DataFrame:
    return spark.createDataFrame([(k, len(v), " | ".join(v)) for k, v in themes.items()], "theme string, n_patterns int, patterns string")


def tag(df: DataFrame, col: str, themes: dict[str, tuple[str, ...]] = THEMES) -> DataFrame:
    """Adds ``answered`` and ``themes``, the array of those that fire. One literal pattern per theme, so each is compiled once."""
    fired = F.array_compact(F.array(*[F.when(F.col(col).rlike(theme_pattern(t)), name) for name, t in themes.items()]))
    return df.withColumn("answered", answered(F.col(col))).withColumn("themes", F.when(F.col("answered"), fired).otherwise(F.array().cast("array<string>")))


def probes(df: DataFrame, col: str, patterns: dict[str, str]) -> DataFrame:
    """A 0/1 column for each probe; patterns may look ahead."""
    return df.withColumns({name: F.coalesce(F.col(col).rlike(p).cast("int"), F.lit(0)) for name, p in patterns.items()})


def _with_mark(themes: Column) -> Column:
    """A null ahead of the themes, so that rows are counted along with them in one pass: patterns run once per text."""
    return F.explode(F.concat(F.array(F.lit(None).cast("string")), themes)).alias("theme")


def _of_rows(n: str, *group: str) -> Column:
    """The count of the null mark, over aggregates with one row per theme."""
    return F.max(F.when(F.col("theme").isNull(), F.col(n))).over(W.partitionBy(*group))


def prevalence(tagged: DataFrame) -> DataFrame:
    """theme, n, pct of the answered."""
    per = tagged.filter("answered").select(_with_mark(F.col("themes"))).groupBy("theme").agg(F.count("*").alias("n"))
    return per.withColumn("_all", _of_rows("n")).filter("theme IS NOT NULL").select("theme", "n", rounded(100.0 * F.col("n") / F.col("_all"), 1).alias("pct"))


def coverage(tagged: DataFrame) -> DataFrame:
    size = F.size("themes")
    return tagged.filter("answered").agg(F.count("*").alias("n_answered"), rounded(100.0 * F.avg((size > 0).cast("double"))).alias("pct_tagged"), rounded(F.avg(size)).alias("mean_themes"), rounded(100.0 * F.avg((size > 1).cast("double"))).alias("pct_multi"), F.count_if(size == 0).alias("n_untagged"))


def untagged(tagged: DataFrame, col: str, limit: int = 20, key: str = "row_id") -> DataFrame:
    """The first answers that no theme caught: a report, hence the limit."""
    return tagged.filter("answered AND size(themes) = 0").select(key, col).orderBy(key).limit(limit)


def script_of(col: str, other: str = r"\p{IsBengali}"):
    """latin, other or mixed; a text without letters is latin."""
    c = F.col(col)
    return F.when(c.rlike(other) & c.rlike(r"\p{IsLatin}"), "mixed").when(c.rlike(other), "other").otherwise("latin")


def text_profile(df: DataFrame, col: str, cues: tuple[str, ...] = ()) -> DataFrame:
    """Responses, words, characters, short and long answers, scripts, cue hits, distinct answers: one row."""
    words = F.size(F.regexp_extract_all(F.col(col), F.lit(r"([^ \t\n\x0B\f\r]+)"), 1))
    has_cue = reduce(lambda a, b: a | b, [F.lower(F.col(col)).contains(c) for c in cues], F.lit(False))
    rows = df.select(F.col(col), answered(F.col(col)).alias("_a"))
    done = rows.select("_a", *[F.when(F.col("_a"), v).alias(n) for n, v in (("w", words), ("c", F.length(col)), ("s", script_of(col)), ("q", has_cue), ("t", F.xxhash64(F.lower(F.trim(col)))))])
    share = lambda c: rounded(100.0 * F.avg(c.cast("double")))
    return done.agg(F.count("*").alias("n_rows"), F.count_if("_a").alias("n_answered"), share(F.col("_a")).alias("pct_answered"), rounded(F.avg("w")).alias("mean_words"), F.percentile("w", 0.5).alias("median_words"), F.max("w").alias("max_words"), rounded(F.avg("c")).alias("mean_chars"), share(F.col("w") <= 2).alias("pct_short"), share(F.col("w") >= 10).alias("pct_long"), F.count_if(F.col("s") == "latin").alias("n_latin"), F.count_if(F.col("s") == "other").alias("n_other"), F.count_if(F.col("s") == "mixed").alias("n_mixed"), F.count_if("q").alias("n_cue"), F.count_distinct("t").alias("n_distinct"))


def theme_by_group(tagged: DataFrame, group: str, least: int = 20) -> DataFrame:
    """group, theme, n answered, pct; groups under ``least`` are left out."""
    rows = tagged.filter(F.col("answered") & F.col(group).isNotNull()).select(F.col(group).alias("_g"), _with_mark(F.col("themes")))
    per = rows.groupBy("_g", "theme").agg(F.count("*").alias("hits")).withColumn("n", _of_rows("hits", "_g"))
    return per.filter((F.col("n") >= least) & F.col("theme").isNotNull()).select(F.col("_g").alias("group"), "theme", "n", rounded(100.0 * F.col("hits") / F.col("n")).alias("pct"))


def theme_tests(tagged: DataFrame, group: str, themes: list[str], alpha: float = 0.05) -> list[dict]:
    """Per theme: chi2 against the group among the answered, p, V, whether it passes at alpha / themes, and the group where it peaks. A theme that all or none have is left out."""
    from cohortry.functions.special import chi2_sf

    flags = tagged.filter("answered").select(F.col(group).alias("_g"), *[F.array_contains("themes", t).cast("int").alias(f"t{i}") for i, t in enumerate(themes)]).cache()
    peaks = {r[0]: r[1] for r in theme_by_group(tagged, group, 1).groupBy("theme").agg(F.max_by("group", F.struct("pct", F.col("group").cast("string")))).collect()}
    out = []
    for i, t in enumerate(themes):
        r = chi2_cells(flags, f"t{i}", "_g").first()
        if r and r["r"] == 2 and r["dof"]:
            p = chi2_sf(r["chi2"], r["dof"])
            out.append({"theme": t, "chi2": r["chi2"], "dof": r["dof"], "p": p, "cramers_v": r["cramers_v"], "significant": p < alpha / len(themes), "peak": peaks.get(t)})
    flags.unpersist()
    return out


def paired_shift(first: DataFrame, second: DataFrame, key: str = "row_id") -> DataFrame:
    """Two tagged questions of the same rows, both answered: per theme the shares before and after, gained and dropped."""
    a = first.filter("answered").select(key, F.col("themes").alias("a"))
    b = second.filter("answered").select(key, F.col("themes").alias("b"))
    both = a.join(b, key)
    per = both.select(_with_mark(F.array_union("a", "b")), "a", "b").groupBy("theme").agg(F.count("*").alias("_rows"), F.count_if(F.array_contains("a", F.col("theme"))).alias("before"), F.count_if(F.array_contains("b", F.col("theme"))).alias("after"), F.count_if(~F.array_contains("a", F.col("theme"))).alias("gained"), F.count_if(~F.array_contains("b", F.col("theme"))).alias("dropped"))
    return per.withColumn("n", _of_rows("_rows")).filter("theme IS NOT NULL").select("theme", "n", rounded(100.0 * F.col("before") / F.col("n")).alias("pct_before"), rounded(100.0 * F.col("after") / F.col("n")).alias("pct_after"), "gained", "dropped")


def prompted_vs_volunteered(prompted: DataFrame, themes: DataFrame, mapping: list[tuple[str, str]]) -> DataFrame:
    """prompted: item, mean. themes: theme, pct. ``mapping``: item to theme. Average ranks of both, cut to int, and their gap; a theme nobody named has 0."""
    links = prompted.sparkSession.createDataFrame(mapping, "item string, theme string")
    both = prompted.join(F.broadcast(links), "item").join(themes.select("theme", "pct"), "theme", "left").fillna(0.0, ["pct"])
    rank = lambda c: (F.rank().over(W.orderBy(F.desc(c))) + (F.count("*").over(W.partitionBy(c)) - 1) / 2.0).cast("int")
    return both.select("item", "theme", "mean", "pct", rank("mean").alias("prompted_rank"), rank("pct").alias("volunteered_rank")).withColumn("gap", F.col("prompted_rank") - F.col("volunteered_rank"))


def document_frequency(df: DataFrame, col: str, least: int = 1, pattern: str = r"[\p{L}]{3,}") -> DataFrame:
    """term, df: rows in which a lower-cased term stands."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(F.col(col)), F.lit(f"({pattern})"), 1))
    return df.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= least)


def theme_strain(tagged: DataFrame, strain: str, themes: list[str], least: int = 20) -> DataFrame:
    """Per theme with at least ``least`` answered rows that have it: Welch's t of strain with against without, degrees of freedom, Cohen's d. One pass over rows times themes."""
    rows = tagged.filter("answered").select(F.col(strain).cast("double").alias("v"), F.explode(F.array(*[F.struct(F.lit(t).alias("theme"), F.array_contains("themes", t).alias("on")) for t in themes])).alias("x"))
    side = lambda f, on: f(F.when(F.col("x.on") == on, F.col("v")))
    s = rows.groupBy("x.theme").agg(*[side(f, on).alias(f"{k}{int(on)}") for on in (True, False) for k, f in (("n", F.count), ("m", F.avg), ("s", F.var_samp))]).filter((F.col("n1") >= least) & (F.col("n0") > 1))
    a, b = F.col("s1") / F.col("n1"), F.col("s0") / F.col("n0")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("s1") + (F.col("n0") - 1) * F.col("s0")) / (F.col("n1") + F.col("n0") - 2))
    return s.select("theme", "n1", "n0", rounded((F.col("m1") - F.col("m0")) / F.sqrt(a + b)).alias("t"), rounded(F.pow(a + b, 2) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))).alias("dof"), rounded((F.col("m1") - F.col("m0")) / pooled).alias("d"))


def dominant_theme(tagged: DataFrame, key: str = "row_id", none: str = "none") -> DataFrame:
    """key, theme: of the themes of a row, the first by name; for agreement with clusters of its embedding."""
    return tagged.select(key, F.coalesce(F.array_min("themes"), F.lit(none)).alias("theme"))
