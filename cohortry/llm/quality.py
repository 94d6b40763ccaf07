"""Quality rules: a threshold table compiled into one Spark projection.

The table is data (:data:`RULES`); :func:`verdict` turns it into one boolean expression, and the measures
it names are built-in expressions over the row, so a scan evaluates everything without a shuffle or a
user function. Nulls: a null text has no words and fails. Repeated rows get equal results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import text_or_empty, word_array

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it not of on or she that the they this to was we were which with you "
    "als auch auf aus bei das dem den der des die ein eine einer er es für hat ich im in ist mit nicht sich sie sind und von war wie zu zum "
    "au aux avec ce dans de des du elle en est et il je la le les mais ne ou par pas pour qui que se son sur un une vous "
    "al como con de del el en es la las lo los más no para pero por que se su sus un una y"
).split()

#: (measure, least, most); None: no bound.
RULES = (
    ("n_words", 50, 1_000_000),
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_ratio", None, 0.2),
    ("stop_ratio", 0.05, None),
    ("dup_line_ratio", None, 0.5),
    ("repeat_ratio", None, 0.5),
    ("lines_per_word", None, 0.5),
)


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns (passed through) plus, under ``_`` names, counts and ratios of each whole text."""
    kept = [docs[c] for c in keep]
    names = list(keep)
    text = docs.select(*kept, text_or_empty(docs).alias("_text"))
    split = text.select(*names, "_text", word_array(F.col("_text")).alias("_words"), F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    # windows of three words, by hash; get() is null past the end
    hashed = split.select(
        *names,
        F.size("_words").cast("long").alias("_n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("_word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long").alias("_n_symbols"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        F.size(F.filter("_words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:"))).isin(*STOP_WORDS))).cast("long").alias("_n_stop"),
        F.when(F.size("_words") > 2, F.slice(F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))), F.lit(1), F.size("_words") - 2)).alias("_windows"),
    )
    counted = [c for c in hashed.columns if c != "_windows"]
    # sorted only where some window repeats
    ordered = hashed.select(*counted, F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"))
    twice = ordered.select(*counted, F.sort_array(F.transform(F.filter("_sorted", lambda x, k: F.coalesce(x["h"] == F.get("_sorted", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_sorted", k + 1)["h"], F.lit(False))), lambda x: x["i"])).alias("_at"))
    covered = F.aggregate(F.transform("_at", lambda v, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - v, F.lit(3)))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    out = twice.select(*counted, F.coalesce(covered, F.lit(0)).cast("long").alias("_n_repeat_words"))
    n = F.greatest(F.col("_n_words"), F.lit(1))
    ratios = {"mean_word_chars": "_word_chars", "symbol_ratio": "_n_symbols", "stop_ratio": "_n_stop", "repeat_ratio": "_n_repeat_words", "lines_per_word": "_n_lines"}
    return out.withColumns({f"_{k}": F.col(v) / n for k, v in ratios.items()} | {"_dup_line_ratio": F.col("_n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1))})


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean expression over :func:`measures`."""
    tests = []
    for measure, least, most in rules:
        tests += [F.col(f"_{measure}") >= F.lit(least)] * (least is not None) + [F.col(f"_{measure}") <= F.lit(most)] * (most is not None)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def base_failed() -> Column:
    return (F.col("_n_words") < 50) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words"))


def assess(docs: DataFrame, rules=RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: ``keep``, the counts, ``base_failed`` and ``kept``."""
    m = measures(docs, keep)
    counts = [F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return m.select(*keep, *counts, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with the same columns."""
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[docs[c].alias(n) for c, n in names.items()])
    source = renamed.withColumn("text", F.col(names["text"]))
    judged = measures(source, tuple(names.values())).select(*names.values(), (~base_failed() & verdict(rules)).alias("_kept"), F.monotonically_increasing_id().alias("_row"))
    # the filter reads _row, so that it stays above the projection: pushed below, it would compute the measures once more
    return judged.filter((F.col("_row") >= 0) & F.col("_kept")).select(*[F.col(n).alias(c) for c, n in names.items()])


_LIST = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM s),
tri2 AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM tri),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri2) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT s.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             len(list_filter(w, lambda x: lower(rtrim(x, '.,;:')) IN ({_LIST})))::BIGINT AS n_stop,
             coalesce(r, 0)::BIGINT AS n_repeat_words
      FROM s LEFT JOIN rep USING (doc_id)),
q AS (SELECT *, greatest(n_words, 1) AS n, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND n_words BETWEEN 50 AND 1000000 AND word_chars / n BETWEEN 2.0 AND 12.0 AND n_symbols / n <= 0.2
        AND n_stop / n >= 0.05 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_repeat_words / n <= 0.5 AND n_lines / n <= 0.5) AS kept
FROM q
"""
