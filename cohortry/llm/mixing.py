"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source size copies. In an order that runs through the sizes, the
expected copies are summed, one random offset per source is added, and a document is emitted once for each
integer boundary that its own stretch crosses. Ranks come from counts per cell (source, size level, part of a
hash), so that neither a hot source nor a hot size meets in one task. Sizes are staged once in the shared folder.

Null text: size 0. Null source: a source of its own, last. Equal rows are copies that are ranked one after the
other. A source without words has target 0 and is not taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.llm.common import SPACE_RUN, row_mark, stage, text_or_empty

WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, SPACE_RUN), "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Per ``_source``: size, target. One row per source; the weights repeat over sources by code point, null last.

    A target stops at ``most`` times its source; the excess is shared again by weight. The sources in order of
    most * size / weight fill up first, so the level that the others reach follows from running sums.
    """
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last())) - 1
    per = per.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    order = W.orderBy(most * F.col("source_size") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    per = per.select("*", (share * F.sum("source_size").over(everything)).alias("_total"), F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0)).alias("_full"), (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))).alias("_open"))
    # the level of the others if all before this one are full: it rises until the first source that stays below, then falls
    per = per.withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open"))
    level = F.max("_level").over(everything)
    return per.select("_source", "source_size", F.round(F.least(level * F.col("_weight"), most * F.col("source_size")), 6).alias("target"))


def _level(size: Column) -> Column:
    """A number that grows with the size, about eight levels to a doubling."""
    bits = F.length(F.bin(size))
    return (bits * 16 + F.expr("shiftright(_size, greatest(length(bin(_size)) - 4, 0))")).cast("long")


def _uniform(text: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def copies(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: float = 3.0, seed: int = 7, rows_per_cell: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, and ``_mark``, a hash of the row."""
    text = text_or_empty(docs)
    rows = stage(docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("_source"), n_words(text).alias("_size"), row_mark(docs).alias("_mark")), "mix-sizes")
    n = rows.count()
    salts = max(1, math.ceil(n / rows_per_cell))
    name = F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n"))  # null-safe key; null gets its own
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("_name", name).withColumn("_level", _level(F.col("_size"))).withColumn("_order", F.md5(key.cast("binary")))
    rows = rows.withColumn("_salt", F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % salts)
    cells = rows.groupBy("_name", "_level", "_salt").agg(F.count("*").alias("_n"))
    levels = cells.groupBy("_name", "_level").agg(F.sum("_n").alias("_n"))
    above = levels.select("_name", "_level", (F.sum("_n").over(W.partitionBy("_name").orderBy("_level")) - F.col("_n")).alias("_before"))
    within = cells.select("_name", "_level", "_salt", (F.sum("_n").over(W.partitionBy("_name", "_level").orderBy("_salt")) - F.col("_n")).alias("_inside"))
    begin = within.join(above, ["_name", "_level"]).select("_name", "_level", "_salt", (F.col("_before") + F.col("_inside")).alias("_begin"))
    goal = targets(rows, weights, share, most).withColumn("_name", name)
    goal = goal.select("_name", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate"), (_uniform(F.concat(F.lit(f"{seed}:"), "_name").cast("binary"), 5) / 1048576.0).alias("_offset"))
    place = F.row_number().over(W.partitionBy("_name", "_level", "_salt").orderBy("_size", "_order", "_mark"))
    ranked = rows.withColumn("_place", place).join(begin, ["_name", "_level", "_salt"]).join(goal, "_name")
    rank = F.col("_begin") + F.col("_place")
    crossed = F.floor(rank * F.col("_rate") + F.col("_offset")) - F.floor((rank - 1) * F.col("_rate") + F.col("_offset"))
    return ranked.select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.least(crossed, F.lit(math.ceil(most))).cast("long").alias("copies"), "_mark")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The mixture: rows of ``docs``, each as often as it is emitted.

    Null ids, texts and sources are as in :func:`copies`. Rows of one id are told apart by all their columns; rows equal in all
    of them share what they were given, so reruns emit the same rows.
    """
    names = [f"_in{i}" for i in range(len(docs.columns))]
    taken = copies(docs, **parameters).groupBy("doc_id", "_mark").agg(F.sum("copies").alias("_all"), F.count("*").alias("_rows"))
    # equal rows share what they were given: the first ones take one more
    left = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)], docs["doc_id"].alias("_id"), row_mark(docs).alias("_mark"))
    met = left.join(taken.withColumnRenamed("_mark", "_mark2"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_mark") == F.col("_mark2")))
    alone = met.filter("_rows = 1").withColumn("_times", F.col("_all"))
    shared = met.filter("_rows > 1").withColumn("_k", F.row_number().over(W.partitionBy("_id", "_mark").orderBy(F.lit(0)))).withColumn("_times", F.floor(F.col("_all") / F.col("_rows")) + (F.col("_k") <= F.col("_all") % F.col("_rows")).cast("long")).drop("_k")
    return _emit(alone.unionByName(shared), docs.columns, names)


def _emit(rows: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    return rows.filter("_times > 0").withColumn("_again", F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int")))).select(*[F.col(n).alias(c) for c, n in zip(columns, names, strict=True)])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS name,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('7:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
c AS (SELECT greatest(1, ceil(count(*) / 20000.0))::BIGINT AS salts FROM d),
p0 AS (SELECT source, name, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
p1 AS (SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w FROM p0),
p2 AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
              coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f,
              sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS op FROM p1),
p3 AS (SELECT *, (total - f) / op AS lv FROM p2),
p4 AS (SELECT *, max(lv) OVER () AS level FROM p3),
p AS (SELECT name, source_size, round(least(level * w, 3.0::DOUBLE * source_size), 6) AS target FROM p4),
r AS (SELECT d.*, row_number() OVER (PARTITION BY name ORDER BY
        length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)), ('0x' || o[1:8])::BIGINT % salts, size, o) AS k FROM d, c),
x AS (SELECT r.doc_id, r.size, p.source_size, p.target, k, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS rate,
             ('0x' || md5('7:' || r.name)[1:5])::BIGINT / 1048576.0::DOUBLE AS u FROM r JOIN p USING (name))
SELECT doc_id, size, source_size, target, (size * least(floor(k * rate + u) - floor((k - 1) * rate + u), 3))::BIGINT AS taken FROM x
"""
