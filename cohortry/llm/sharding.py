"""Sharding by proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; (2 * rank - 1) / (2 * rows of the source) is their
fractional rank. In the order of fractional ranks every stretch holds the sources in the mixture's proportions,
so equal cuts give shards that match it, with row counts at most one apart. Ranks are made from counts per cell
of the hash, and the global order from counts per bucket of the fractional rank, which is uniform whatever the
sources' sizes: no source and no bucket meets in one task.

Null source: a source of its own. Null text: no bytes. Equal rows are ranked one after the other.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.llm.common import stage, text_or_empty


def interleave(docs: DataFrame, shards: int = 40, seed: int = 11, rows_per_cell: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes and 16), text_crc32, shard, slot."""
    n = docs.count()
    cells = max(1, math.ceil(n / rows_per_cell))
    text = text_or_empty(docs)
    name = F.coalesce(F.concat(F.lit("s"), docs["source"]), F.lit("~"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))).cast("binary"))
    named = docs.select(docs["doc_id"].alias("doc_id"), name.alias("_name"), key.alias("_order"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    named = named.withColumn("_cell", F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % cells)
    counts = named.groupBy("_name", "_cell").agg(F.count("*").alias("_n"))
    whole, until = W.partitionBy("_name"), W.partitionBy("_name").orderBy("_cell")
    begin = counts.select("_name", "_cell", (F.sum("_n").over(until) - F.col("_n")).alias("_begin"), F.sum("_n").over(whole).alias("_rows"))
    place = F.row_number().over(W.partitionBy("_name", "_cell").orderBy("_order", "size", "text_crc32"))
    ranked = named.withColumn("_place", place).join(begin, ["_name", "_cell"])
    share = (2.0 * (F.col("_begin") + F.col("_place")) - 1) / (2.0 * F.col("_rows"))
    ranked = stage(ranked.select("doc_id", "size", "text_crc32", "_name", share.alias("_share"), F.floor(share * cells).alias("_bucket")), "shard-ranks")
    buckets = ranked.groupBy("_bucket").agg(F.count("*").alias("_n"))
    first = buckets.select("_bucket", (F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n")).alias("_first"))
    at = F.col("_first") + F.row_number().over(W.partitionBy("_bucket").orderBy("_share", "_name")) - 1
    placed = ranked.join(first, "_bucket").withColumn("_at", at).withColumn("shard", F.expr(f"cast(_at * {shards} div {max(n, 1)} as int)"))
    return placed.select("doc_id", "size", "text_crc32", "shard", F.expr(f"_at - (shard * cast({n} as bigint) + {shards - 1}) div {shards}").alias("slot"))


def shard(docs: DataFrame, shards: int = 40, seed: int = 11) -> DataFrame:
    rows = interleave(docs, shards, seed)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
