"""Chat formatting by perspective rotation: each participant in turn becomes the assistant.

For every participant of a conversation (every role but ``system``), the dialogue is rendered with that speaker as the
assistant, the others as named users and system messages as they are; the mask lists the character ranges to
train on, which are the assistant's words with their end marks. All of it is grouping and column expressions.

A row holds up to ``messages`` consecutive messages; a longer dialogue goes on in the next ``part``, whatever its turn
numbers are. Ranks come from counts per cell: a block of turn numbers, and in a block with many messages a turn and a
part of a hash. Equal messages are counted before they are ranked. So neither a huge conversation, a turn number that
repeats nor a message said over and over meets in one task or one row.

Null role: speaker ``unknown``. Null text: empty. Null turn: after all others. Null conv_id: a conversation of its own.
Messages with equal turns are ordered by a hash of speaker and text, and repeated messages are kept. A conversation
without participants has no row. Markers inside a text are broken up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.llm.common import stage
from cohortry.llm.spans import running

LAST = (1 << 63) - 1


def ranked(said: DataFrame, messages: int, rows_per_cell: int) -> DataFrame:
    """Adds ``_begin``: how many messages of the conversation stand before the first copy of this one."""
    rows = said.withColumn("_block", F.floor(F.col("turn") / messages))
    size = F.count("*")
    large = rows.groupBy(F.col("conv_id").alias("_c"), F.col("_block").alias("_b")).agg(size.alias("_rows")).filter(F.col("_rows") > rows_per_cell)
    digits = F.ceil(F.log(F.col("_rows") / rows_per_cell) / F.log(F.lit(16.0))).cast("int")
    keyed = rows.join(large.select("_c", "_b", digits.alias("_digits")), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")), "left").drop("_c", "_b")
    keyed = keyed.withColumns({"_turn": F.when(F.col("_digits").isNotNull(), F.col("turn")).otherwise(0), "_hash": F.coalesce(F.expr("substring(_tie, 1, _digits)"), F.lit(""))}).drop("_digits")
    cell = ["_block", "_turn", "_hash"]
    cells = keyed.groupBy("conv_id", *cell).agg(F.sum("_copies").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("conv_id").orderBy(*cell).rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    first = cells.select(F.col("conv_id").alias("_c"), *[F.col(c).alias(f"_c{c}") for c in cell], before.alias("_first"))
    inside = F.sum("_copies").over(W.partitionBy("conv_id", *cell).orderBy("turn", "_tie").rowsBetween(W.unboundedPreceding, 0)) - F.col("_copies")
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    for c in cell:
        same = same & (F.col(c) == F.col(f"_c{c}"))
    return keyed.withColumn("_inside", inside).join(first, same).select(*said.columns, (F.col("_first") + F.col("_inside")).alias("_begin"))


def rotate(conversations: DataFrame, messages: int = 256, rows_per_cell: int = 20_000) -> DataFrame:
    """conv_id, part, perspective, rendered, mask (start:end, comma-joined, code points), n_messages, n_trained."""
    c = conversations
    speaker = F.coalesce(c["role"], F.lit("unknown"))
    place = F.coalesce(c["turn"].cast("long"), F.lit(LAST))
    content = F.replace(F.coalesce(c["text"], F.lit("")), F.lit("<|"), F.lit("< |"))
    spoken = c.select(c["conv_id"].alias("conv_id"), place.alias("turn"), speaker.alias("speaker"), content.alias("content"))
    counted = spoken.groupBy("conv_id", "turn", "speaker", "content").agg(F.count("*").alias("_copies"))
    said = stage(counted.withColumn("_tie", F.md5(F.concat("speaker", F.lit(":"), "content").cast("binary"))), "chat-messages")
    people = said.filter("speaker != 'system'").select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    cut = ranked(said, messages, rows_per_cell).withColumn("part", F.explode(F.expr(f"sequence(_begin div {messages}, (_begin + _copies - 1) div {messages})")))
    here = F.least(F.col("_begin") + F.col("_copies"), (F.col("part") + 1) * messages) - F.greatest(F.col("_begin"), F.col("part") * messages)
    parts = cut.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "_tie", "speaker", "content", here.cast("int").alias("times")))).alias("_said"))
    parts = parts.select("conv_id", "part", F.flatten(F.transform("_said", lambda m: F.array_repeat(m, m["times"]))).alias("_messages"))
    seen = parts.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    def head(m):
        named = F.concat(F.lit("<|user name="), F.regexp_replace(m["speaker"], r"[^\p{L}\p{N}_.-]", "_"), F.lit("|>\n"))
        return F.when(m["speaker"] == F.col("perspective"), "<|assistant|>\n").when(m["speaker"] == "system", "<|system|>\n").otherwise(named)

    pieces = F.transform("_messages", lambda m: F.struct(head(m).alias("head"), F.concat(m["content"], F.lit("<|end|>")).alias("body"), (m["speaker"] == F.col("perspective")).alias("own")))
    cut = seen.select("conv_id", "part", "perspective", pieces.alias("_pieces"))
    sized = cut.select("*", running(F.transform("_pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + 1)).alias("_at"))
    ranges = F.filter(F.transform("_pieces", lambda p, i: F.struct(p["own"].alias("own"), (F.get("_at", i) + F.length(p["head"])).alias("s"), (F.get("_at", i) + F.length(p["head"]) + F.length(p["body"])).alias("e"))), lambda r: r["own"])
    masked = sized.select("*", ranges.alias("_own"))
    return masked.select(
        "conv_id", "part", "perspective",
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        F.array_join(F.transform("_own", lambda r: F.concat_ws(":", r["s"].cast("string"), r["e"].cast("string"))), ",").alias("mask"),
        F.size("_pieces").cast("long").alias("n_messages"),
        F.aggregate("_own", F.lit(0).cast("long"), lambda acc, r: acc + r["e"] - r["s"]).alias("n_trained"),
    )


ORACLE = r"""
WITH n AS (SELECT conv_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, 'unknown') AS speaker,
                  replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, md5(speaker || ':' || content)) - 1 AS r FROM n),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
s AS (SELECT m.*, r // 256 AS part, perspective, speaker = perspective AS own, content || '<|end|>' AS body,
             CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) WHEN speaker = 'system' THEN '<|system|>' || chr(10)
                  ELSE '<|user name=' || regexp_replace(speaker, '[^\p{L}\p{N}_.-]', '_', 'g') || '|>' || chr(10) END AS head
      FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
w AS (SELECT *, length(head) + coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, perspective
             ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s)
SELECT conv_id, part, perspective, string_agg(head || body || chr(10), '' ORDER BY r) AS rendered,
       coalesce(string_agg(b::BIGINT || ':' || (b + length(body))::BIGINT, ',' ORDER BY r) FILTER (own), '') AS mask,
       count(*)::BIGINT AS n_messages, coalesce(sum(length(body)) FILTER (own), 0)::BIGINT AS n_trained
FROM w GROUP BY conv_id, part, perspective
"""
