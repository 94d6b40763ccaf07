"""Hard-negative mining by a two-dimensional block matrix multiply.

Scores are integer inner products of anchors (rows whose id is divisible by 50) with all rows. Rows stand in order of label
and id and are cut into blocks. A grid cell takes a group of anchor blocks and a group of row blocks; row blocks pass by one at a
time and are multiplied with each anchor block. From the tile of scores a cell keeps what is among an anchor's best so far: first the
positives, of the anchor's label; then, with the anchor's positives beside it, the best rows of other labels inside each positive's
window of scores. A cell leaves a bounded number of candidates for an anchor, and the rest is a ranking within an anchor, or an
anchor and positive. Every pair of an anchor and a row is scored once in the first turn if they may have one label, and once in the second if
they may have two; no score is written that is not a candidate.

There are at most 24 groups of anchors and 48 of rows, so what is shuffled grows as the rows do; the products grow as their square.
A hot label or a hot vector spreads over many blocks. Nothing is broadcast but the row counts of ranges (see ``ordered``), and
nothing but counts reaches the driver.

Rows with a null id, a null label, a null vector or a null or non-finite component take no part. Components become
floor(256 * x), held within +-2^26, so that sums of 2,048 products stay exact. Shorter vectors count as zero beyond their
end. Rows that repeat, or share an id, are rows of their own: an anchor's positive may be its copy, but never itself.
An anchor without positives, and a positive without rows in its window, has no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.llm.common import free_shuffles, stage
from cohortry.llm.ordered import numbered
from cohortry.session import ship_code

MOST = 1 << 26


def _integers(df: DataFrame, relabel: bool) -> DataFrame:
    """vec_id, label, vector (an array of ints) of the rows that take part."""
    clean = df.select(df["vec_id"].cast("long").alias("vec_id"), df["label"].cast("long").alias("label"), df["embedding"].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    clean = clean.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    held = F.transform("v", lambda x: F.greatest(F.least(F.floor(F.least(F.greatest(x * 256, F.lit(-2.0 * MOST)), F.lit(2.0 * MOST))), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")) if relabel else F.col("label")
    return clean.select("vec_id", label.alias("label"), held.alias("vector"))


def _packed(rows: DataFrame, at: str, size: int) -> DataFrame:
    """Blocks of ``size`` rows that stand together by ``at``: one row for each, with its matrix (of 16-bit numbers, if they fit)."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by(at)
        vectors = table.column("vector").combine_chunks()
        lengths = np.diff(vectors.offsets.to_numpy())
        wide, values = max(1, int(lengths.max(initial=0))), vectors.flatten().to_numpy()
        dense = np.zeros((len(lengths), wide), np.int16 if np.abs(values).max(initial=0) < 1 << 15 else np.int32)
        row = np.repeat(np.arange(len(lengths)), lengths)
        dense[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
        longs = {c: table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label", "at")}
        out = (table.column("block")[0].as_py(), wide, *(x.tobytes() for x in longs.values()), dense.tobytes())
        return pa.table({f.name: pa.array([x], f.type) for f, x in zip(SCHEMA, out, strict=True)}, schema=SCHEMA)

    SCHEMA = pa.schema([("block", pa.int64()), ("wide", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("ats", pa.binary()), ("matrix", pa.binary())])
    ship_code(rows.sparkSession)
    keyed = rows.withColumn("block", F.expr(f"{at} div {size}"))
    return keyed.groupBy("block").applyInArrow(pack, "block long, wide int, ids binary, labels binary, ats binary, matrix binary")


def _product(a: np.ndarray, b: np.ndarray, chunk: int = 32) -> np.ndarray:
    """Exact inner products, as the smallest of floats, doubles and longs that holds all sums; ``chunk`` dimensions at a time. The wider rows end with the others."""
    wide = min(a.shape[1], b.shape[1])
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * wide
    kind = np.float32 if bound < 1 << 24 else float if bound < 1 << 53 else np.int64
    out = np.zeros((len(a), len(b)), kind)
    for c in range(0, wide, chunk):
        out += a[:, c : min(c + chunk, wide)].astype(kind) @ b[:, c : min(c + chunk, wide)].astype(kind).T
    return out


NONE = -(1 << 62)


def _limits(x: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Limits for comparison with scores of a kind: where they lie beyond all scores that it can hold, the next one of the kind that does, too."""
    most = {np.dtype(np.float32): 1 << 25, np.dtype(float): 1 << 54}.get(np.dtype(kind))
    return (np.clip(x, -most, most) if most else x).astype(kind)[:, None]


class Best:
    """The best ``most`` entries of each row of a block over all tiles seen so far: by descending score, then id, then place."""

    def __init__(self, n: int, most: int):
        self.most, self.entries, self.least = most, np.empty((4, 0), np.int64), np.full(n, NONE)

    def add(self, scores: np.ndarray, inside: np.ndarray, ids: np.ndarray, ats: np.ndarray) -> None:
        """Takes in a tile; ``inside``: which of its entries are allowed."""
        inside = inside & (scores >= _limits(self.least, scores.dtype))
        if np.count_nonzero(inside) > 4 * self.most * len(scores) and scores.shape[1] > self.most:  # the best of the tile alone already rule most out
            lowest = -(1 << 24) if scores.dtype == np.float32 else -(1 << 53) if scores.dtype == float else NONE
            inside &= scores >= np.partition(np.where(inside, scores, scores.dtype.type(lowest)), -self.most, 1)[:, -self.most, None]
            tied = np.flatnonzero(np.count_nonzero(inside, axis=1) > self.most)
            if len(tied):
                order = np.lexsort((ats, ids))
                ranked = np.argsort(-np.where(inside[tied], scores[tied], scores.dtype.type(lowest))[:, order], axis=1, kind="stable")
                first = np.zeros((len(tied), len(ids)), bool)
                np.put_along_axis(first, order[ranked[:, : self.most]], True, 1)
                inside[tied] &= first
        row, at = np.divmod(np.flatnonzero(inside), scores.shape[1])
        if len(row):
            both = np.hstack([self.entries, [row, scores[row, at].astype(np.int64), ids[at], ats[at]]])
            both = both[:, np.lexsort((both[3], both[2], -both[1], both[0]))]
            begin = np.searchsorted(both[0], np.arange(len(self.least) + 1))
            place = np.arange(both.shape[1]) - begin[both[0]]
            self.entries = both[:, place < self.most]
            full = np.diff(begin) >= self.most
            self.least[full] = both[1, begin[:-1][full] + self.most - 1]


def _block(r: dict) -> dict:
    known = {k: np.frombuffer(r[k], np.int64) for k in ("ids", "labels", "ats")}
    n, wide = len(known["ids"]), r["wide"]
    return known | {"matrix": np.frombuffer(r["matrix"], f"i{len(r['matrix']) // (n * wide)}").reshape(n, wide), "wanted": r["wanted"], "low": known["labels"].min(), "high": known["labels"].max()}


def _scanned(anchors: DataFrame, rows: DataFrame, begin, see, tell, schema: pa.Schema, returns: str, chunk: int, most_groups: tuple[int, int] = (24, 48), group: tuple[int, int] = (64, 2)) -> DataFrame:
    """Anchor blocks against all row blocks, in the cells of a grid: groups of ``group`` blocks, or at most ``most_groups`` larger ones.

    A cell holds its anchor blocks, each with what ``begin`` makes of it; row blocks pass by one at a time, are multiplied with each (``see``), and only
    what ``tell`` says of an anchor block at the end leaves the cell. So what is shuffled grows as the rows do, and no scores are written."""
    i, j = (min(most, max(1, math.ceil(x.count() / per))) for x, most, per in zip((anchors, rows), most_groups, group, strict=True))
    place = lambda n: F.pmod(F.col("block"), F.lit(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = ["block", "wide", "ids", "labels", "ats", "matrix"]
    left = anchors.select(place(i).alias("i"), every(j).alias("j"), F.lit(0).alias("side"), *cols, "wanted")
    right = rows.select(every(i).alias("i"), place(j).alias("j"), F.lit(1).alias("side"), *cols, F.lit(None).cast("binary").alias("wanted"))
    dealt = left.unionByName(right).withColumn("cell", F.col("i") * j + F.col("j")).repartitionById(i * j, "cell").sortWithinPartitions("cell", "side", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if r["cell"] != cell:
                    yield from (tell(*h, schema) for h in held)
                    cell, held = r["cell"], []
                block = _block(r)
                if r["side"] == 0:
                    held.append((block, begin(block)))
                else:
                    for a, found in held:
                        see(a, found, block, lambda a=a, block=block: _product(a["matrix"], block["matrix"], chunk))
        yield from (tell(*h, schema) for h in held)

    ship_code(rows.sparkSession)
    return dealt.mapInArrow(run, returns)


def _positives(anchors: DataFrame, rows: DataFrame, count: int, chunk: int) -> DataFrame:
    """anchor (its place), place, id and score of the best ``count`` other rows of each anchor's label, with their rank."""

    def see(a: dict, found: Best, r: dict, product) -> None:
        if a["high"] >= r["low"] and r["high"] >= a["low"]:
            found.add(product(), (a["labels"][:, None] == r["labels"]) & (a["ats"][:, None] != r["ats"]), r["ids"], r["ats"])

    def tell(a: dict, found: Best, schema: pa.Schema) -> pa.RecordBatch:
        row, score, ids, ats = found.entries
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a["ats"][row], ats, ids, score)], schema=schema)

    names = ("anchor", "positive_at", "positive_id", "positive_score")
    schema = pa.schema([(n, pa.int64()) for n in names])
    candidates = _scanned(anchors, rows, lambda a: Best(len(a["ids"]), count), see, tell, schema, ", ".join(f"{n} long" for n in names), chunk)
    place = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive_at"))
    return candidates.withColumn("place", place).filter(F.col("place") <= count)


def _share(score: np.ndarray, hundredths: int, up: bool) -> np.ndarray:
    """``hundredths`` of scores, down or up to a whole number."""
    whole, rest = np.divmod(score, 100)
    return whole * hundredths + (-(-rest * hundredths // 100) if up else rest * hundredths // 100)


def _negatives(anchors: DataFrame, rows: DataFrame, most: int, low: int, high: int, chunk: int) -> DataFrame:
    """anchor, place (of the positive), negative_id, negative_score: the best ``most`` of each cell inside each positive's window."""

    def begin(a: dict) -> list:
        wanted = np.frombuffer(a["wanted"], np.int64).reshape(len(a["ids"]), -1)  # score, and 1 if there is one, for each positive
        ends = [(_share(score, low, True), _share(score, high, False), there == 1) for score, there in zip(wanted[:, ::2].T, wanted[:, 1::2].T, strict=True)]
        return [(np.where(there, least, 1), np.where(there, largest, 0), Best(len(score), most)) for (least, largest, there), score in zip(ends, wanted[:, ::2].T, strict=True)]

    def see(a: dict, found: list, r: dict, product) -> None:
        if a["low"] == a["high"] == r["low"] == r["high"]:
            return
        scores = product()
        mixed = a["high"] >= r["low"] and r["high"] >= a["low"]
        other = (a["labels"][:, None] != r["labels"]) if mixed else None
        for least, largest, best in found:
            inside = (scores <= _limits(largest, scores.dtype)) & (scores >= _limits(np.maximum(least, best.least), scores.dtype))
            best.add(scores, inside & other if mixed else inside, r["ids"], r["ats"])

    def tell(a: dict, found: list, schema: pa.Schema) -> pa.RecordBatch:
        row, score, ids, _ = np.hstack([best.entries for *_, best in found])
        place = np.repeat(np.arange(1, len(found) + 1, dtype=np.int32), [best.entries.shape[1] for *_, best in found])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a["ats"][row], place, ids, score)], schema=schema)

    schema = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])
    return _scanned(anchors, rows, begin, see, tell, schema, "anchor long, place int, negative_id long, negative_score long", chunk)


def mine(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, relabel: bool = True, chunk: int = 32, blocks: tuple[int, int] = (256, 2_048)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative is of another label and has from ``low`` to ``high`` hundredths of its positive's score. ``relabel`` moves the label of rows
    whose id is divisible by 7 to (label + 1) % 10 first, as the query asks."""
    spark, rows = embeddings.sparkSession, numbered(_integers(embeddings, relabel), ["label", "vec_id"], "mine-rows")
    anchors = stage(numbered(rows.filter(F.col("vec_id") % every == 0).withColumnRenamed("at", "row_at"), ["label", "vec_id", "row_at"], "mine-anchors").withColumnRenamed("at", "anchor_at").withColumnRenamed("row_at", "at"), "mine-anchors")
    row_blocks = stage(_packed(rows, "at", blocks[1]), "mine-row-blocks")
    anchor_blocks = stage(_packed(anchors, "anchor_at", blocks[0]), "mine-anchor-blocks")
    free_shuffles(spark)
    chosen = stage(_positives(anchor_blocks.withColumn("wanted", F.lit(None).cast("binary")), row_blocks, positives, chunk), "mine-positives")
    free_shuffles(spark)
    per_anchor = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("_p"))  # a few to an anchor
    laid = anchors.select("anchor_at", "at", "vec_id").join(per_anchor, F.col("at") == F.col("anchor"), "left")
    number = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    slots = F.flatten(F.array(*[F.array(number(F.get("_p", F.lit(k))["positive_score"]), F.get("_p", F.lit(k)).isNotNull().cast("long")) for k in range(positives)]))
    listed = laid.select(F.expr(f"anchor_at div {blocks[0]}").alias("block"), "anchor_at", slots.alias("slots"))

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        flat = table.sort_by("anchor_at").column("slots").combine_chunks().flatten().to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "wanted": pa.array([flat.astype(np.int64).tobytes()], pa.binary())})

    wanted = listed.groupBy("block").applyInArrow(joined, "block long, wanted binary")
    found = _negatives(stage(anchor_blocks.join(wanted, "block"), "mine-wanted"), row_blocks, negatives, low, high, chunk)
    rank = F.row_number().over(W.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    named = chosen.join(anchors.select(F.col("at").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return ranked.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH e AS (SELECT vec_id AS i, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS u FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.i AS a, a.u AS au, b.i AS b, b.u AS bu, a.l = b.l AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM e a JOIN e b ON a.u <> b.u WHERE a.i % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY au ORDER BY s DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a, p.b, s.b AS n, p.s AS ps, s.s AS ns, row_number() OVER (PARTITION BY p.au, p.bu ORDER BY s.s DESC, s.b) AS r
      FROM p JOIN s ON p.au = s.au AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a AS anchor_id, b AS positive_id, r::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 3
"""
