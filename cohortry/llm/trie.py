"""Conversation prefix trie: which conversations begin alike, and what training on the shared beginnings once would save.

Every turn has a content hash; a conversation's first d turns have the polynomial fingerprint sum(hash_i * BASE^i) modulo
2^61 - 1, a running sum that numpy scans over ranges of (conversation, depth). Prefixes of equal depth and fingerprint are
candidates for one node. Contents are verified against each other turn by turn: those that share a hash are told apart by a
number, and where the turns of a candidate node differ from those of its representative, its members carry the place and the number
of the split from there on. After that equal keys are equal prefixes: the last turns are equal, so are the fingerprints
without them, and so on down to the root. The result does not depend on the hash; a poor one only splits more.

Rollup: nodes with the same smallest member form a path, and paths hang on each other as a tree. Paths are summed by pointer doubling
(a round for each power of two of the tree's height), nodes inside a path by running sums. No node, conversation or turn meets in
one task, but for the list of a node's ends, which SHA-256 has to take in sequence: its parts are made in ranges and streamed.

Null role or text: empty. Null turn: before all others. Equal turns are ordered by role, then text; repeated rows are kept.
Rows with a null conv_id take no part. An empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.llm.common import Staged, stage
from cohortry.llm.ordered import PRIME, running
from cohortry.session import ship_code

BASE = 0x0A5A3C7912E6B4D3
GROUP, MOST_SHARED = 5, 9
CHUNK = 64


def shared_turns(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its group of five."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED).cast("int")


def times(a: np.ndarray, b: np.ndarray, prime: int = PRIME) -> np.ndarray:
    """Products of residues."""
    if prime != PRIME:
        return a * b % np.uint64(prime)
    low = np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    middle = a0 * b1 + a1 * b0
    x = a1 * b1 * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def powers(exponents: np.ndarray, prime: int = PRIME) -> np.ndarray:
    """BASE to each of ``exponents``."""
    out, square, left = np.ones(len(exponents), np.uint64), np.array([BASE % prime], np.uint64), exponents.copy()
    while left.any():
        out = np.where(left & 1, times(out, square, prime), out)
        square, left = times(square, square, prime), left >> 1
    return out


def weighted(turns: DataFrame, prime: int) -> DataFrame:
    """Adds ``term``: the content hash times BASE to the depth."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, x = batch.column(batch.schema.get_field_index("depth")).to_numpy(), batch.column(batch.schema.get_field_index("hash")).to_numpy()
            term = times(x.view(np.uint64) % np.uint64(prime), powers(depth, prime), prime)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(term.view(np.int64))], names=[*batch.schema.names, "term"])

    ship_code(turns.sparkSession)
    return turns.mapInArrow(compute, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in turns.schema.fields) + ", term long")


def contents(conversations: DataFrame, bits: int) -> DataFrame:
    """conv_id, turn, role, text, part, copies (equal rows, up to 64 in a row), hash, twin (tells contents of one hash apart), bytes."""
    c = conversations
    role, text = F.coalesce(c["role"].cast("string"), F.lit("")), F.coalesce(c["text"].cast("string"), F.lit(""))
    said = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].alias("turn"), role.alias("role"), text.alias("text")).filter("conv_id is not null")
    counted = said.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("_n"))
    counted = counted.withColumn("part", F.explode(F.expr(f"sequence(0, (_n - 1) div {CHUNK})")))
    hashed = counted.select("conv_id", "turn", "role", "text", "part", F.least(F.col("_n") - F.col("part") * CHUNK, F.lit(CHUNK)).cast("long").alias("copies"), F.xxhash64("role", "text").bitwiseAND((1 << bits) - 1).alias("hash"), F.octet_length("text").cast("long").alias("bytes"))
    staged = stage(hashed, "trie-turns")
    distinct = staged.select("hash", "role", "text").distinct()
    shared = distinct.groupBy("hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("hash")
    twins = stage(distinct.join(shared, "hash", "left_semi").select(F.col("hash").alias("_h"), F.col("role").alias("_r"), F.col("text").alias("_t"), (F.row_number().over(W.partitionBy("hash").orderBy("role", "text")) - 1).alias("twin")), "trie-twins")
    if twins.isEmpty():
        return staged.withColumn("twin", F.lit(0))
    return staged.join(twins, (F.col("hash") == F.col("_h")) & (F.col("role") == F.col("_r")) & (F.col("text") == F.col("_t")), "left").select(*staged.columns, F.coalesce("twin", F.lit(0)).alias("twin"))


def rebuilt(conversations: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, depth, hash, twin, bytes), and conv_id with its number of rebuilt turns."""
    ordered = running(contents(conversations, bits), "conv_id", ["turn", "role", "text", "part"], ["copies"], "trie-ranks")
    turns = stage(ordered.select("conv_id", F.explode(F.sequence(F.col("run_copies") - F.col("copies") + 1, "run_copies")).alias("rank"), "hash", "twin", "bytes"), "trie-own")
    sizes = turns.groupBy("conv_id").agg(F.max("rank").alias("n"))
    first, own = F.col("conv_id") - F.col("conv_id") % GROUP, shared_turns(F.col("conv_id"))
    source = sizes.select(F.col("conv_id").alias("_source"), F.col("n").alias("_there"))
    lengths = stage(
        sizes.withColumn("_first", first).join(source, F.col("_first") == F.col("_source"), "left")
        .select("conv_id", own.alias("h"), F.least(own.cast("long"), F.coalesce("_there", F.lit(0).cast("long"))).alias("taken"), "n")
        .select("conv_id", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")),
        "trie-lengths",
    )
    rest = turns.filter(F.col("rank") > own).join(lengths.select("conv_id", "h", "taken"), "conv_id").select("conv_id", (F.col("taken") + F.col("rank") - F.col("h")).alias("depth"), "hash", "twin", "bytes")
    heads = turns.filter((F.col("conv_id") % GROUP == 0) & (F.col("rank") < MOST_SHARED)).withColumn("_to", F.explode(F.expr(f"sequence(conv_id - {GROUP - 1}, conv_id + {GROUP - 1})")))
    heads = heads.filter((F.col("_to") - F.col("_to") % GROUP == F.col("conv_id")) & (F.col("rank") <= shared_turns(F.col("_to"))))
    heads = heads.select(F.col("_to").alias("conv_id"), F.col("rank").alias("depth"), "hash", "twin", "bytes").join(lengths.select("conv_id"), "conv_id", "left_semi")
    return rest.unionByName(heads), lengths.select("conv_id", "length")


def prefixes(conversations: DataFrame, bits: int = 61, prime: int = PRIME) -> DataFrame:
    """conv_id, depth, print, before (the print without the last turn), split, split_before, bytes, ends: each prefix of each rebuilt conversation, the root's included."""
    turns, lengths = rebuilt(conversations, bits)
    printed = running(weighted(turns, prime), "conv_id", ["depth"], ["term"], "trie-prints", prime)
    before = (F.col("run_term") - F.col("term") + prime) % prime
    marked = printed.select("conv_id", "depth", F.col("run_term").alias("print"), before.alias("before"), "hash", "twin", "bytes")
    roots = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("print"), F.lit(None).cast("long").alias("before"), F.lit(0).cast("long").alias("hash"), F.lit(0).alias("twin"), F.lit(0).cast("long").alias("bytes"))
    found = stage(marked.unionByName(roots).join(lengths, "conv_id").withColumn("ends", F.col("depth") == F.col("length")).drop("length"), "trie-prefixes")
    last = F.struct("hash", "twin")
    differ = found.groupBy("depth", "print").agg(F.min(last).alias("_low"), F.max(last).alias("_high")).filter("_low != _high").select("depth", "print")
    kinds = stage(found.join(differ, ["depth", "print"], "left_semi").select("depth", "print", "hash", "twin").distinct(), "trie-splits")
    none = F.lit("")
    if kinds.isEmpty():
        return found.withColumns({"split": none, "split_before": F.when(F.col("depth") > 0, none)})
    kinds = kinds.withColumn("_kind", F.row_number().over(W.partitionBy("depth", "print").orderBy("hash", "twin")))
    split = found.join(kinds, ["depth", "print", "hash", "twin"], "left").withColumn("_own", F.when(F.col("_kind").isNotNull(), F.concat_ws(":", "depth", "_kind")))
    so_far = lambda end: F.concat_ws(",", F.collect_list("_own").over(W.partitionBy("conv_id").orderBy("depth").rowsBetween(W.unboundedPreceding, end)))
    return stage(split.withColumns({"split": so_far(0), "split_before": F.when(F.col("depth") > 0, so_far(-1))}).drop("_own", "_kind"), "trie-told-apart")


def _end_lists(ends: DataFrame, parts_of: int = 16_384) -> DataFrame:
    """conv_id, depth (of a node), ends_sha256, from its members' ``end``; lists are made in ranges, and their parts hashed in order."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, depth, end = (c.to_numpy() for c in batch.columns)
            cut = np.flatnonzero((conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])) + 1
            bounds = [x for a, b in zip([0, *cut], [*cut, len(conv)], strict=True) for x in range(a, b, parts_of)] + [len(conv)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                yield pa.RecordBatch.from_arrays([pa.array(conv[a:b][:1]), pa.array(depth[a:b][:1]), pa.array(end[a:b][:1]), pa.array([",".join(map(str, end[a:b].tolist())).encode()], pa.binary())], names=["conv_id", "depth", "first", "list"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, out = None, None, []
        row = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows])], names=["conv_id", "depth", "ends_sha256"])
        for batch in batches:
            for conv, depth, _, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, depth) != key:
                    if key:
                        out.append((*key, now.hexdigest()))
                    key, now = (conv, depth), hashlib.sha256(part)
                else:
                    now.update(b"," + part)
            if len(out) > 10_000:
                yield row(out)
                out = []
        if key:
            yield row([*out, (*key, now.hexdigest())])

    ordered = ends.repartitionByRange("conv_id", "depth", "end").sortWithinPartitions("conv_id", "depth", "end").select("conv_id", "depth", "end")
    parts = ordered.mapInArrow(joined, "conv_id long, depth long, first long, list binary")
    return parts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def _path_totals(paths: DataFrame) -> DataFrame:
    """conv_id, leaves, saved of each path with all that hangs on it, from (conv_id, parent, leaves, saved), by pointer doubling."""
    now = Staged(paths.select("conv_id", F.col("parent").alias("up"), "leaves", "saved"), "trie-paths")
    while not now.df.filter("up is not null").isEmpty():
        lower = now.df.filter("up is not null").groupBy(F.col("up").alias("_up")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        above = now.df.select(F.col("conv_id").alias("_at"), F.col("up").alias("_next"))
        grown = now.df.join(lower, F.col("conv_id") == F.col("_up"), "left").join(above, F.col("up") == F.col("_at"), "left")
        grown = grown.select("conv_id", F.col("_next").alias("up"), (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"))
        before, now = now, Staged(grown, "trie-paths")
        before.drop()
    return now.df.drop("up")


def trie(conversations: DataFrame, bits: int = 61, prime: int = PRIME) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = prefixes(conversations, bits, prime)
    key = ["depth", "print", "split"]
    nodes = found.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("before").alias("before"), F.first("split_before").alias("split_before"), F.first("bytes").alias("bytes"))
    nodes = stage(nodes, "trie-nodes")
    upper = nodes.select((F.col("depth") + 1).alias("depth"), F.col("print").alias("before"), F.col("split").alias("split_before"), F.col("conv_id").alias("parent"))
    placed = nodes.join(upper, ["depth", "before", "split_before"], "left").select(*key, "conv_id", "parent", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    placed = stage(placed, "trie-placed")
    children = placed.filter("parent is not null").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    known = stage(placed.select("conv_id", "depth", "parent", "n_convs", "own").join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-known")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    top = F.coalesce(F.col("parent") != F.col("conv_id"), F.lit(True))
    paths = known.groupBy("conv_id").agg(F.min(F.when(top, F.struct("depth", "parent"))).alias("_top"), F.sum(leaf).alias("leaves"), F.sum("own").alias("saved"))
    paths = stage(paths.select("conv_id", F.col("_top.parent").alias("parent"), F.col("_top.depth").alias("depth"), "leaves", "saved"), "trie-tops")
    totals = _path_totals(paths)
    hung = paths.filter("parent is not null").join(totals.select("conv_id", F.col("leaves").alias("_l"), F.col("saved").alias("_s")), "conv_id")
    hung = hung.groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.sum("_l").alias("_l"), F.sum("_s").alias("_s"))
    zero = F.lit(0).cast("long")
    valued = known.join(hung, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent", "n_convs", "n_children", (leaf + F.coalesce("_l", zero)).alias("leaves"), (F.col("own") + F.coalesce("_s", zero)).alias("saved"))
    summed = running(stage(valued, "trie-valued"), "conv_id", ["depth"], ["leaves", "saved"], "trie-sums")
    whole = totals.select("conv_id", F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved"))
    done = summed.join(whole, "conv_id").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("_leaves") - F.col("run_leaves") + F.col("leaves")).alias("n_leaves"), (F.col("_saved") - F.col("run_saved") + F.col("saved")).alias("saved_tokens"),
    )
    ends = found.filter("ends").select(*key, F.col("conv_id").alias("end")).join(placed.select(*key, "conv_id"), key).select("conv_id", "depth", "end")
    lists = _end_lists(stage(ends, "trie-ends"))
    return done.join(lists, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(length(c::VARCHAR)), lambda i: [ascii(substr(c::VARCHAR, i + 1, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)"

ORACLE = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor({_CRC}, 4294967295::BIGINT) % 9 AS h, n FROM (SELECT c, max(r) AS n FROM t GROUP BY 1)),
l AS (SELECT a.c, a.h, least(a.h, coalesce(b.n, 0)) AS k FROM h a LEFT JOIN h b ON b.c = a.c - a.c % 5),
s AS (SELECT l.c, t.r AS d, role, text FROM l JOIN t ON t.c = l.c - l.c % 5 AND t.r <= l.h UNION ALL SELECT l.c, k + t.r - h, role, text FROM l JOIN t ON t.c = l.c AND t.r > h
      UNION ALL SELECT c, 0, '', '' FROM l),
p AS (SELECT c, d, octet_length(encode(text)) AS b, max(d) OVER (PARTITION BY c) = d AS e,
             string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS p FROM s),
m AS (SELECT c, d, b, e, min(c) OVER (PARTITION BY d, p) AS v FROM p),
n AS (SELECT v, d, count(*) AS n, any_value(b) AS b, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (e) AS ends FROM m GROUP BY v, d),
u AS (SELECT DISTINCT a.v, a.d, z.v AS pv FROM m a JOIN m z ON a.c = z.c AND z.d = a.d - 1),
k AS (SELECT pv AS v, d - 1 AS d, count(*) AS k FROM u GROUP BY ALL),
f AS (SELECT n.v, n.d, (k.k IS NULL)::INT AS leaf, (n - 1) * b AS own FROM n LEFT JOIN k ON n.v = k.v AND n.d = k.d),
g AS (SELECT x.v, x.d, sum(leaf) AS leaves, sum(own) AS saved FROM (SELECT DISTINCT a.v, a.d, z.v AS zv, z.d AS zd FROM m a JOIN m z ON a.c = z.c AND z.d >= a.d) x JOIN f ON f.v = zv AND f.d = zd GROUP BY ALL)
SELECT n.v AS conv_id, n.d::BIGINT AS depth, u.pv AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(k.k, 0)::BIGINT AS n_children, g.leaves::BIGINT AS n_leaves, g.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN g ON n.v = g.v AND n.d = g.d LEFT JOIN u ON n.v = u.v AND n.d = u.d LEFT JOIN k ON n.v = k.v AND n.d = k.d
"""
