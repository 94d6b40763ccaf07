"""Near copies by SimHash: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

The method is that of ``simhash``: majority bits of shingle hashes, an inverted index that posts each fingerprint under groups of three byte
positions, a tally over positional bytes, and a check of what remains, here on the whole sets. At similarity 0.8 two fingerprints
differ in 15 % of their bits (the angle of two sets with a cosine of 8/9), so a byte is shared with probability 0.27. A fingerprint has 6,144
bits (96 words, 768 bytes), posted under 512 groups; a pair at 0.8 shares none of them with a probability of about 1e-4 (sets of 4 and 5
shingles differ in more bits: 3e-2), one above more rarely. Texts that share a group are compared by the fingerprint's first word, in
which pairs differ by at most ``MOST_BITS`` bits, before all else.

A list's leader is the one whose lists are the fullest, which tends to be what the others were copied from. A document is first compared
with the fullest of its lists' leaders, so once; then, in the lists that still hold different components, with the leaders of other
components; then those of different components with each other. Pairs with as many shared bytes as one at 0.8 has (4 standard
deviations below its mean, a chance of 3e-5), of the first 128 in the first comparison and of all after it, are verified on
their whole sets of 64-bit shingle hashes. Components are those of all verified pairs. Equal texts are one entry. Groups are posted
in turns, whose shuffle files are let go.

Words are told apart by ASCII white space and compared without ASCII case. A text of fewer words is one shingle; wordless
texts (and null) are near copies of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.llm.common import free_shuffles, stage, text_or_empty
from cohortry.llm.components import components
from cohortry.llm.simhash import keep_named
from cohortry.llm.tokens import slices
from cohortry.session import ship_code

#: 64-bit words of a fingerprint, those that pairs with leaders are tallied over, and the turns in which groups are posted.
WORDS, FIRST_WORDS, TURNS = 96, 16, 8
#: The most bits of a word in which a pair at 0.8 differs, 4 standard deviations above its mean of 9.7.
MOST_BITS = 22
#: Sets of fewer shingles are verified without a tally.
FEW = 16


def shingles(text: bytes, size: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 values of the text's word shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(size, len(words)) - 1 :].tolist()
    return np.unique(np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), last, strict=False)], np.uint64))


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How many rows have each bit set, lowest first. Three rows become their sum and their carry, until no three are left."""
    counts, weight = np.zeros(words.shape[1] * 64, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            either = a ^ b
            carries.append((a & b) | (either & c))
            words = np.concatenate([either ^ c, words[3 * third :]])
        if len(words) == 2:
            carries.append(words[:1] & words[1:])
        one = np.bitwise_xor.reduce(words, axis=0)
        counts += weight * np.unpackbits(one.astype("<u8").view(np.uint8), bitorder="little").astype(np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return counts


def fingerprint(hashes: np.ndarray, seed: int = 42, at_once: int = 512) -> np.ndarray:
    """``WORDS`` words of majority bits over a set's shingle hashes, each word from another mix of them."""
    salts = np.random.default_rng(seed).integers(0, 1 << 63, WORDS, dtype=np.uint64)
    ones = np.zeros(WORDS * 64, np.int64)
    for k in range(0, len(hashes), at_once):
        x = hashes[k : k + at_once, None] ^ salts
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        ones += bit_counts(x)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def position_groups(seed: int = 7) -> np.ndarray:
    """Groups of three byte positions; each position is in two."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.permutation(WORDS * 8).reshape(-1, 3) for _ in range(2)])


def posted(docs: DataFrame, seed: int = 42) -> DataFrame:
    """mark (a hash of the text), n (its distinct shingles) and bytes (its fingerprint, eight to a long), once for each text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingles(t.as_py()) for t in part.column(1)]
                found = [fingerprint(x, seed).view(np.int64) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["mark", "n", "bytes"])

    ship_code(docs.sparkSession)
    text = text_or_empty(docs)
    return docs.select(F.xxhash64(text).alias("mark"), text.cast("binary").alias("text")).mapInArrow(compute, "mark long, n int, bytes array<long>").distinct()


def listed(rows: DataFrame, turn: int) -> DataFrame:
    """mark and key, for each group of the turn."""
    first = position_groups()[turn::TURNS]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bytes_ = batch.column(1).flatten().to_numpy().reshape(-1, WORDS).view(np.uint8)
                key = np.arange(turn, turn + len(first) * TURNS, TURNS) << 24
                for i in range(3):
                    key = key | bytes_[:, first[:, i]].astype(np.int64) << 8 * i
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), len(first))), pa.array(key.ravel())], names=["mark", "key"])

    ship_code(rows.sparkSession)
    return rows.select("mark", "bytes").mapInArrow(compute, "mark long, key long")


def texts_of(docs: DataFrame, marks: DataFrame, most_broadcast: int = 1 << 20) -> DataFrame:
    """mark and text, once for each of ``marks`` (distinct), staged. Marks are broadcast if there are at most ``most_broadcast``: 16 MB."""
    marks = stage(marks, "near-marks")
    marks = F.broadcast(marks) if marks.count() <= most_broadcast else marks
    text = text_or_empty(docs)
    found = docs.select(F.xxhash64(text).alias("mark"), text.cast("binary").alias("text")).join(marks, "mark", "left_semi")
    return stage(found.groupBy("mark").agg(F.first("text").alias("text")), "near-texts")


def shared_bytes(a: Column, b: Column) -> Column:
    """How many positional bytes of two arrays of longs are the same."""

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for k in (4, 2, 1):  # gathers each byte's bits in its lowest
            z = z.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    return 8 * F.size(a) - F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda acc, x: acc + x)


def least_shared(count: int, tenths: int) -> int:
    """The shared bytes, of ``count``, of a pair whose similarity is ``tenths`` tenths, less 4 standard deviations."""
    p = (1 - math.acos(2 * tenths / (10 + tenths)) / math.pi) ** 8
    return int(count * p - 4 * (count * p * (1 - p)) ** 0.5)


def _sizes(a: Column, b: Column, tenths: int) -> Column:
    return 10 * F.least(a, b) >= tenths * F.greatest(a, b)


def verified(docs: DataFrame, pairs: DataFrame, tenths: int = 8) -> DataFrame:
    """The pairs (u, v) of marks whose texts have a similarity of ``tenths`` tenths or more."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = lru_cache(64)(shingles)
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = seen(a.as_py()), seen(b.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(10 * both >= tenths * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["u", "v"])

    ids = pairs.select(F.col("u").alias("mark")).unionAll(pairs.select(F.col("v").alias("mark"))).distinct()
    texts = texts_of(docs, ids)
    ship_code(docs.sparkSession)
    with_v = pairs.join(texts.select(F.col("mark").alias("v"), F.col("text").alias("b")), "v")
    with_both = with_v.join(texts.select(F.col("mark").alias("u"), F.col("text").alias("a")), "u")
    return with_both.select("u", "v", "a", "b").mapInArrow(compute, "u long, v long")


def mixed(rooted: DataFrame) -> DataFrame:
    """The rows of the lists (``key``) that hold documents of different components (``root``): each row once, so at most one to a document and group."""
    lists = W.partitionBy("key")
    found = rooted.withColumn("_low", F.min("root").over(lists)).withColumn("_high", F.max("root").over(lists))
    return found.filter("_low != _high").select(*rooted.columns)


def _alike(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MOST_BITS


def led(rooted: DataFrame, tenths: int = 8) -> DataFrame:
    """u (a list's leader), v, n (the lesser of their sizes) and the leader's fullness, for each list in which v is of another component and may be a near copy."""
    rows = rooted.withColumn("top", F.max(F.struct("fullness", "mark", "n", "word", "root")).over(W.partitionBy("key")))
    found = rows.filter((F.col("root") != F.col("top.root")) & _alike(F.col("word"), F.col("top.word")) & _sizes(F.col("n"), F.col("top.n"), tenths))
    return found.select(F.col("top.mark").alias("u"), F.col("mark").alias("v"), F.least("n", "top.n").alias("n"), F.col("top.fullness").alias("fullness"))


def tally(n: Column, a: Column, b: Column, words: int, tenths: int) -> Column:
    return (n < FEW) | (shared_bytes(a, b) >= least_shared(8 * words, tenths))


def tallied(rows: DataFrame, pairs: DataFrame, words: int, tenths: int) -> DataFrame:
    """Of ``pairs`` (u, v, n), u and v of those that share enough bytes of their first ``words`` words."""
    bytes_as = lambda mark, name: rows.select(F.col("mark").alias(mark), F.slice("bytes", 1, words).alias(name))
    return pairs.join(bytes_as("v", "b"), "v").join(bytes_as("u", "a"), "u").filter(tally(F.col("n"), F.col("a"), F.col("b"), words, tenths)).select("u", "v")


def met_before(a: Column, b: Column, group: Column) -> Column:
    """Whether two arrays of longs have the same bytes in a group of positions before ``group``, so that another list holds both."""
    groups = F.array(*[F.struct(*[F.lit(x).alias(f"{name}{i}") for i, p in enumerate(g) for name, x in (("w", p // 8), ("s", p % 8 * 8))]) for g in position_groups().tolist()])

    def same(g: Column) -> Column:
        differ = [F.call_function("shiftrightunsigned", F.get(a, g[f"w{i}"]).bitwiseXOR(F.get(b, g[f"w{i}"])), g[f"s{i}"]).bitwiseAND(F.lit(255)) for i in range(3)]
        return reduce(Column.__and__, [d == 0 for d in differ])

    return F.exists(F.slice(groups, F.lit(1), group), same)


def rooted(lists: DataFrame, links: DataFrame) -> DataFrame:
    """``lists`` with the component (``root``) that ``links`` give each document."""
    roots = components(links).withColumnRenamed("node", "mark")
    return lists.join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))


def links(docs: DataFrame, tenths: int = 8) -> DataFrame:
    """Verified pairs (u, v) of marks that join all near copies; pairs within what others have joined already are left out."""
    rows, parts = stage(posted(docs), "near-rows"), []
    for turn in range(TURNS):
        sized = listed(rows, turn).withColumn("size", F.count("*").over(W.partitionBy("key"))).filter("size > 1")
        parts.append(stage(sized, "near-sized"))
        del sized
        free_shuffles(docs.sparkSession)
    lists = reduce(DataFrame.unionAll, parts)
    fullness = lists.groupBy("mark").agg(F.sum("size").alias("fullness"))
    shared = stage(lists.join(rows.select("mark", "n", F.get("bytes", F.lit(0)).alias("word")).join(fullness, "mark"), "mark"), "near-shared")
    best = led(shared.withColumn("root", F.col("mark")), tenths).groupBy("v").agg(F.max(F.struct("fullness", "u", "n")).alias("best"))
    near = stage(tallied(rows, best.select("best.u", "v", "best.n"), FIRST_WORDS, tenths), "near-first")
    free_shuffles(docs.sparkSession)
    found = [stage(verified(docs, near, tenths), "near-links")]
    left = stage(mixed(rooted(shared, found[0])), "near-mixed")
    stars = led(left, tenths).select("u", "v", "n").distinct().join(near, ["u", "v"], "left_anti")
    stars = stage(tallied(rows, stars, WORDS, tenths), "near-stars")
    free_shuffles(docs.sparkSession)
    found.append(stage(verified(docs, stars, tenths), "near-links"))
    left = mixed(rooted(left.filter("size > 2").drop("root"), found[0].unionAll(found[1])))  # lists of two have met their leader
    left = stage(left.select("mark", "n", "word", "key", "root"), "near-left").join(rows.select("mark", "bytes"), "mark")
    a, b = left.alias("a"), left.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.mark") < F.col("b.mark")) & (F.col("a.root") != F.col("b.root")) & _alike(F.col("a.word"), F.col("b.word")) & _sizes(F.col("a.n"), F.col("b.n"), tenths) & tally(F.least("a.n", "b.n"), F.col("a.bytes"), F.col("b.bytes"), WORDS, tenths) & ~met_before(F.col("a.bytes"), F.col("b.bytes"), F.shiftright("a.key", 24).cast("int")))  # each pair in the first of its lists
    met = met.select(F.col("a.mark").alias("u"), F.col("b.mark").alias("v")).distinct()
    tried = near.unionAll(stars).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    rest = stage(met.join(tried, ["u", "v"], "left_anti"), "near-rest")
    return found[0].unionAll(found[1]).unionAll(verified(docs, rest, tenths))


def keep_one(docs: DataFrame, tenths: int = 8) -> DataFrame:
    """One row of ``docs`` per component of near copies: one with its smallest doc_id (null if none has one); of several such, that with the smallest hash of its text."""
    roots = components(links(docs, tenths))
    classes = docs.groupBy(F.xxhash64(text_or_empty(docs)).alias("mark")).agg(F.min(docs["doc_id"].cast("long")).alias("least"))
    rooted = stage(classes.join(roots.withColumnRenamed("node", "mark"), "mark", "left").select("mark", "least", F.coalesce("root", "mark").alias("root")), "near-classes")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("root", "mark", F.col("least").alias("doc_id"), "component_id")
    return keep_named(docs, named)
