"""SimHash near-dedup through an inverted index on fingerprint bytes.

Fingerprints with at most 3 of 64 bits different share at least 5 of their 8 bytes in place. Posting lists of
single (position, byte) keys hold a 256th of the corpus each, so tallying over them is quadratic; the index
therefore posts each distinct fingerprint under groups of byte positions, chosen so that any 5 positions contain
one group (:func:`position_groups`), and pairs from a posting list are tallied over all 8 positions. Pairs with
the guaranteed 5 shared positional bytes are then verified bit by bit. Equal fingerprints are one entry, so
copies, however many, cost nothing here, and every link between different fingerprints is found.

Null or wordless texts have fingerprint zero. A null doc_id is ignored as a name of a component. Equal rows are
in the same component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.llm.common import row_mark, stage, text_or_empty
from cohortry.llm.components import components
from cohortry.session import ship_code


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42, at_once: int = 65_536) -> int:
    """64 majority bits over the XXH64 values of the text's word shingles, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), last, strict=False)], "<u8")
    ones = sum(np.unpackbits(hashes[k : k + at_once].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for k in range(0, len(hashes), at_once))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``mark`` (a hash of the text) and ``fp``, the fingerprint's bits as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "mark", "fp"])

    ship_code(docs.sparkSession)
    text = text_or_empty(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text")).mapInArrow(compute, "doc_id long, mark long, fp long")


def position_groups(size: int) -> list[tuple[int, ...]]:
    """Groups of ``size`` of the 8 byte positions so that any 5 positions contain one.

    Of 5 positions, 3 are in the same half: triples within halves do. Groups of 5 are all of them.
    """
    if size == 3:
        return [g for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for g in combinations(half, 3)]
    if size == 5:
        return list(combinations(range(8), 5))
    raise ValueError("groups of 3 or 5 positions")


def links(fps: DataFrame, most_bits: int = 3, group: int = 3) -> DataFrame:
    """Pairs (u, v) of different ``fp`` values with at most ``most_bits`` (up to 3) bits different. ``fps``: distinct."""
    masks = [sum(0xFF << (8 * p) for p in g) for g in position_groups(group)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    posted = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(masks)])).alias("p")).select("fp", "p.g", "p.bytes")
    a, b = posted.alias("a"), posted.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    tally = reduce(lambda x, y: x + y, [(differ.bitwiseAND(F.lit((0xFF << (8 * p)) - (1 << 64) if p == 7 else 0xFF << (8 * p))) == 0).cast("int") for p in range(8)])
    # a pair is in the posting lists of all groups that it shares; the first of them reports it
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.bytes") == F.col("b.bytes")) & (F.col("a.fp") < F.col("b.fp")) & (first == F.col("a.g")) & (tally >= 8 - most_bits) & (F.bit_count(differ) <= most_bits))
    return met.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def classified(docs: DataFrame, shingle: int = 3, most_bits: int = 3, large: int = 1 << 25) -> DataFrame:
    """One row per row of ``docs``: doc_id, mark, fp, ``root`` (the component's smallest fp) and component_id.

    Above ``large`` distinct fingerprints, posting keys take 5 positions instead of 3: more, shorter lists, the same pairs.
    """
    rows = stage(fingerprints(docs, shingle), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), most_bits, 3 if classes.count() <= large else 5))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return rows.join(named, "fp")


def near_copies(docs: DataFrame, **parameters) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (null if nobody in the component has a doc_id)."""
    return classified(docs, **parameters).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """One row of ``docs`` per component: one whose doc_id is the component's (null if none has one); of several such, that with the smallest hash of its text."""
    return keep_named(docs, classified(docs, **parameters))


def keep_named(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`keep_one` keeps, by ``named``: doc_id, mark, root and component_id.

    Null texts count as empty; of rows with the same id and text, that with the smallest hash of all columns stays.
    """
    found = named.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    key = lambda d, m: F.concat_ws(":", F.coalesce(d.cast("string"), F.lit("none")), m.cast("string"))
    keep = found.groupBy("root").agg(F.first("component_id").alias("doc_id"), F.min("mark").alias("mark")).select(key(F.col("doc_id"), F.col("mark")).alias("_keep")).distinct()
    names = [f"_in{i}" for i in range(len(docs.columns))]
    mine = docs.select(row_mark(docs).alias("_row"), key(docs["doc_id"], F.xxhash64(text_or_empty(docs))).alias("_key"), *[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)])
    kept = mine.join(keep, F.col("_key") == F.col("_keep"), "left_semi")
    one = kept.withColumn("_k", F.row_number().over(W.partitionBy("_key").orderBy("_row"))).filter("_k = 1")
    return one.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
