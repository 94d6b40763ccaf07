"""Quartile bucket digests of documents, compared by a bounded difference score.

A digest counts the hashed byte triplets of a text in 256 buckets, writes for each bucket which quartile of the
counts it lies in (two bits), and adds a logarithmic code of the length. The difference of two digests sums the
distances between quartiles and between length codes up to a bound; likeness is one minus its share of the bound.

The successor of each document (ascending doc_id, a null first, ties by text) comes from one shuffle: documents are dealt by
doc_id range, and the first row of a range is also sent to the range before it, that of the first to the last.
Null text: empty. A text of under three bytes has no triplets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import text_or_empty
from cohortry.session import ship_code

BUCKETS = 256
#: Digests of unrelated texts differ by about this much; nothing counts beyond it.
BOUND = 400


def digest(text: bytes) -> np.ndarray:
    """257 small numbers: the quartile (0 to 3) of each bucket, and the length code."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    triplets = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(24)
    counts = np.bincount(triplets, minlength=BUCKETS)
    cuts = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = min(255, int(math.log(len(text) + 1) / math.log(1.1)))
    return np.append((counts[:, None] > cuts).sum(axis=1), code)


def written(d: np.ndarray) -> str:
    """Hex: a byte of length code, then four buckets to a byte."""
    q = d[:-1].reshape(-1, 4)
    return bytes([int(d[-1]), *(q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).tolist()]).hex()


def read(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8).astype(np.int64)
    return np.append((raw[1:, None] >> np.array([0, 2, 4, 6]) & 3).ravel(), raw[0])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 at the bound. Opposite quartiles count six, one step of length (a tenth) one."""
    steps = np.abs(a - b)
    return 1.0 - min(BOUND, int(steps.sum()) + 3 * int((steps[:-1] == 3).sum())) / BOUND


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as much of the beginning of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _range_of(key: Column, bounds: list[int]) -> tuple[Column, Column]:
    """Which of the ranges that begin at ``bounds`` holds the key, and whether it is the first key there."""
    width = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    coarse = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), lambda b: b <= key)) - 1
    fine = F.get(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), coarse)
    place = F.size(F.filter(fine, lambda b: b <= key)) - 1
    return (coarse * width + place).cast("int"), F.get(fine, place) == key


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Digests of each document, of its edited text and of the next document, and their likeness."""
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))
    found = docs.agg(F.min(key), F.percentile_approx(key, [i / ranges for i in range(1, ranges)] or [0.5], 10 * max(ranges, 100))).first()
    bounds = sorted({found[0], *((found[1] or []) if ranges > 1 else [])} - {None}) or [0]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"), key.alias("_key"))
    place, begins = _range_of(F.col("_key"), bounds)
    own = F.struct(place.alias("range"), F.lit(0).alias("after"))
    before = F.struct(((place + len(bounds) - 1) % len(bounds)).alias("range"), F.lit(1).alias("after"))
    dealt = rows.withColumn("_to", F.explode(F.when(begins, F.array(own, before)).otherwise(F.array(own)))).select("doc_id", "text", "_key", F.col("_to.range").alias("_range"), F.col("_to.after").alias("_after"))
    ordered = dealt.repartitionById(len(bounds), F.col("_range")).sortWithinPartitions("_after", "_key", "text").select("doc_id", "text", "_after")

    def one(doc: int | None, text: str, mine: np.ndarray, following: str, other: np.ndarray) -> tuple:
        new = edited(text, following).encode()
        changed = digest(new)
        return doc, len(text), hashlib.sha256(new).hexdigest(), written(mine), written(changed), likeness(mine, changed), likeness(mine, other)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for doc, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = digest(text.encode())
                if last is not None:
                    out.append(one(*last, text, now))
                last = None if after else (doc, text, now)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    ship_code(docs.sparkSession)
    return ordered.mapInArrow(pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
