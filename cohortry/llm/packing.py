"""Best-fit packing of documents into fixed-length sequences by the sum-of-squares rule.

Each document is tokenized once, where Spark reads it; only (id, piece, start, length, checksum) leaves that
task. A piece as long as a sequence fills one by itself and is not grouped. The others, at most one to a document, are dealt by a
hash of id, place and content into groups of a bounded number of pieces, and each group is packed by itself: from long to short, a
piece goes to the open sequence after which the sum over residual gaps of the squared number of open sequences is smallest; it
opens a new sequence only where no open one has room. A group wastes about one sequence at most, whatever the
corpus size. Null or empty texts are one end-of-document token. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import stage
from cohortry.llm.tokens import VOCABULARY, slices, word_ids
from cohortry.session import ship_code

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
ARROW = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
PACKED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, length: int = 4096, end_id: int = 1, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokenizes each whole text, appends ``end_id`` and cuts only what is longer than ``length``."""
    end, width = end_id.to_bytes(4, "little"), 4 * length

    def cut_one(doc: int | None, ids: bytes) -> list[tuple]:
        parts = [ids[at : at + width] for at in range(0, len(ids), width)]
        return [(doc, k, k * length, len(x) // 4, zlib.crc32(x)) for k, x in enumerate(parts)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ids, begins = word_ids(vocabulary).batch(part.column(1))
                out = [cut_one(d, ids[a:b].tobytes() + end) for d, a, b in zip(part.column(0).to_pylist(), begins, begins[1:], strict=False)]
                columns = zip(*(row for rows in out for row in rows), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, ARROW, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    ship_code(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, for items in descending order of length."""
    open_bins = np.zeros(capacity + 1)
    open_bins[0] = -0.5  # a full bin is not an open one: filling one lowers the sum by one more than moving it
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        gaps = open_bins[size:capacity].nonzero()[0]
        if size < capacity and len(gaps):
            gap = int(gaps[(open_bins[gaps] - open_bins[gaps + size]).argmin()]) + size  # ties: the tightest
            at = by_gap[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, at, made = capacity, made, made + 1
        bins[i], offsets[i] = at, capacity - gap
        if rest := gap - size:
            by_gap[rest].append(at)
            open_bins[rest] += 1
    return bins, offsets


def pack(docs: DataFrame, length: int = 4096, end_id: int = 1, vocabulary: str = VOCABULARY, pieces_per_group: int = 32_768) -> DataFrame:
    """One row per piece with its sequence and the offset there.

    Pieces are staged, so that no lost executor has texts tokenized again. Sequence ids are the group's number times 2**32
    plus the place in it, and below zero where one whole piece is the sequence.
    """
    cut = stage(pieces(docs, length, end_id, vocabulary), "pieces")
    groups = max(1, math.ceil(cut.filter(F.col("length") < length).count() / pieces_per_group))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), length)
        return rows.drop(columns="_group").assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    whole = cut.filter(F.col("length") == length).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.filter(F.col("length") < length).withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return rest.groupBy("_group").applyInPandas(fill, PACKED).unionAll(whole)
