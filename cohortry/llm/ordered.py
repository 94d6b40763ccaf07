"""Places and running sums over a table in sorted order, without a key or the whole table meeting in one task.

Rows are dealt to ranges of (key, order), so a key with a third of the rows spans many ranges. Each range is scanned by
numpy; what the ranges before it hold of the same key is added afterwards. Only keys that span ranges need that, one to
a boundary at most, so the table that is broadcast has at most two rows for each range, whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.llm.common import stage
from cohortry.session import ship_code

#: A Mersenne prime: sums of many residues are taken in two halves, products in 31-bit parts.
PRIME = (1 << 61) - 1


def modular_cumsum(x: np.ndarray, prime: int = PRIME) -> np.ndarray:
    """Inclusive running sums of residues, modulo ``prime`` (:data:`PRIME`, or one below 2^31). ``x`` may have up to 2^31 entries."""
    low, high = np.cumsum(x & np.uint64((1 << 32) - 1)), np.cumsum(x >> np.uint64(32))
    p = np.uint64(prime)
    if prime == PRIME:
        high = high % p
        high = ((high << np.uint64(32)) & p) + (high >> np.uint64(29))  # times 2^32, as 2^61 is 1
        return (high % p + low % p) % p
    return ((high % p) * (np.uint64(1 << 32) % p) % p + low % p) % p


def segment_sums(starts: np.ndarray, sums: np.ndarray, prime: int | None) -> np.ndarray:
    """Running sums that begin anew at ``starts`` (a flag for each entry), from running sums over everything."""
    at = np.maximum.accumulate(np.where(starts, np.arange(len(sums)), 0))
    before = np.where(at > 0, sums[at - 1], 0).astype(sums.dtype)
    return (sums + np.uint64(prime) - before) % np.uint64(prime) if prime else sums - before


def running(df: DataFrame, key: str, order: list[str], values: list[str], name: str, prime: int | None = None) -> DataFrame:
    """``df`` (staged or cheap to read) with ``run_<value>`` for each of ``values``: the sum, this row's included, over the
    rows of the same key (a long, not null) that come no later in ``order``. The values are longs, not null; with ``prime``
    they are residues and so are the sums. Rows that tie in ``order`` are taken one after the other. ``order`` columns
    that ``df`` needs no more can be dropped from the result; they are not sent to Python if they are strings.
    """
    sent = [f.name for f in df.schema.fields if f.dataType.simpleString() not in ("string", "binary")]
    added = [f"run_{v}" for v in values]
    spans = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).select(*sent, F.spark_partition_id().alias("_range"))
    at_key, at_values = sent.index(key), [sent.index(v) for v in values]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, [0] * len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at_key).to_numpy()
            starts = np.concatenate([[True], keys[1:] != keys[:-1]])
            goes_on = np.cumsum(starts) == 1 if last is not None and keys[0] == last else np.zeros(len(keys), bool)
            out = []
            for i, at in enumerate(at_values):
                x = batch.column(at).to_numpy()
                if prime:
                    run = segment_sums(starts, modular_cumsum(x.view(np.uint64), prime), prime)
                    run = np.where(goes_on, (run + np.uint64(carried[i])) % np.uint64(prime), run).view(np.int64)
                else:
                    run = segment_sums(starts, np.cumsum(x), None)
                    run = np.where(goes_on, run + carried[i], run)
                carried[i] = int(run[-1])
                out.append(pa.array(run, pa.int64()))
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *added])

    ship_code(df.sparkSession)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema.fields], *[f"`{a}` long" for a in added]])
    local = stage(spans.mapInArrow(scan, schema), name)
    here = local.groupBy(key, "_range").agg(*[F.sum(F.col(v).cast("decimal(38,0)")).alias(f"_s{i}") for i, v in enumerate(values)])
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    spanning = here.select(F.col(key).alias("_k"), F.col("_range").alias("_r"), *[F.sum(f"_s{i}").over(before).alias(f"_b{i}") for i in range(len(values))]).filter("_b0 is not null")
    joined = local.join(F.broadcast(spanning), (F.col(key) == F.col("_k")) & (F.col("_range") == F.col("_r")), "left")
    total = lambda i: F.col(added[i]) + F.coalesce(F.col(f"_b{i}"), F.lit(0).cast("decimal(38,0)"))
    return joined.select(*sent, *[(total(i) % prime if prime else total(i)).cast("long").alias(a) for i, a in enumerate(added)])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df``, staged, with ``at``: 0, 1, 2, ... in ``order``. Only the ranges' counts meet in one task."""
    kept = df.columns
    spans = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_at"))
    local = stage(spans, name)
    counts = local.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    first = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_first"))
    placed = local.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(first), "_range")
    return placed.select(*kept, (F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("at"))
