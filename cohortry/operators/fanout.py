"""Independent fits as Spark tasks: a table of tasks is dealt out, and each runs a function on a block of rows that all share.

The block is a stated, bounded sample (``most_rows``): resampling methods refit the same rows hundreds of times, so the rows fit one
task and the number of fits is what is distributed. A task that fails gives a row with its error; the others go on.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.session import ship_code


def block(df: DataFrame, cols: list[str], key: str = "row_id", most_rows: int = 20_000, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of the rows, in key order; of more than ``most_rows``, those with the smallest seeded hash."""
    rows = df.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(c) for c in cols])
    found = rows.orderBy(F.xxhash64(F.lit(seed), "_key")).limit(most_rows).toPandas().sort_values("_key", ignore_index=True)
    return found["_key"].to_numpy(), found[cols].to_numpy(float)


def run_tasks(spark: SparkSession, tasks: pd.DataFrame, fn: Callable[[dict, np.ndarray], list[dict]], z: np.ndarray, schema: str) -> DataFrame:
    """``fn`` of each task row and the block gives rows of ``schema``; an ``error`` column is added."""
    ship_code(spark)
    shared = spark.sparkContext.broadcast(z)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for task in batch.to_dict("records"):
                try:
                    out += [{**{n: None for n in names}, **row, "error": None} for row in fn(task, shared.value)]
                except Exception as e:  # one fit's failure is a result
                    out.append({**{n: task.get(n) for n in names}, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[*names, "error"])

    dealt = spark.createDataFrame(tasks).repartition(min(len(tasks), 4 * spark.sparkContext.defaultParallelism))
    return dealt.mapInPandas(run, schema + ", error string")
