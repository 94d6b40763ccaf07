"""Scoring new rows, in batch or as a stream, and an incremental audit of a stream of answers."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.expressions import row_mean


@dataclass
class Bundle:
    """A frozen segmentation. ``names`` are by the numbers of ``centres``: the final ones, as they were stored with the labelled rows."""

    items: list[str]
    reversed_items: list[str]
    subscales: dict[str, list[str]]
    means: dict[str, float]
    sds: dict[str, float]
    centres: list[list[float]]
    names: list[str]
    band: str | None = None
    bands: list[str] = field(default_factory=list)
    low: int = 1
    high: int = 5

    @property
    def columns(self) -> list[str]:
        return list(self.means)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Bundle:
        return Bundle(**json.loads(spark.read.text(path).first()[0]))


def _checked(c: str, b: Bundle) -> Column:
    ok = F.col(c).between(b.low, b.high) & (F.col(c) == F.floor(c))
    return F.when(ok, F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c}: no answer from {b.low} to {b.high}: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))))


def score(df: DataFrame, b: Bundle, check: bool = True) -> DataFrame:
    """Adds cluster, persona, distance_to_own_centroid, margin_to_next. One projection: it works on streams as well.

    Missing columns raise at once; an answer out of range or an unknown band raises when its row is read.
    """
    if missing := [c for c in [*b.items, *([b.band] if b.band else [])] if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    kept = df.columns
    read = df.withColumns({f"_{c}": _checked(c, b) if check else F.col(c) for c in b.items})
    read = read.withColumns({f"_{c}": F.lit(b.low + b.high) - F.col(f"_{c}") for c in b.reversed_items})
    made = {f"_f_{s}": row_mean([f"_{c}" for c in cols]) for s, cols in b.subscales.items()} or {f"_f_{c}": F.col(f"_{c}").cast("double") for c in b.items}
    if b.band:
        place = reduce(lambda a, i: F.when(F.col(b.band) == b.bands[i], i + 1).otherwise(a), range(len(b.bands)), F.raise_error(F.concat(F.lit("unknown band: "), F.coalesce(F.col(b.band), F.lit("null")))).cast("int"))
        made[f"_f_{b.band}"] = place.cast("double")
    read = read.withColumns(made)
    z = {c: (F.col(f"_f_{c}") - b.means[c]) / (b.sds[c] or 1.0) for c in b.columns}
    read = read.withColumns({f"_z_{c}": v for c, v in z.items()})
    distance = lambda m: F.sqrt(reduce(lambda x, y: x + y, [(F.col(f"_z_{c}") - v) * (F.col(f"_z_{c}") - v) for c, v in zip(b.columns, m, strict=True)]))
    near = F.sort_array(F.array(*[F.struct(distance(m).alias("d"), F.lit(i).alias("c"), F.lit(n).alias("n")) for i, (m, n) in enumerate(zip(b.centres, b.names, strict=True))]))
    out = read.select(*kept, near.alias("_near"))
    first = F.get("_near", F.lit(0))
    return out.select(*kept, first["c"].alias("cluster"), first["n"].alias("persona"), F.round(first["d"], 3).alias("distance_to_own_centroid"), F.round(F.get("_near", F.lit(1))["d"] - first["d"], 3).alias("margin_to_next"))


def profile_only(df: DataFrame, b: Bundle) -> DataFrame:
    """Cluster and persona without checks, distances or margins."""
    return score(df, b, check=False).drop("distance_to_own_centroid", "margin_to_next")


def audit_stream(stream: DataFrame, time: str, items: list[str], late: str = "1 day", low: int = 1, high: int = 5) -> DataFrame:
    """Per day: rows, nulls and values out of range; late rows count until the watermark has passed."""
    count = lambda f: F.sum(reduce(lambda a, b: a + b, [F.coalesce(f(c).cast("int"), F.lit(0)) for c in items])).cast("long")
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("day")).agg(F.count("*").alias("n"), count(lambda c: F.col(c).isNull()).alias("nulls"), count(lambda c: ~F.col(c).between(low, high)).alias("out_of_range")).select(F.col("day.start").alias("day"), "n", "nulls", "out_of_range")
