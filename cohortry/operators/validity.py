"""Cluster validity with given labels.

Indices that need centroids only are groupings and run at any size. The exact silhouette and Gower's neighbours compare all
pairs that they are asked for (Gower's: of different rows of values), a pair of groups of rows at a time, as matrices; :func:`simplified_silhouette` has centroids in place of rows and one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cohortry.functions.expressions import DIGITS, rounded
from cohortry.operators.describe import unpivot
from cohortry.session import ship_code
from cohortry.staging import stage


def _distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b, strict=True)]))


def vector_columns(df: DataFrame, array: str, size: int, prefix: str = "x") -> tuple[DataFrame, list[str]]:
    """The elements of an array column as columns of doubles."""
    cols = [f"{prefix}{i}" for i in range(size)]
    return df.select("*", *[F.get(array, F.lit(i)).cast("double").alias(c) for i, c in enumerate(cols)]), cols


def centroids(df: DataFrame, cols: list[str], label: str = "cluster") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in cols])


def _packed(rows: DataFrame, size: int, most: int, name: str) -> DataFrame:
    """part, keys, labels, x: up to ``most`` rows of a partition each, staged; ``rows``: a long, an int and an array of ``size`` doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([part.column(1).to_numpy().astype(np.int32).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["part", "keys", "labels", "x"])
                number += 1

    ship_code(rows.sparkSession)
    return stage(rows.mapInArrow(pack, "part long, keys binary, labels binary, x binary"), name)


def paired(packed: DataFrame, most_groups: int, group_rows: int) -> DataFrame:
    """Parts dealt into groups of about ``group_rows`` rows, or ``most_groups`` larger ones, and sent to each pair of groups (i <= j) that theirs is in; ``asks``: whether it is the pair's i.

    Every part is sent once to each group, so what is shuffled grows as the rows do; only the products grow as their square."""
    told = packed.select("part", (F.octet_length("keys") / 8).cast("long").alias("n")).orderBy("part").collect()  # one for each part
    groups = min(most_groups, max(1, math.ceil(sum(r["n"] for r in told) / group_rows)), max(1, len(told)))
    names = packed.sparkSession.createDataFrame([(r["part"], at % groups) for at, r in enumerate(told)], "part long, g int")
    dealt = packed.join(F.broadcast(names), "part")
    g, other = F.col("g"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_o")
    sent = dealt.select("*", other).select(F.least(g, "_o").alias("i"), F.greatest(g, "_o").alias("j"), (g <= F.col("_o")).alias("asks"), "part", *[c for c in packed.columns if c != "part"])
    return sent.repartition(groups * (groups + 1) // 2, "i", "j")


def side(table: pa.Table, asks: bool, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, labels (empty where there are none) and values of one side of a pair of groups, by key."""
    rows = sorted((r for r in table.to_pylist() if r["asks"] == asks), key=lambda r: r["part"])
    join = lambda c, kind: np.frombuffer(b"".join(r.get(c) or b"" for r in rows), kind)
    keys, labels, x = join("keys", np.int64), join("labels", np.int32), join("x", float).reshape(-1, size)
    order = np.argsort(keys, kind="stable")
    return keys[order], labels[order] if len(labels) else labels, x[order]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; those that a product of rows would blur are measured again."""
    own, other = (a * a).sum(1), (b * b).sum(1)
    d = a @ (-2 * b.T)
    d += own[:, None]
    d += other
    close = np.nonzero(d < 1e-6 * (own[:, None] + other))
    if len(close[0]):
        for at in range(0, len(close[0]), 1 << 16):
            i, j = close[0][at : at + (1 << 16)], close[1][at : at + (1 << 16)]
            d[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return np.sqrt(d, out=d)


def silhouette_rows(df: DataFrame, cols: list[str], label: str = "cluster", key: str = "row_id", block_rows: int = 4_096, most_groups: int = 24) -> DataFrame:
    """Per row: a, b and the Euclidean silhouette; a row alone in its cluster has 0. Pairs of groups of rows are matrix products; a
    row's sums per cluster are all that leaves them. Rows without a label or with a gap in their values are no one's neighbours and have 0."""
    values = F.array(*[F.col(c).cast("double") for c in cols])
    wide = stage(df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_l"), values.alias("x"), F.monotonically_increasing_id().alias("_row")), "silhouette-rows")
    whole = F.forall("x", lambda v: v.isNotNull())
    told = wide.filter(whole & F.col("_l").isNotNull()).groupBy("_l").count().orderBy("_l").collect()  # the clusters
    spark, size, k, counts = df.sparkSession, len(cols), len(told), [r["count"] for r in told]
    numbers = spark.createDataFrame([(r["_l"], c) for c, r in enumerate(told)], StructType([StructField("_l", df.schema[label].dataType), StructField("_c", IntegerType())]))
    marked = wide.join(F.broadcast(numbers), "_l", "left")
    if not k or wide.limit(2).count() < 2:
        lone = wide.limit(0) if wide.limit(2).count() < 2 else wide
        return lone.select(F.col("_key").alias(key), F.col("_l").alias(label), *[F.lit(None).cast("double").alias(c) for c in "ab"], F.lit(0.0).alias("silhouette"))
    packed = _packed(marked.filter(whole & F.col("_c").isNotNull()).select("_row", "_c", "x"), size, block_rows, "silhouette-parts")

    def near(table: pa.Table) -> pa.Table:
        keys_a, labels_a, a = side(table, True, size)
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        keys_b, labels_b, b = (keys_a, labels_a, a) if same else side(table, False, size)
        member = np.eye(k)[labels_b]
        back = None if same else np.zeros((len(b), k))
        out, step = [], max(16, (1 << 21) // max(1, len(b)))
        for at in range(0, len(a), step):
            d = _distances(a[at : at + step], b)
            if same:
                d[np.arange(len(d)), np.arange(at, at + len(d))] = 0
            else:
                back += d.T @ np.eye(k)[labels_a[at : at + step]]
            out.append(d @ member)
        keys, sums = (keys_a, np.vstack(out)) if same else (np.concatenate([keys_a, keys_b]), np.vstack([*out, back]))
        return pa.table({"_row": pa.array(keys), "sums": pa.array(list(sums), pa.list_(pa.float64()))})

    parts = paired(packed, most_groups, block_rows).groupBy("i", "j").applyInArrow(near, "_row long, sums array<double>")
    added = parts.groupBy("_row").agg(F.array(*[F.sum(F.get("sums", F.lit(c))) for c in range(k)]).alias("sums"))
    sizes = F.array(*[F.lit(float(n)) for n in counts])
    each = F.zip_with("sums", sizes, lambda s, n: F.struct(s.alias("s"), n.alias("n")))
    both = marked.join(added, "_row", "left").select("_key", "_l", "_c", F.transform(each, lambda z, c: F.struct(c.alias("c"), z["s"].alias("s"), z["n"].alias("n"))).alias("z"))
    own = F.get("z", F.col("_c"))
    a = F.when(own["n"] > 1, own["s"] / (own["n"] - 1))
    b = F.array_min(F.transform(F.filter("z", lambda z: z["c"] != F.col("_c")), lambda z: z["s"] / z["n"]))
    told = both.select(F.col("_key").alias(key), F.col("_l").alias(label), a.alias("a"), b.alias("b"))
    return told.withColumn("silhouette", F.when(F.greatest("a", "b") > 0, F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0))).otherwise(0.0))


def silhouette(df: DataFrame, cols: list[str], label: str = "cluster", key: str = "row_id", block_rows: int = 4_096) -> DataFrame:
    """Per cluster and over all: mean silhouette and share of negative rows."""
    rows = silhouette_rows(df, cols, label, key, block_rows)
    rolled = rows.rollup(label).agg(F.grouping_id().alias("_all"), F.count("*").alias("n"), rounded(F.avg("silhouette")).alias("silhouette"), rounded(100.0 * F.avg((F.col("silhouette") < 0).cast("double"))).alias("pct_negative"))
    return rolled.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col(label).cast("string")).alias("cluster"), "n", "silhouette", "pct_negative")


def simplified_silhouette(df: DataFrame, cols: list[str], label: str = "cluster") -> DataFrame:
    """As the silhouette, with distances to centroids (k rows, broadcast): one pass at any size."""
    c = centroids(df, cols, label).agg(F.collect_list(F.struct(F.col(label).alias("c"), F.array(*cols).alias("m"))).alias("_centres"))
    d = lambda m: F.sqrt(F.aggregate(F.zip_with(F.array(*cols), m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x))
    near = df.join(F.broadcast(c), F.lit(True)).select(F.col(label).alias("cluster"), F.transform("_centres", lambda z: F.struct(z["c"].alias("c"), d(z["m"]).alias("d"))).alias("z"))
    a = F.get(F.filter("z", lambda x: x["c"] == F.col("cluster")), 0)["d"]
    b = F.array_min(F.transform(F.filter("z", lambda x: x["c"] != F.col("cluster")), lambda x: x["d"]))
    return near.select(a.alias("a"), b.alias("b")).agg(rounded(F.avg(F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0))).alias("silhouette"))


def calinski_harabasz(df: DataFrame, cols: list[str], label: str = "cluster") -> DataFrame:
    """Between and within sums of squares and their index, from counts, means and variances per cluster."""
    long = unpivot(df, [label], cols)
    per = long.groupBy("item", label).agg(F.count("*").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("*")).alias("w"))
    grand = per.withColumn("g", F.sum(F.col("n") * F.col("m")).over(W.partitionBy("item")) / F.sum("n").over(W.partitionBy("item")))
    one = grand.agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("between_ss"), F.sum("w").alias("within_ss"), F.count_distinct(label).alias("k"), (F.sum("n") / F.count_distinct("item")).alias("n"))
    return one.select("k", F.col("n").cast("long").alias("n"), rounded(F.col("between_ss")).alias("between_ss"), rounded(F.col("within_ss")).alias("within_ss"), rounded((F.col("between_ss") / (F.col("k") - 1)) / (F.col("within_ss") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, cols: list[str], label: str = "cluster") -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / centroid distance."""
    c = centroids(df, cols, label)
    own = df.join(F.broadcast(c.select(F.col(label).alias("_c"), *[F.col(x).alias(f"_m_{x}") for x in cols])), F.col(label) == F.col("_c"))
    spread = own.groupBy(label).agg(F.avg(_distance([F.col(x) for x in cols], [F.col(f"_m_{x}") for x in cols])).alias("s"))
    k = c.join(spread, label)
    other = k.select(F.col(label).alias("_c"), F.col("s").alias("_s"), *[F.col(x).alias(f"_m_{x}") for x in cols])
    pairs = k.join(F.broadcast(other), F.col(label) != F.col("_c")).select(label, ((F.col("s") + F.col("_s")) / _distance([F.col(x) for x in cols], [F.col(f"_m_{x}") for x in cols])).alias("r"))
    return pairs.groupBy(label).agg(F.max("r").alias("r")).agg(F.count("*").alias("k"), rounded(F.avg("r")).alias("davies_bouldin"))


def differentiation(df: DataFrame, cols: list[str], label: str = "cluster") -> DataFrame:
    """Share of the between-cluster sum of squares that is shape, not level.

    A cluster's level is the mean over columns of its centroid's deviation; what remains of the deviation is shape.
    """
    long = unpivot(df, [label], cols)
    per = long.groupBy(label, "item").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    dev = per.withColumn("delta", F.col("m") - F.sum(F.col("n") * F.col("m")).over(W.partitionBy("item")) / F.sum("n").over(W.partitionBy("item")))
    level = dev.withColumn("lev", F.avg("delta").over(W.partitionBy(label)))
    one = level.agg(F.sum(F.col("n") * F.pow("lev", 2)).alias("ss_level"), F.sum(F.col("n") * F.pow(F.col("delta") - F.col("lev"), 2)).alias("ss_shape"))
    whole = F.col("ss_level") + F.col("ss_shape")
    return one.select(rounded(F.col("ss_level")).alias("ss_level"), rounded(F.col("ss_shape")).alias("ss_shape"), rounded(whole).alias("between_ss"), rounded(F.when(whole > 0, F.col("ss_shape") / whole).otherwise(0.0)).alias("differentiation"))


def normalised_entropy(df: DataFrame, probabilities: str) -> DataFrame:
    """1 - entropy / (n ln k) of an array column of memberships: 1 when each row is sure."""
    h = F.aggregate(F.transform(probabilities, lambda p: F.when(p > 1e-12, -p * F.ln(p)).otherwise(0.0)), F.lit(0.0), lambda acc, x: acc + x)
    return df.agg(rounded(1 - F.sum(h) / (F.count("*") * F.ln(F.max(F.size(probabilities))))).alias("entropy"))


def canonical_labels(df: DataFrame, cols: list[str], label: str = "cluster") -> DataFrame:
    """Old and new numbers: clusters by descending mean of their centroid, then by the centroid. One row per cluster."""
    c = centroids(df, cols, label)
    mean = F.round(reduce(lambda a, b: a + b, [F.col(x) for x in cols]) / len(cols), 9)
    return c.select(F.col(label).alias("old"), (F.row_number().over(W.orderBy(F.desc(mean), *[F.round(x, 6) for x in cols])) - 1).alias("new"), "n")


def nearest_centroid(df: DataFrame, cols: list[str], centres: list[list[float]], key: str = "row_id") -> DataFrame:
    """Per row: the nearest centre, its distance, and how much farther the second is. Centres are literals: one projection, no join."""
    ds = F.array(*[F.struct(_distance([F.col(c).cast("double") for c in cols], [F.lit(float(v)) for v in m]).alias("d"), F.lit(i).alias("c")) for i, m in enumerate(centres)])
    z = df.select(key, F.sort_array(ds).alias("z"))
    first, second = F.get("z", F.lit(0)), F.get("z", F.lit(1))
    return z.select(key, first["c"].alias("cluster"), rounded(first["d"]).alias("distance"), rounded(second["d"] - first["d"]).alias("margin"))


def half_up(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """As Spark rounds doubles: their shortest decimal form, half up."""
    unit = 10.0**digits
    low = np.floor(x * unit)
    rest = x * unit - low
    out = (low + (rest >= 0.5)) / unit
    close = np.abs(rest - 0.5) < 1e-6
    if close.any():
        values, at = np.unique(x[close], return_inverse=True)
        out[close] = np.array([float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in values])[at]
    return out


def gower_nearest(df: DataFrame, numeric: list[str], categorical: list[str], queries: Column, k: int = 3, key: str = "row_id", block_rows: int = 4_096, most_groups: int = 24) -> DataFrame:
    """For each row that ``queries`` selects, the ``k`` rows nearest by Gower's distance, rounded; ties to the smaller key. Where a value is missing the distance is null and comes last.

    Rows of the same values stand together: each different row of values meets the others once and keeps the ``k`` + 1 nearest; of
    those, the ``k`` + 1 smallest keys are looked at."""
    ranges = df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in numeric]).first()
    used = [c for c in numeric if ranges[c]]
    if not used and not categorical:
        raise ValueError("no column varies")
    shape, widths = [*used, *categorical], [float(ranges[c]) for c in used]
    rows = stage(df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), *shape, F.coalesce(queries, F.lit(False)).alias("_asks")), "gower-rows")
    place = F.row_number().over(W.partitionBy(*shape).orderBy("_key"))
    least = rows.withColumn("_k", place).filter(F.col("_k") <= k + 1).groupBy(*shape).agg(F.sort_array(F.collect_list("_key")).alias("keys"))
    asking = rows.filter("_asks").select(*shape).distinct().withColumn("_asked", F.lit(1))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in shape])
    profiles = stage(least.join(asking, same(least, asking), "left").select(*[least[c] for c in shape], "keys", F.get("keys", F.lit(0)).alias("_id"), F.coalesce("_asked", F.lit(0)).alias("_asked")), "gower-profiles")
    gap = F.lit(math.nan)
    cells = [F.coalesce(F.col(c).cast("double"), gap) for c in used] + [F.when(F.col(c).isNull(), gap).otherwise(F.shiftrightunsigned(F.xxhash64(c), 11).cast("double")) for c in categorical]
    packed = _packed(profiles.select("_id", "_asked", F.array(*cells)), len(shape), block_rows, "gower-parts")

    def nearest(ids, asked, a, others, b, out):
        step = max(1, (1 << 20) // max(1, len(b)))
        chosen = np.flatnonzero(asked)
        for at in range(0, len(chosen), step):
            rows = chosen[at : at + step]
            d = np.zeros((len(rows), len(b)))
            for c in range(len(shape)):
                x, y = a[rows, c, None], b[:, c]
                d += np.abs(x - y) / widths[c] if c < len(widths) else np.where(np.isnan(x) | np.isnan(y), math.nan, x != y)
            d = np.nan_to_num(half_up(d / float(len(shape))), nan=np.inf)
            some = min(k + 1, len(b))
            limit = np.partition(d, some - 1, 1)[:, some - 1 : some]
            for row, own, edge in zip(rows, d, limit, strict=True):
                near_by = np.flatnonzero(own <= edge)
                best = near_by[np.argsort(own[near_by], kind="stable")][:some]
                out.append((int(ids[row]), [{"d": float(own[o]), "o": int(others[o])} for o in best]))

    def near(table: pa.Table) -> pa.Table:
        one, out = side(table, True, len(shape)), []
        same_group = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        two = one if same_group else side(table, False, len(shape))
        nearest(*one, two[0], two[2], out)
        if not same_group:
            nearest(*two, one[0], one[2], out)
        return pa.table({"q0": pa.array([r[0] for r in out], pa.int64()), "found": pa.array([r[1] for r in out], pa.list_(pa.struct([("d", pa.float64()), ("o", pa.int64())])))})

    lists = paired(packed, most_groups, block_rows).groupBy("i", "j").applyInArrow(near, "q0 long, found array<struct<d: double, o: long>>")
    merged = lists.groupBy("q0").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found")).select("q0", F.inline("found"))  # a list from each group
    known = merged.join(profiles.select(F.col("_id").alias("o"), "keys"), "o").groupBy("q0").agg(F.flatten(F.collect_list(F.transform("keys", lambda x: F.struct(F.col("d").alias("d"), x.alias("other"))))).alias("near"))
    named = profiles.filter("_asked = 1").select(*shape, F.col("_id").alias("q0")).join(known, "q0")
    asked = rows.filter("_asks")
    each = asked.join(named, same(asked, named)).select(F.col("_key").alias("q"), F.slice(F.sort_array(F.filter("near", lambda z: z["other"] != F.col("_key"))), 1, k).alias("near"))
    return each.select("q", F.posexplode("near").alias("_at", "z")).select("q", F.col("z.other").alias("other"), F.when(F.col("z.d") < F.lit(math.inf), F.col("z.d")).alias("distance"), (F.col("_at") + 1).alias("place"))
