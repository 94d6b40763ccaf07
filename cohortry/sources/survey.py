"""Survey tables: what they must look like, and a survey view over the star schema."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators.features import build_background


@dataclass(frozen=True)
class SurveySpec:
    """A positional questionnaire export: names by position, keywords that headers must hold, items and their direction, free texts,
    banded columns with their bands in order, and columns that are flags where an answer starts with a stem."""

    names: tuple[str, ...]
    keywords: dict[int, str] = field(default_factory=dict)
    items: tuple[str, ...] = ()
    reversed_items: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    bands: dict[str, list[str]] = field(default_factory=dict)
    flags: dict[str, str] = field(default_factory=dict)
    low: int = 1
    high: int = 5


def validate_schema(df: DataFrame, spec: SurveySpec) -> list[str]:
    """The headers; raises if there are more or fewer columns, or one lacks its keyword. Nothing is read."""
    if len(df.columns) != len(spec.names):
        raise ValueError(f"{len(df.columns)} columns, not {len(spec.names)}")
    if wrong := [(i, c) for i, c in enumerate(df.columns) if spec.keywords.get(i, "").lower() not in c.lower()]:
        raise ValueError("headers without their keyword: " + ", ".join(f"{i}: {c!r}" for i, c in wrong))
    return list(df.columns)


def named(df: DataFrame, spec: SurveySpec) -> DataFrame:
    """Columns renamed by position, items cast to int (what is no integer becomes null), and the background built: texts trimmed, flags as 0/1, bands numbered in ``<name>_ord``."""
    validate_schema(df, spec)
    out = df.toDF(*spec.names)
    out = out.withColumns({c: F.expr(f"try_cast(`{c}` AS int)") for c in spec.items})
    return build_background(out, list(spec.texts), spec.flags, spec.bands)


def sheet(spark: SparkSession, rows) -> DataFrame:
    """A workbook's sheet, which pandas holds whole, as text columns; empty cells are null."""
    cells = [[None if v is None or v != v else str(v) for v in row] for row in rows.itertuples(index=False)]
    return spark.createDataFrame(cells, ", ".join(f"`{c}` string" for c in rows.columns))


def read_survey(spark: SparkSession, path: str, spec: SurveySpec) -> DataFrame:
    """CSV (header, byte-order mark allowed), Parquet or JSON by extension; workbooks only if pandas can read them here."""
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        return named(sheet(spark, pd.read_excel(path, dtype=object)), spec)
    if path.endswith(".json"):
        return named(spark.read.json(path, multiLine=True), spec)
    if path.endswith(".parquet"):
        return named(spark.read.parquet(path), spec)
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return named(raw.toDF(*[c.lstrip("﻿") for c in raw.columns]), spec)


def resolve_path(explicit: str | None = None, variable: str = "SURVEY_DATA", folders: tuple[str, ...] = (".",), patterns: tuple[str, ...] = ("*.parquet", "*.csv", "*.xlsx")) -> str:
    """The given path, else that in the environment, else the first match, sorted, in the folders."""
    import os
    from pathlib import Path

    if explicit or os.environ.get(variable):
        return explicit or os.environ[variable]
    for folder in folders:
        for pattern in patterns:
            if found := sorted(Path(folder).glob(pattern)):
                return str(found[0])
    raise FileNotFoundError(f"no survey in {folders}")


#: The survey view over the star schema. Items: (name, measure, four cuts); the answer is one more than the cuts reached.
ITEMS = (
    ("i1", "n_orders", (7, 9, 11, 13)), ("i2", "n_urgent", (1, 2, 3, 4)), ("i3", "n_high", (1, 2, 3, 4)), ("i4", "n_medium", (1, 2, 3, 4)), ("i5", "n_unspecified", (1, 2, 3, 4)), ("i6", "n_low", (1, 2, 3, 4)),
    ("i7", "n_filled", (2, 3, 4, 6)), ("i8", "n_open", (2, 3, 4, 6)), ("i9", "n_lines", (28, 36, 44, 52)), ("i10", "quantity", (700, 920, 1120, 1350)), ("i11", "discount_cents", (140, 180, 220, 270)), ("i12", "tax_cents", (110, 145, 175, 215)),
)
ITEM_NAMES = [i for i, _, _ in ITEMS]
REVERSED = ["i8", "i9"]
SUBSCALES = {"volume": ["i1", "i9", "i10"], "priority": ["i2", "i3", "i4"], "routine": ["i5", "i6"], "status": ["i7", "i8"], "money": ["i11", "i12"]}
BACKGROUND = ["year", "gender", "living", "department", "backlog"]


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: row_id, background, and twelve items of 1 to 5 as they were answered."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"), F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("t")
    )
    is_ = lambda c, v: F.count(F.when(F.col(c).startswith(v), 1))
    orders = read("orders").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders"), *[is_("o_orderpriority", str(i + 1)).alias(m) for i, m in enumerate(("n_urgent", "n_high", "n_medium", "n_unspecified", "n_low"))], is_("o_orderstatus", "F").alias("n_filled"), is_("o_orderstatus", "O").alias("n_open"),
        F.sum("n").alias("n_lines"), F.sum("q").alias("quantity"), F.sum("d").alias("discount_cents"), F.sum("t").alias("tax_cents"),
    )
    joined = read("customer").join(orders, "c_custkey", "left").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    value = lambda m: F.coalesce(F.col(m), F.lit(0))
    item = lambda m, cuts: reduce(lambda a, b: a + b, [(value(m) >= c).cast("int") for c in cuts]) + 1
    return joined.select(
        F.col("c_custkey").alias("row_id"), (value("n_orders") % 4 + 1).cast("int").alias("year"), (F.abs(F.col("c_acctbal") * 100).cast("long") % 5 + 1).cast("int").alias("band"),
        F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd").alias("gender"), F.col("c_mktsegment").alias("living"), F.col("n_name").alias("department"), (value("n_filled") >= 4).cast("int").alias("backlog"),
        *[item(m, cuts).cast("int").alias(i) for i, m, cuts in ITEMS],
    )


def _item_sql(measure: str, cuts: tuple[int, ...]) -> str:
    return " + ".join(f"(coalesce({measure}, 0) >= {c})::INT" for c in cuts) + " + 1"


#: The same view, for DuckDB: starts a WITH list.
SURVEY_SQL = f"""WITH li AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity::BIGINT) AS q, sum(round(l_discount * 100)::BIGINT) AS d, sum(round(l_tax * 100)::BIGINT) AS t FROM lineitem GROUP BY 1),
od AS (SELECT o_custkey, count(*) AS n_orders, {", ".join(f"count(*) FILTER (o_orderpriority LIKE '{i + 1}%') AS {m}" for i, m in enumerate(("n_urgent", "n_high", "n_medium", "n_unspecified", "n_low")))},
  count(*) FILTER (o_orderstatus = 'F') AS n_filled, count(*) FILTER (o_orderstatus = 'O') AS n_open,
  sum(n) AS n_lines, sum(q) AS quantity, sum(d) AS discount_cents, sum(t) AS tax_cents FROM orders LEFT JOIN li ON l_orderkey = o_orderkey GROUP BY 1),
survey AS (SELECT c_custkey AS row_id, (coalesce(n_orders, 0) % 4 + 1)::INT AS year, (trunc(abs(c_acctbal * 100))::BIGINT % 5 + 1)::INT AS band,
  CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS gender, c_mktsegment AS living, n_name AS department, (coalesce(n_filled, 0) >= 4)::INT AS backlog,
  {", ".join(f"({_item_sql(m, cuts)})::INT AS {i}" for i, m, cuts in ITEMS)}
  FROM customer LEFT JOIN od ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
aligned AS (SELECT * REPLACE (6 - i8 AS i8, 6 - i9 AS i9) FROM survey),
lab AS (SELECT *, CASE WHEN {" + ".join(ITEM_NAMES)} >= 40 THEN 0 WHEN {" + ".join(ITEM_NAMES)} >= 33 THEN 1 ELSE 2 END AS cluster FROM aligned)"""


def clean_export(df: DataFrame, spec: SurveySpec) -> DataFrame:
    """Short names; text nulls become empty."""
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in spec.texts else F.col(c) for c in spec.names])
