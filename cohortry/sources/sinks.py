"""Sinks: CSV tables with a byte-order mark, ARFF, JSON documents, Markdown summaries."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.sources.onefile import write_lines


def csv_lines(df: DataFrame) -> tuple[str, DataFrame]:
    """The header, and each row as a line (``value``): quoted where a comma, a quote or a break needs it, null as nothing."""

    def cell(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike('[",\r\n]|^\\s|\\s$'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    quoted = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c
    return ",".join(map(quoted, df.columns)), df.select(F.concat_ws(",", *[cell(df[f"`{c}`"]) for c in df.columns]).alias("value"))


def save_table(df: DataFrame, path: str, show: int = 0) -> None:
    """One CSV file in UTF-8 with a byte-order mark and a header, rows in the order of the partitions. ``show`` rows are printed."""
    head, lines = csv_lines(df)
    write_lines(lines, path, head, mark=True)
    if show:
        df.show(show, truncate=False)


def _arff_name(name: str) -> str:
    return name if name.replace("_", "").isalnum() else "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def arff_rows(df: DataFrame, numeric: list[str], nominal: dict[str, list[str]], strings: list[str]) -> DataFrame:
    """One ``value`` per row: declared columns in order; ``?`` for null, quotes escaped, line breaks as blanks. Other columns are skipped."""

    def quoted(c: str) -> Column:
        text = F.regexp_replace(F.col(c).cast("string"), r"[\r\n]+", " ")
        return F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))

    cells = [F.col(c).cast("string") for c in numeric] + [quoted(c) for c in [*nominal, *strings]]
    return df.select(F.concat_ws(",", *[F.coalesce(c, F.lit("?")) for c in cells]).alias("value"))


def arff_header(relation: str, numeric: list[str], nominal: dict[str, list[str]], strings: list[str]) -> str:
    level = lambda v: "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    lines = [f"@relation {_arff_name(relation)}", ""] + [f"@attribute {_arff_name(c)} numeric" for c in numeric]
    lines += [f"@attribute {_arff_name(c)} {{{','.join(map(level, levels))}}}" for c, levels in nominal.items()] + [f"@attribute {_arff_name(c)} string" for c in strings]
    return "\n".join([*lines, "", "@data"])


def write_arff(df: DataFrame, path: str, relation: str, numeric: list[str], nominal: dict[str, list[str]] | None = None, strings: list[str] | None = None) -> None:
    """One ARFF file: the header, then the rows in the order of the partitions."""
    nominal, strings = nominal or {}, strings or []
    write_lines(arff_rows(df, numeric, nominal, strings), path, arff_header(relation, numeric, nominal, strings))


def rules_text(rules: list[dict]) -> str:
    """A tree's leaves as text, one to a line, the largest first."""
    return "".join(f"{r['rule']} => {r['label']:g} (n={r['n']}, purity {r['purity_pct']:.1f} %)\n" for r in sorted(rules, key=lambda r: (-r["n"], r["rule"])))


def jsonable(x):
    """Plain JSON values from numpy and pandas ones; what is no finite number becomes null."""
    if isinstance(x, dict):
        return {str(k): jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [jsonable(v) for v in x]
    if hasattr(x, "tolist"):
        return jsonable(x.tolist())
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


def save_json(document: dict, path: str) -> None:
    Path(path).write_text(json.dumps(jsonable(document), indent=1, ensure_ascii=False), encoding="utf-8")


def summary(results: dict, title: str = "Segmentation") -> str:
    """A Markdown narrative of a results document: one section for each of its parts."""
    lines = [f"# {title}"]
    for name, part in jsonable(results).items():
        lines += ["", f"## {name}"]
        lines += [f"- {k}: {v}" for k, v in part.items()] if isinstance(part, dict) else [f"- {v}" for v in part] if isinstance(part, list) else [str(part)]
    return "\n".join(lines) + "\n"
