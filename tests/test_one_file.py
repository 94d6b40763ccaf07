"""Sinks that give one file, whatever the number of partitions."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from cohortry.sources import sinks
from cohortry.sources.onefile import write_lines


def test_a_table_is_one_csv_in_the_order_of_its_partitions(spark, tmp_path):
    rows = [(i, f'a "quoted", {i}' if i % 3 == 0 else " blank " if i % 3 == 1 else None, i / 4, f"line\nbreak {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "n long, `a, b` string, share double, t string").repartitionByRange(7, "n").sortWithinPartitions("n")
    path = tmp_path / "table.csv"
    sinks.save_table(df, str(path))
    raw = path.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\xef\xbb\xbf") == 1
    got = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
    assert got[0] == ["n", "a, b", "share", "t"]
    assert got[1:] == [[str(i), t or "", str(s), x] for i, t, s, x in rows]
    assert [p.name for p in tmp_path.iterdir()] == ["table.csv"]
    sinks.save_table(spark.createDataFrame([], "n long"), str(path))
    assert path.read_bytes() == b"\xef\xbb\xbfn\n"


def test_arff_is_one_file(spark, tmp_path):
    df = spark.range(20).repartitionByRange(4, "id").select(F.col("id").alias("x"), F.lit("it's").alias("n"))
    sinks.write_arff(df, str(tmp_path / "a.arff"), "r", ["x"], {"n": ["it's"]})
    lines = (tmp_path / "a.arff").read_text().splitlines()
    assert lines[:2] == ["@relation r", ""] and lines[lines.index("@data") + 1 :] == [f"{i},'it\\'s'" for i in range(20)]


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    path = tmp_path / "t"
    write_lines(spark.createDataFrame([("old",)], "value string"), str(path))
    bad = spark.range(8).repartition(4).select(F.when(F.col("id") == 5, F.raise_error(F.lit("no"))).otherwise(F.lit("new")).alias("value"))
    with pytest.raises(Exception, match="no"):
        write_lines(bad, str(path))
    assert path.read_text() == "old\n" and [p.name for p in tmp_path.iterdir()] == ["t"]
