"""Spark sessions, and how this package reaches the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "cohortry", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution. Shuffle partitions are Spark's own default unless given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once per Spark context, for operators that run Python there."""
    context = spark.sparkContext
    if getattr(context, "_cohortry_shipped", False):
        return
    package = Path(__file__).parent
    name = os.path.join(tempfile.mkdtemp(prefix="cohortry-code-"), "cohortry_code.zip")
    with zipfile.ZipFile(name, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(Path(package.name) / file.relative_to(package)))
    context.addPyFile(name)
    context._cohortry_shipped = True
