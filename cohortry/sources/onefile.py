"""A data source that writes one file: tasks write parts, and the commit puts them together in the order of the partitions.

``df.write.format("onefile")`` takes one string column, ``value``; each row is a line. Options: ``path``, a file in a folder that driver and
executors share; ``head``, lines that stand before the rows; ``mark``, true for a byte-order mark. A file that is there is
replaced when the job commits and not before; a failed job leaves it, and no parts. Attempts of a task write parts of their own and only
those that the commit names are used. The parts are copied by one process, a stream at a time: one file cannot be written otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "onefile"


def register(spark: SparkSession) -> None:
    """Makes the format known to the session. The class is made here so that it travels by value to wherever it runs."""
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

    @dataclass
    class Part(WriterCommitMessage):
        partition: int
        file: str

    class Writer(DataSourceWriter):
        def __init__(self, options):
            import uuid

            self.path, self.head, self.mark = options["path"].removeprefix("file://"), options.get("head"), options.get("mark") == "true"
            self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

        def write(self, iterator):
            import os
            import uuid

            from pyspark import TaskContext

            partition = TaskContext.get().partitionId()
            os.makedirs(self.parts, exist_ok=True)
            file = f"{self.parts}/{partition}-{uuid.uuid4().hex}"
            with open(file, "wb") as out:
                for row in iterator:
                    out.write((row[0] or "").encode() + b"\n")
            return Part(partition, file)

        def commit(self, messages):
            import os
            import shutil

            os.makedirs(self.parts, exist_ok=True)
            whole = f"{self.parts}/whole"
            with open(whole, "wb") as out:
                out.write((b"\xef\xbb\xbf" if self.mark else b"") + (f"{self.head}\n".encode() if self.head is not None else b""))
                for part in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
                    with open(part.file, "rb") as rows:
                        shutil.copyfileobj(rows, out, 1 << 20)
            if os.path.isdir(self.path):
                shutil.rmtree(self.path)
            os.replace(whole, self.path)
            shutil.rmtree(self.parts)

        def abort(self, messages):
            import shutil

            shutil.rmtree(self.parts, ignore_errors=True)

    class OneFile(DataSource):
        @classmethod
        def name(cls):
            return NAME

        def schema(self):
            return "value string"

        def writer(self, schema, overwrite):
            return Writer(self.options)

    spark.dataSource.register(OneFile)


def write_lines(lines: DataFrame, path: str, head: str | None = None, mark: bool = False) -> None:
    """The ``value`` column as one file, partitions in order."""
    register(lines.sparkSession)
    writer = lines.select(F.col("value").cast("string").alias("value")).write.format(NAME).option("mark", str(mark).lower())
    (writer.option("head", head) if head is not None else writer).mode("overwrite").save(path)
