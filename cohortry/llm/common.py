"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of one run of ASCII white space (0x20, 0x09-0x0D).
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cohortry-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Staged:
    """A DataFrame written once as Parquet to the shared folder, so that lost executors cost no recomputation."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files. Only when no DataFrame that reads them will run again."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` read back from the shared folder; the files stay until the folder is cleaned."""
    return Staged(df, name).df


def free_shuffles(spark: SparkSession) -> None:
    """Lets go of the shuffle files of results that are staged by now: Spark deletes them when the driver's JVM collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def row_mark(docs: DataFrame) -> Column:
    """A hash of all columns (but maps, which have none) that tells rows of the same id apart; equal rows have equal ones."""
    return F.xxhash64(*[docs[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def text_or_empty(df: DataFrame, col: str = "text") -> Column:
    return F.coalesce(df[col], F.lit(""))


def word_array(text: Column) -> Column:
    """The maximal runs of characters that are not ASCII white space."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
