"""Tables written between the steps of an iterative job, so that lost executors cost no recomputation and plans stay short."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cohortry-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Staged:
    """A DataFrame written once as Parquet to the shared folder."""

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
    """Lets go of the shuffle files of finished jobs: Spark deletes them when the driver's JVM collects its garbage."""
    spark.sparkContext._jvm.System.gc()
