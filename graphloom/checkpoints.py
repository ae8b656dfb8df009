"""Cut lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary folder in local mode, an error on a cluster."""
    sc = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Grown:
    """A table that grows round by round, as Parquet in the shared folder: all rounds are one scan, however many there are."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.paths, self.schema = spark, f"{shared_folder(spark)}/grown-{uuid.uuid4().hex}", [], None

    def add(self, df: DataFrame) -> DataFrame:
        """Write a round and return it."""
        self.schema = self.schema or df.schema
        self.paths.append(f"{self.folder}/{len(self.paths)}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)
