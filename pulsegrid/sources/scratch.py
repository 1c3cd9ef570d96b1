"""Tables between the steps of an iteration, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; only a local session may do without that setting."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pulsegrid-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and lost executors lose none of it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, each: int, *keys: str) -> DataFrame:
    """df dealt by keys to so many partitions that each has about ``each`` of the ``rows`` rows that its task is to hold, and every core has one.

    A number of partitions that stays as it is while tables grow, as that of a session does, lets the memory of a task grow with them.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), *keys)


class Steps:
    """The tables of an iteration: each is written to the shared folder, and the one before it goes once its successor is there."""

    def __init__(self, name: str) -> None:
        self.name, self.path = name, None

    def write(self, df: DataFrame) -> DataFrame:
        spark, before = df.sparkSession, self.path
        self.path = shared_path(spark, self.name)
        df.write.parquet(self.path)
        if before:
            deleted(spark, before)
        return spark.read.schema(df.schema).parquet(self.path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``shared_path`` has named."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
