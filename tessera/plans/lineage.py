"""Cutting a plan where several parts of a query read the same intermediate result, and a place for what queries write."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session without one takes a temporary folder; on a cluster that would be no folder
    that all executors share."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that executors and driver share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one; its name is new at each call."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of what is no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, marked for broadcast where it has at most so many rows; else the join shuffles. Reads df, so cut it before."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
