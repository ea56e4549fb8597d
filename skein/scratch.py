"""Intermediate tables that cut lineage and survive the loss of executors.

Iterative operators write each round as a Parquet table below the folder that
the session names in ``spark.checkpoint.dir`` (shared by all executors) and
read it back, so that no later plan holds an earlier one.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, True)
    folder = "file://" + folder
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def sweep(spark: SparkSession, hours: float = 48) -> None:
    """Delete the intermediate tables in the shared folder that are older than ``hours``.

    Tables that an operator's result still reads can't be deleted by the
    operator itself, as the result is evaluated later.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/skein")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(top) if fs.exists(top) else ():
        if s.getModificationTime() < (time.time() - hours * 3600) * 1000:
            fs.delete(s.getPath(), True)


class Scratch:
    """Tables of one run of an operator, each below its own name."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/skein/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> str:
        self.count += 1
        path = f"{self.base}/{self.count:04d}"
        df.write.parquet(path)
        return path

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the table that was written."""
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.write(df))

    def clear(self) -> None:
        """Delete all tables of this run, once no later plan reads them."""
        self.drop(self.base)

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work in Python on a table of few, small files.

    A table that Spark already reads in enough partitions is left as it is, so
    that large tables aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
