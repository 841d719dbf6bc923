"""Results written once in the folder that the driver and all executors share, to be read by whatever needs them next."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/allelith-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def own_folder(spark: SparkSession, name: str) -> str:
    """A new name within the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "cut") -> DataFrame:
    """df computed once, its lineage cut by a table in the shared folder. (A checkpoint would compute its last stage twice, and
    the planner wouldn't know its size.)"""
    folder = own_folder(df.sparkSession, name)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of stored results that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
