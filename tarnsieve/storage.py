"""The folder that the driver and all executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; one of our own only where it is unset (local runs)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder which driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tarnsieve-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{checkpoint_root(spark)}/tarnsieve/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read again: its lineage ends there, and a lost
    executor costs nothing that was written.  `scratch`, `discard` and `remove_folders` clear what is no
    longer needed."""
    folder = new_folder(df.sparkSession, tag)
    if (under_way := _SCRATCH.get()) is not None:
        under_way.add(folder)
    df.write.parquet(folder)
    result = df.sparkSession.read.schema(df.schema).parquet(folder)
    result._tarnsieve_folder = folder
    return result


_SCRATCH: ContextVar[set[str] | None] = ContextVar("tarnsieve-scratch", default=None)


def discard(df: DataFrame) -> None:
    """Deletes what `written` made df from; df can't be read any more."""
    files, at = hadoop_path(df.sparkSession, df._tarnsieve_folder)
    files.delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end every folder written inside it, but for those of the DataFrames handed to what it gives:

        with scratch(spark) as keep:
            result = written(many_steps(), "result")
            keep(result)
    """
    kept: set[str] = set()
    outer = _SCRATCH.get()
    token = _SCRATCH.set(set())
    try:
        yield lambda *frames: kept.update(f._tarnsieve_folder for f in frames)
    finally:
        folders = _SCRATCH.get()
        _SCRATCH.reset(token)
        for folder in folders - kept:
            files, at = hadoop_path(spark, folder)
            files.delete(at, True)
        if outer is not None:
            outer |= folders & kept


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, for any store that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove_folders(spark: SparkSession) -> None:
    """Deletes everything that this library has written to the shared folder."""
    files, at = hadoop_path(spark, f"{checkpoint_root(spark)}/tarnsieve")
    files.delete(at, True)
