"""Tables that are written once into the folder that all executors share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of up to this number of rows are broadcast.
SMALL_ROWS = 200_000
#: Rows that a task takes, about, where each of them costs much work: a table of few bytes is otherwise read by few tasks.
TASK_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one may use its own machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or "file:///tmp/checkpoints/tidemark").rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the session ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back: its plan is not run again, and outlives any executor."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(rows: int, each: int | None = None) -> int:
    """The number of tasks for so many rows, at ``each`` (or TASK_ROWS) rows a task."""
    return max(1, math.ceil(rows / (each or TASK_ROWS)))


def dealt(df: DataFrame, key: str, each: int | None = None) -> DataFrame:
    """``df``, a stored table (its rows are counted from footers), dealt by a key to tasks of about ``each`` (or TASK_ROWS) rows, however few its bytes are."""
    return df.repartition(tasks_for(df.count(), each), key)


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table, marked for broadcast if it is small."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df
