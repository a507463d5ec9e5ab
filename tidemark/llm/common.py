"""Shared helpers: tables, shared scratch space, hot-safe numbering."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for sessions that name no shared folder, such as local tests.
LOCAL_SCRATCH = "file:///tmp/checkpoints/tidemark"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; only a local session may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or LOCAL_SCRATCH).rstrip("/")


def drop_on_exit(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).deleteOnExit(target)


def drop_now(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


#: Rows of an Arrow batch of whole texts; Spark's own default, ten times that, holds too much text.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has set them itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(TEXT_ROWS))


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a task's function of batches; at its end Arrow gives back the memory that it keeps: the worker goes on."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def frugal_column(run: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """The same for a function of one batch's column."""

    def column(values: pa.Array) -> pa.Array:
        found = run(values)
        pa.default_memory_pool().release_unused()
        return found

    return column


#: Paths of written tables, for each block of :func:`recorded` that is open.
_recorders: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of all tables that are written inside the block."""
    _recorders.append([])
    try:
        yield _recorders[-1]
    finally:
        paths = _recorders.pop()
        if _recorders:
            _recorders[-1] += paths


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    The written table cuts the lineage: later stages do not recompute it, and it
    outlives any executor. It is removed when the session ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_on_exit(spark, path)
    if _recorders:
        _recorders[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Written tables that are removed as soon as a block of code is left."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        found, path = written(df, label)
        self.paths.append(path)
        return found

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            drop_now(self.spark, path)


@contextmanager
def bucketed(df: DataFrame, key: str, label: str) -> Iterator[DataFrame]:
    """``df`` written once into the shared folder, in buckets of ``key``: what is grouped by that key is not shuffled again."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    path, count = f"{scratch(spark)}/{name}", int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drop_on_exit(spark, path)
    df.write.bucketBy(count, key).option("path", path).format("parquet").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")
        drop_now(spark, path)


def numbered(df: DataFrame, key: str, order: list[Column | str], name: str, rows_per_block: int = 100_000) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each value of ``key``, without a task per key.

    Rows of a key are spread over blocks by a hash of their order columns and ranked
    inside each block; prefix sums of the block counts shift the ranks. Any number of
    rows may share one key. Rows that are equal in ``order`` must not all be one key's
    third of the table: the caller passes columns that tell most rows apart.
    """
    from pyspark.sql import Window as W

    total = df.count()
    blocks = max(64, -(-total // rows_per_block))
    names = [c if isinstance(c, str) else None for c in order]
    salted = df.withColumn("_block", F.pmod(F.xxhash64(*[F.col(c) for c in names if c]), F.lit(blocks)).cast("int"))
    sizes = salted.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy(key, "_block").orderBy(*order)))
    return (
        ranked.join(shift, [key, "_block"])
        .withColumn(name, (F.col("_shift") + F.col("_rank") - 1).cast("long"))
        .drop("_block", "_rank", "_shift")
    )
