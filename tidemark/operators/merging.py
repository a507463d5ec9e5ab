"""Merges into stored tables by natural key, and tables whose versions are swapped by one manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.storage import file_system


def last_of_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the last: upserts in a row leave what the last one wrote."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def upserted(stored: DataFrame, rows: DataFrame, key: list[str], updates: list[str], defaults: dict[str, Column]) -> DataFrame:
    """``stored`` after an upsert of ``rows`` (one row a key): of known keys only ``updates`` change, so that what a run has left on a row
    stays; new keys get ``defaults`` for the columns that ``rows`` lacks."""
    new = rows.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], *[F.col(c).alias(f"_new_{c}") for c in rows.columns if c not in key], F.lit(True).alias("_given"))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
    both = stored.withColumn("_known", F.lit(True)).join(new, on, "full")

    def value(c: str) -> Column:
        if c in key:
            return F.coalesce(F.col(c), F.col(f"_k{key.index(c)}"))
        given = F.col(f"_new_{c}") if c in rows.columns else defaults.get(c, F.lit(None))
        if c in updates:
            return F.when(F.col("_given"), given).otherwise(F.col(c))
        return F.when(F.col("_known"), F.col(c)).otherwise(given)

    return both.select(*[value(c).cast(stored.schema[c].dataType).alias(c) for c in stored.columns])


def inserted(stored: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """``stored`` and the rows of new keys, the first of each; known keys stay as they are."""
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
    return stored.unionByName(first.join(stored.select(*key), key, "left_anti").select(*stored.columns))


def inserted_strictly(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` and ``rows``; a key that is there already, or comes twice, raises."""
    twice = rows.select(*key).unionByName(stored.select(*key).join(rows.select(*key).distinct(), key, "left_semi")).groupBy(*key).count().where(F.col("count") > 1)
    found = twice.select(*key).head(1)
    if found:
        raise ValueError(f"a row with {found[0].asDict()} is there already")
    return stored.unionByName(rows.select(*stored.columns))


def amended(stored: DataFrame, rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``stored`` with ``columns`` of known keys set, to null as well, from ``rows`` (one row a key); other keys are let be."""
    new = rows.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_given"))
    both = stored.join(new, key, "left")
    return both.select(*[F.when(F.col("_given"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])


def published(df: DataFrame, folder: str) -> None:
    """Make ``df`` the table's version: it is written beside the others, then one rename of the manifest swaps them. A reader sees the old
    version or the new one, and so it is if the writer is lost before the end."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{version}")
    fs, fresh = file_system(spark, f"{folder}/_manifest-{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    rename = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    rename[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    _, target = file_system(spark, f"{folder}/_manifest")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, target, rename)


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The published version of a table, if there is one."""
    fs, manifest = file_system(spark, f"{folder}/_manifest")
    if not fs.exists(manifest):
        return None
    stream = fs.open(manifest)
    try:
        version = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return spark.read.parquet(f"{folder}/{version}")
