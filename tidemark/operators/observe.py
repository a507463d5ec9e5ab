"""From fetches to observations: valid rows, runs of equal states, pairs, the next look."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.documents import schema_violations
from tidemark.functions.expressions import provenance_kind
from tidemark.operators.scans import Scan

IN_TIME = ["observed_at", "id"]


def valid_observations(snapshots: DataFrame, extractions: DataFrame, currency: str = "USD") -> DataFrame:
    """Good fetches whose page state was extracted in the wanted currency."""
    good = snapshots.where(F.col("ok") & F.col("normalized_hash").isNotNull() & F.col("error").isNull())
    wanted = extractions.where(F.col("currency") == currency).select("normalized_hash", "confidence")
    return good.select("source_id", "id", "observed_at", "page_state", "normalized_hash", "provenance").join(wanted, "normalized_hash")


def sound_extractions(extractions: DataFrame, version: str) -> DataFrame:
    """Extractions of one version of the prompt whose document (``data``) has the right shape; the others anchor nothing."""
    sound = F.size(schema_violations(F.col("data"))) == 0
    return extractions.where((F.col("prompt_version") == version) & sound)


def with_runs(valid: DataFrame) -> DataFrame:
    """Add ``run``: it grows wherever the state differs from the one before, and the next row's state and confidence."""
    scan = Scan(valid, ["source_id"], IN_TIME).neighbours({"before_hash": "normalized_hash"}, {"next_state": "page_state", "next_confidence": "confidence"})
    scan.rows = scan.rows.withColumn("changed", (~F.col("before_hash").eqNullSafe(F.col("normalized_hash"))).cast("int"))
    return scan.running({"run": "changed"}, inclusive=True).result().drop("changed", "before_hash")


def observation_runs(valid: DataFrame) -> DataFrame:
    """One row per run of equal states: its first row represents it."""
    first = F.struct(*IN_TIME)
    kinds = F.collect_set(provenance_kind(F.col("provenance")))
    return (
        with_runs(valid)
        .groupBy("source_id", "run")
        .agg(
            F.min_by("id", first).alias("first_id"),
            F.min("observed_at").alias("first_at"),
            F.max("observed_at").alias("last_at"),
            F.min_by("page_state", first).alias("page_state"),
            F.min_by("confidence", first).alias("confidence"),
            F.min_by("next_state", first).alias("next_state"),
            F.min_by("next_confidence", first).alias("next_confidence"),
            F.count("*").alias("rows"),
            F.when(F.size(kinds) > 1, "mixed").otherwise(kinds[0]).alias("provenance"),
        )
    )


def consecutive_pairs(runs: DataFrame) -> DataFrame:
    """Each run but a source's first, beside the run before it."""
    order = W.partitionBy("source_id").orderBy("run")
    back = lambda c: F.lag(c).over(order)
    pairs = runs.select(
        "source_id", "run", back("first_id").alias("from_id"), F.col("first_id").alias("to_id"), F.col("first_at").alias("observed_at"),
        back("page_state").alias("before_state"), F.col("page_state").alias("after_state"),
        back("confidence").alias("before_confidence"), F.col("confidence").alias("after_confidence"), "next_state", "next_confidence",
    )
    return pairs.where("from_id is not null")


def content_dedup(snapshots: DataFrame) -> DataFrame:
    """Good rows with the id that keeps their bytes: the first of the source with the same content."""
    order = W.partitionBy("source_id", "raw_hash").orderBy(*IN_TIME)
    return snapshots.where("ok").select("id", "source_id", "raw_hash", F.first("id").over(order).alias("content_id"), (F.row_number().over(order) == 1).alias("keeps_bytes"))


def with_inherited(rows: DataFrame) -> DataFrame:
    """Add ``normalized_hash``: the row's own, or that of a row of the source with the same content.

    A join with one row per content, so that a content of many rows can be split.
    """
    known = rows.groupBy("source_id", "raw_hash").agg(F.max("own").alias("shared"))
    joined = rows.join(known, ["source_id", "raw_hash"], "left")
    return joined.withColumns({"normalized_hash": F.coalesce("own", "shared"), "inherited": F.col("own").isNull()})
