"""An archive's pairs of states, kept up to date over a stream whose rows come in any order.

Each micro-batch is added to the observations of the archive. What it changes is found by source: a row may
open, close or split a run only after the representative of the last run that begins before it. So a source's pairs from that
one on are superseded by a cut, and derived again from the rows that follow; the rest of the archive is not
read. In-order rows touch the last run of their source only.

Observations, pairs and cuts are folders of one part for each batch, written over if the batch is run again:
a restart repeats nothing. A pair is current if no later cut covers it. Natural keys decide between rows: an
observation that came before, in this batch or another, is not added again, and of changes at one key the first emission stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.observe import consecutive_pairs, observation_runs
from tidemark.sources.storage import file_system, small, written

OBSERVATION = "source_id long, id long, observed_at timestamp_ntz, page_state string, normalized_hash string, provenance string, confidence string"
PAIR = (
    "source_id long, from_id long, to_id long, from_at timestamp_ntz, observed_at timestamp_ntz, before_state string, after_state string, "
    "before_confidence string, after_confidence string, next_state string, next_confidence string"
)
CUT = "source_id long, cut_at timestamp_ntz, cut_id long"


def _table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The parts of all batches, with the number of their batch."""
    fs, at = file_system(spark, f"{folder}/{name}")
    if not fs.exists(at):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/{name}")


def _put(df: DataFrame, folder: str, name: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")


def _position(at: str, id_: str):
    return F.struct(F.col(at).alias("at"), F.col(id_).alias("id"))


def current_pairs(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The pairs that no later cut covers (of the batches before ``before``)."""
    pairs, cuts = _table(spark, folder, "pairs", PAIR), _table(spark, folder, "cuts", CUT)
    if before is not None:
        pairs, cuts = pairs.where(F.col("batch") < before), cuts.where(F.col("batch") < before)
    cuts = cuts.select(F.col("source_id").alias("_source"), F.col("batch").alias("_batch"), "cut_at", "cut_id")
    covered = (F.col("source_id") == F.col("_source")) & (F.col("_batch") > F.col("batch"))
    covered &= F.col("cut_at").isNull() | (_position("observed_at", "to_id") >= _position("cut_at", "cut_id"))
    return pairs.join(cuts, covered, "left_anti").drop("batch")


def apply_batch(rows: DataFrame, batch: int, folder: str) -> None:
    """Add a batch of valid observations (the columns of OBSERVATION) to the archive."""
    spark = rows.sparkSession
    stored = _table(spark, folder, "observations", OBSERVATION).where(F.col("batch") < batch).drop("batch")
    fresh = written(rows.dropDuplicates(["source_id", "id"]).join(stored.select("source_id", "id"), ["source_id", "id"], "left_anti").select(*stored.columns), "archive-fresh")
    touched = fresh.groupBy("source_id").agg(F.min(_position("observed_at", "id")).alias("low"))
    # The last pair that ends before the first new row: from its end on pairs are derived again, from its beginning on rows are read.
    pairs = current_pairs(spark, folder, batch).select("source_id", _position("observed_at", "to_id").alias("end"), _position("from_at", "from_id").alias("begin"))
    last = pairs.join(touched, "source_id").where("end < low").groupBy("source_id").agg(F.max(F.struct("end", "begin")).alias("last"))
    cuts = written(touched.join(last, "source_id", "left").select("source_id", F.col("last.end").alias("end"), F.col("last.begin").alias("begin")), "archive-cuts")
    known = stored.join(small(cuts), "source_id").where(F.col("begin").isNull() | (_position("observed_at", "id") >= F.col("begin"))).select(*stored.columns)
    derived = with_times(known.unionByName(fresh)).join(small(cuts), "source_id")
    derived = derived.where(F.col("end").isNull() | (_position("observed_at", "to_id") >= F.col("end"))).drop("end", "begin")
    _put(derived, folder, "pairs", batch)
    _put(cuts.select("source_id", F.col("end.at").alias("cut_at"), F.col("end.id").alias("cut_id")), folder, "cuts", batch)
    _put(fresh, folder, "observations", batch)


def with_times(valid: DataFrame) -> DataFrame:
    """The consecutive pairs of observations, with the time of the earlier run too: the columns of PAIR."""
    runs = observation_runs(valid)
    earlier = runs.select("source_id", F.col("first_id").alias("from_id"), F.col("first_at").alias("from_at"))
    return consecutive_pairs(runs).join(earlier, ["source_id", "from_id"]).select(*[c.split()[0] for c in PAIR.split(", ")])


def maintained(stream: DataFrame, folder: str, **options: str) -> None:
    """Run the stream over all its input, each micro-batch added to the archive in ``folder``; goes on from the checkpoint there."""
    writer = stream.writeStream.foreachBatch(lambda rows, batch: apply_batch(rows, batch, folder)).option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).options(**options).start().awaitTermination()


def first_emissions(stored: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``found`` whose natural key is not stored yet; the stored ones stay as they are."""
    order = W.partitionBy(*key).orderBy(*[c for c in found.columns if c not in key])
    return found.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth").join(stored.select(*key), key, "left_anti")


def relinked(parked: DataFrame, changes: DataFrame) -> DataFrame:
    """Where notes go after a rebuild: note_id, change_id and fate.

    ``parked``: note_id, source_id, json_path, observed_at, version; ``changes``: change_id and the same key. A note goes to the
    first change of its source, path and time; of notes of one version that meet there the first stays, and the others,
    like those without such a change, are orphans.
    """
    key = ["source_id", "json_path", "observed_at"]
    survivors = changes.groupBy(*key).agg(F.min("change_id").alias("change_id"))
    met = parked.join(survivors, key, "left")
    alone = F.when(F.col("change_id").isNull(), F.col("note_id"))  # orphans do not gather under one key
    nth = F.row_number().over(W.partitionBy("change_id", "version", alone).orderBy("note_id"))
    fate = F.when(F.col("change_id").isNull(), "orphaned").when(nth > 1, "redundant").otherwise("relinked")
    return met.select("note_id", F.when(fate == "relinked", F.col("change_id")).alias("change_id"), fate.alias("fate"))
