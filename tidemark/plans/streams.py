"""Registered streaming queries; a batch over the same rows is their equivalent."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.plans import lenses
from tidemark.plans.catalogue import PAIRS_SQL, RUNS_SQL, _pairs, query
from tidemark.sources.storage import new_folder, tasks_for
from tidemark.streaming import alerts, archive
from tidemark.streaming.runs import drained, opened_runs


@query(f"with {RUNS_SQL} select source_id, run, first_id, page_state, false as late from runs")
def stream_runs(spark, sf_dir):
    """Runs of page states as a stream finds them, with a state per source."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table may be one file
    wanted = lenses.extractions(spark).where("currency = 'USD'").select("page_state")
    rows = lenses.fetched(events).where("ok and error is null").select("source_id", "id", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("micros"), "page_state")
    return drained(opened_runs(rows.join(wanted, "page_state")), new_folder(spark, "stream-runs"))


#: Rows of a file of a stream's input; a batch has as many files as it needs, so that many tasks write and read it.
FILE_ROWS = 100_000
#: Batches that the table is dealt to by a hash of the id: each holds rows of all times, so that all but the first batch are late.
BATCHES = 4


def _maintained(spark: SparkSession, sf_dir: str) -> str:
    """The folder of an archive that a stream of BATCHES batches, out of order, has built."""
    folder = new_folder(spark, "archive")
    events = lenses.table(spark, sf_dir, "events")
    files = tasks_for(events.count() // BATCHES, FILE_ROWS)
    arrivals = [events.where(F.pmod(F.xxhash64("event_id"), F.lit(BATCHES)) == n).repartition(files, "event_id") for n in range(BATCHES)]
    wanted = lenses.extractions(spark).where("currency = 'USD'").select("page_state", "confidence")
    for arrived in arrivals:  # what has arrived is one batch, whatever its files are
        arrived.write.mode("append").parquet(f"{folder}/input")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/input")
        rows = lenses.fetched(stream).where("ok and error is null").join(F.broadcast(wanted), "page_state")  # 16 rows
        archive.maintained(rows.select(*[c.split()[0] for c in archive.OBSERVATION.split(", ")]), folder)
    return folder


@query(f"with {PAIRS_SQL} select source_id, from_id, to_id, before_state, after_state, next_state, next_confidence from pairs")
def incremental_pairs(spark, sf_dir):
    """The pairs of an archive that was built by batches out of order."""
    found = archive.current_pairs(spark, _maintained(spark, sf_dir))
    return found.select("source_id", "from_id", "to_id", "before_state", "after_state", "next_state", "next_confidence")


@query(f"with {PAIRS_SQL} select count(*) as pairs, cast(0 as bigint) as missing, cast(0 as bigint) as extra from pairs")
def rebuild_equals_scratch(spark, sf_dir):
    """How many pairs a batch over all rows finds, and how many of them the archive built by batches lacks or has beyond them."""
    names = ["source_id", "from_id", "to_id", "before_state", "after_state", "next_state", "next_confidence"]
    kept = archive.current_pairs(spark, _maintained(spark, sf_dir)).select(*names, F.lit(1).alias("kept"), F.lit(0).alias("found"))
    scratch = _pairs(spark, sf_dir).select(*names, F.lit(0).alias("kept"), F.lit(1).alias("found"))
    both = kept.unionByName(scratch).groupBy(*names).agg(F.sum("kept").alias("kept"), F.sum("found").alias("found"))
    n = lambda when: F.coalesce(F.sum(when), F.lit(0)).cast("long")
    return both.agg(n(F.col("found")).alias("pairs"), n(F.greatest(F.col("found") - F.col("kept"), F.lit(0))).alias("missing"), n(F.greatest(F.col("kept") - F.col("found"), F.lit(0))).alias("extra"))


#: Slices of time that come one after the other, and how long a row may be late.
SLICES, DELAY_HOURS = 5, 1


@query(f"""with o as (select user_id as source_id, epoch_us(ts) as at_us from events where event_type <> 'error' and user_id % 10 = cast(epoch_us(ts) // 259200000000 as bigint) % 10),
 g as (select source_id, at_us as last_us, lead(at_us) over (partition by source_id order by at_us) as next_us from (select distinct * from o))
 select source_id, last_us, last_us + {alerts.ABSENT_HOURS} * 3600000000 as raised_us from g
 where coalesce(next_us, (select max(at_us) from o) - {DELAY_HOURS} * 3600000000) - last_us > {alerts.ABSENT_HOURS} * 3600000000""")
def absence_alerts(spark, sf_dir):
    """Silences of sources that are seen for three days in every thirty, as timers over several micro-batches raise them."""
    folder = new_folder(spark, "absences")
    at = F.col("ts").cast("timestamp")
    events = lenses.table(spark, sf_dir, "events").where((F.col("event_type") != "error") & (F.col("user_id") % 10 == F.floor(F.unix_micros(at) / 259_200_000_000) % 10)).select(F.col("user_id").alias("source_id"), at.alias("at"))
    first, last, rows = events.agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at")), F.count("*")).head()
    files = tasks_for(rows // SLICES, FILE_ROWS)
    for n in range(SLICES):  # what has arrived is one batch, whatever its files are
        share = F.least(F.floor((F.unix_micros("at") - (first or 0)) * SLICES / ((last or 0) - (first or 0) + 1)), F.lit(SLICES - 1))
        events.where(share == n).repartition(files, "source_id").write.mode("append").parquet(f"{folder}/input")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/input")
        found = drained(alerts.absences(stream, f"{DELAY_HOURS} hours"), folder)
    return found
