"""Queries of the paid extraction pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import spending
from tidemark.plans import lenses
from tidemark.plans.catalogue import SNAPSHOTS_SQL, query

#: Budget of the lens in micro-dollars, what the month has cost before the pass, and its limit of calls.
BUDGET, SPENT, LIMIT = 2_000_000, 500_000, 4_000


def _pass(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pending, known, readings): the text of a fetch is its state seen by one of 37 visitors' groups."""
    rows = lenses.snapshots(spark, sf_dir).where("ok and error is null").withColumn("group", F.col("source_id") % 37)
    text = F.concat_ws(":", "raw_key", F.col("group").cast("string"))
    pending = rows.select("id", "observed_at", "provenance", F.when(F.col("k") != 99, F.sha2(text, 256)).alias("normalized_hash"), "k", "group", "raw_key")
    texts = pending.where("normalized_hash is not null").groupBy("normalized_hash").agg(F.first("k").alias("k"), F.first("group").alias("group"), F.first("raw_key").alias("raw_key"))
    cost = spending.token_cost(1_000 + F.length("raw_key") * 10 + F.col("k"), F.lit(200) + F.col("group"))
    readings = texts.select("normalized_hash", (F.col("k") % 10 != 7).alias("ok"), F.when(F.col("k") % 10 == 3, "EUR").otherwise("USD").alias("currency"), cost.cast("long").alias("cost_micros"))
    known = texts.where("k % 10 = 5").select("normalized_hash")
    return pending, known, readings


#: The same pass as a fold over the rows in order, one at a time: calls, spent, exhausted, the texts cached on the way.
_FOLD_SQL = f"""{SNAPSHOTS_SQL}, rows_ as (
 select row_number() over (order by observed_at, id) as rn, id, provenance not like 'wayback:%' as live, k, source_id % 37 as g, raw_key, k <> 99 as content,
  case when k <> 99 then dense_rank() over (order by raw_key, source_id % 37) end as h,
  k % 10 = 5 as known, k % 10 <> 7 as reads, k % 10 = 3 as foreign_, cast(1000 + length(raw_key) * 10 + k + 5 * (200 + source_id % 37) as bigint) as price
 from snapshots where ok and error is null),
 fold as (
 select cast(0 as bigint) as rn, cast(0 as bigint) as calls, cast({SPENT} as bigint) as spent, false as exhausted, false as ended, cast([] as bigint[]) as cached, cast(null as varchar) as outcome, cast(0 as bigint) as cost
 union all
 select r.rn, f.calls + case when act = 'call' then 1 else 0 end, f.spent + case when act = 'call' and r.reads and r.live then r.price else 0 end,
  f.exhausted or (live_asks and f.spent >= {BUDGET}), f.ended or act = 'end',
  case when act = 'call' and r.reads then list_append(f.cached, r.h) else f.cached end,
  case act when 'end' then 'not_reached' when 'call' then case when r.reads then case when r.foreign_ then 'mismatched' else 'extracted' end when r.live then 'degraded' else 'historical_failed' end else act end,
  case when act = 'call' and r.reads then r.price else 0 end
 from fold f join rows_ r on r.rn = f.rn + 1,
  lateral (select not f.ended and r.content and not (r.known or list_contains(f.cached, r.h)) and r.live as live_asks) a,
  lateral (select case when f.ended then 'end' when not r.content then 'no_content' when r.known or list_contains(f.cached, r.h) then 'cached'
   when live_asks and (f.exhausted or f.spent >= {BUDGET}) then 'skipped' when f.calls >= {LIMIT} then 'end' else 'call' end as act) b)"""


@query(f"with recursive {_FOLD_SQL} select r.id, f.outcome, f.cost as cost_micros from fold f join rows_ r using (rn)")
def extraction_outcomes(spark, sf_dir):
    """What every pending row comes to in one pass under a budget and a limit of calls."""
    found = spending.extraction_outcomes(*_pass(spark, sf_dir), spent=SPENT, budget=BUDGET, limit=LIMIT)
    return found.select("id", "outcome", "cost_micros")


@query(f"""with recursive {_FOLD_SQL} select count(*) filter (outcome <> 'not_reached') as considered, count(*) filter (outcome = 'cached') as cached, count(*) filter (outcome = 'skipped') as skipped,
 count(*) filter (outcome in ('extracted', 'mismatched')) as extracted, count(*) filter (outcome = 'mismatched') as mismatched, count(*) filter (outcome = 'degraded') as degraded,
 count(*) filter (outcome = 'historical_failed') as historical_failed, cast(coalesce(sum(cost), 0) as bigint) as cost_micros
 from (select f.outcome, f.cost from fold f join rows_ r using (rn))""")
def extraction_pass(spark, sf_dir):
    """The pass in one row."""
    return spending.pass_summary(spending.extraction_outcomes(*_pass(spark, sf_dir), spent=SPENT, budget=BUDGET, limit=LIMIT))


@query(f"""with {SNAPSHOTS_SQL} select id, case when k = 99 then 'no_content' when k % 10 = 5 then 'cached' else 'skipped' end as outcome, cast(0 as bigint) as cost_micros from snapshots where ok and error is null""")
def extraction_dry_run(spark, sf_dir):
    """A dry run, like a pass that is switched off, reads the cache and pays for nothing."""
    return spending.extraction_outcomes(*_pass(spark, sf_dir), dry_run=True).select("id", "outcome", "cost_micros")
