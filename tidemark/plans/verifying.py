"""Queries of the two-reading verification: customers are candidate pages, their keys say what each reading finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import verifying
from tidemark.plans import lenses
from tidemark.plans.catalogue import query

#: Micro-dollars for the pass, as a share of what all candidates would cost: the budget ends within the table at every size.
SHARE = 0.7


def _reading(n, turn: int):
    """raised, ok, tiers, confidence, reason and cost of a reading."""
    k = n * (7 + 6 * turn)
    return F.struct(
        (k % 29 == 3).alias("raised"), (k % 11 != 4).alias("ok"), (F.when(n % 5 == 0, 12).otherwise(n % 4 + 1) + F.when(k % 13 == 0, 1).otherwise(0)).cast("int").alias("tiers"),
        F.when(k % 17 == 5, "low").otherwise("high").alias("confidence"), F.concat(F.lit("invalid: "), (k % 7).cast("string")).alias("reason"), (8_000 + k % 4_000).alias("cost"),
    )


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey").cast("long")
    url = F.concat(F.lit("https://c"), F.lpad(n.cast("string"), 12, "0"), F.lit(".example/"))
    return lenses.table(spark, sf_dir, "customer").select(url.alias("url"), (n % 9 != 2).alias("fetched"), F.concat(F.lit("HTTP "), (400 + n % 5).cast("string")).alias("fetch_error"), _reading(n, 0).alias("first"), _reading(n, 1).alias("second"))


def _budget(candidates: DataFrame) -> int:
    return int((candidates.agg(F.sum(F.col("first.cost") + F.col("second.cost"))).head()[0] or 0) * SHARE)


def _reading_sql(turn: int) -> str:
    k, p = f"(n * {7 + 6 * turn})", "ab"[turn]
    return f"""{k} % 29 = 3 as {p}_raised, {k} % 11 <> 4 as {p}_ok, case when n % 5 = 0 then 12 else n % 4 + 1 end + case when {k} % 13 = 0 then 1 else 0 end as {p}_tiers,
 {k} % 17 = 5 as {p}_low, concat('invalid: ', {k} % 7) as {p}_reason, 8000 + {k} % 4000 as {p}_cost"""


def _text_sql(p: str) -> str:
    return f"case when {p}_ok then concat('extracted ', {p}_tiers, ' priced tier', case when {p}_tiers = 1 then '' else 's' end, case when {p}_low then ' (low confidence)' else '' end) else concat('failed: ', {p}_reason) end"


#: The pass as a fold over the candidates, one at a time.
_VERIFY_SQL = f"""cand as (select row_number() over (order by n) as rn, concat('https://c', lpad(n::varchar, 12, '0'), '.example/') as url, n % 9 <> 2 as fetched, concat('HTTP ', 400 + n % 5) as fetch_error, {_reading_sql(0)}, {_reading_sql(1)}
  from (select cast(c_custkey as bigint) as n from customer)), bud as (select cast(floor(sum(a_cost + b_cost) * {SHARE}) as bigint) as budget from cand),
 fold as (select cast(0 as bigint) as rn, cast(0 as bigint) as spent, false as stopped, cast(null as varchar) as outcome, cast(0 as bigint) as cost union all
 select c.rn, f.spent + case when not f.stopped and c.fetched and f.spent < budget then x1 + case when f.spent + x1 < budget and not a_raised then x2 else 0 end else 0 end,
  f.stopped or (c.fetched and (f.spent >= budget or (not a_raised and f.spent + x1 >= budget))),
  case when f.stopped then 'skipped' when not c.fetched then 'rejected' when f.spent >= budget then 'skipped' when a_raised then 'errored' when f.spent + x1 >= budget then 'skipped' when b_raised then 'errored'
   when a_ok and b_ok and not a_low and not b_low and a_tiers = b_tiers and a_tiers between 2 and 8 then 'admitted' else 'rejected' end,
  case when f.stopped or not c.fetched or f.spent >= budget then 0 when a_raised then 0 when f.spent + x1 >= budget then x1 else x1 + x2 end
 from fold f join cand c on c.rn = f.rn + 1, bud, lateral (select case when a_ok and not a_raised then a_cost else 0 end as x1, case when b_ok and not b_raised then b_cost else 0 end as x2) x)"""
_REASON_SQL = f"""case when outcome in ('skipped', 'errored') then null when not fetched then concat('re-fetch failed: ', fetch_error) when outcome = 'admitted' then concat('both attempts agreed on ', a_tiers, ' priced tiers')
 when a_ok and b_ok and not a_low and not b_low and a_tiers = b_tiers and a_tiers > 8 then concat('prices per product or unit rather than per plan (', a_tiers, ' priced entries)') else concat('attempt 1 ', {_text_sql('a')}, ', attempt 2 ', {_text_sql('b')}) end"""


@query(f"with recursive {_VERIFY_SQL} select url, outcome, {_REASON_SQL} as reason, cast(case when outcome = 'admitted' then a_tiers end as int) as priced_tiers, cost as cost_micros from fold join cand using (rn)")
def verification_outcomes(spark, sf_dir):
    """What two readings of every candidate come to under a budget."""
    rows = _candidates(spark, sf_dir)
    return verifying.verified(rows, _budget(rows))


@query(f"""with recursive {_VERIFY_SQL}, s as (select count(*) as considered, count(*) filter (outcome = 'admitted') as admitted, count(*) filter (outcome = 'rejected') as rejected, count(*) filter (outcome = 'skipped') as skipped, count(*) filter (outcome = 'errored') as errored,
  cast(sum(cost) as bigint) as actual_micros from fold where rn > 0), m as (select cast(floor(avg(a_cost) + 0.5) as bigint) as mean from cand)
 select s.*, considered * mean * 2 as estimate_micros, considered * mean * 2 <= budget as within_budget, (actual_micros - considered * mean * 2) / (considered * mean * 2) > 0.2 as overran from s, m, bud""")
def verification_summary(spark, sf_dir):
    """The pass in one row, beside what it was estimated to cost."""
    rows = _candidates(spark, sf_dir)
    budget, mean = _budget(rows), verifying.mean_cost(rows.select(F.col("first.cost").alias("cost_micros")))
    n = lambda outcome: F.count_if(F.col("outcome") == outcome).alias(outcome)
    found = verifying.verified(rows, budget).agg(F.count("*").alias("considered"), n("admitted"), n("rejected"), n("skipped"), n("errored"), F.sum("cost_micros").alias("actual_micros"))
    estimate = verifying.verify_estimate(F.col("considered"), F.lit(mean), budget)
    found = found.select("*", estimate[0].alias("estimate_micros"), estimate[1])
    return found.withColumn("overran", verifying.overran(F.col("actual_micros"), F.col("estimate_micros")))


@query("""select name, case when n % 4 <> 1 then concat('  {', chr(10), '    slug: ''', trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), ''',', chr(10), '    name: ''', name, ''',', chr(10), '    homepage: ''https://c', n, '.example'',', chr(10), '    // category: ', c_mktsegment, chr(10),
 '    sources: [{ kind: ''pricing'', url: ''https://C', n, '.example/pricing?x=1'', canaryString: ''Team ', n, ''', cadenceHours: 24 }],', chr(10), '  },') end as entry
 from (select cast(c_custkey as bigint) as n, concat(c_name, ' & Co.') as name, c_mktsegment from customer) where n % 3 <> 0""")
def config_emit(spark, sf_dir):
    """Configuration of the candidates that passed; those without a canary are refused by name."""
    n = F.col("c_custkey").cast("long")
    rows = lenses.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("https://C"), n.cast("string"), F.lit(".example/pricing?x=1")).alias("url"), F.concat("c_name", F.lit(" & Co.")).alias("name"), F.col("c_mktsegment").alias("category"),
        F.when(n % 3 == 0, "reject").when(n % 3 == 1, "pass").otherwise("admit").alias("verdict"), F.when(n % 8 == 1, "").when(n % 4 != 1, F.concat(F.lit("Team "), n.cast("string"))).alias("canary"),
    )
    return verifying.config_entries(rows)


@query(f"""with recursive {_VERIFY_SQL} select url as name, {_REASON_SQL} as why from fold join cand using (rn) where outcome = 'rejected' union all select url, 'raised' from fold join cand using (rn) where outcome = 'errored'""")
def excluded_candidates(spark, sf_dir):
    """What the pass leaves out, and why."""
    rows = _candidates(spark, sf_dir)
    found = verifying.verified(rows, _budget(rows))
    errored = found.where("outcome = 'errored'").select(F.col("url").alias("name"), F.lit("raised\nat line 1").alias("error"))
    return verifying.excluded(found.where("outcome = 'rejected'").select(F.col("url").alias("name"), "reason"), errored)
