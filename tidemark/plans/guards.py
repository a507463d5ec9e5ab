"""Registered queries of dataset runs, the board, page health, pool differences, publish guards and blocked addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import datasets, observe
from tidemark.plans import lenses
from tidemark.plans.catalogue import RUNS_SQL, VALID_SQL, _valid, query
from tidemark.plans.lenses import SNAPSHOTS_SQL, TIERS_SQL, table
from tidemark.plans.reports import US

_STATE = ["monthly", "annual", "billing_unit", "seats"]


_TIER_ROWS = f"""{RUNS_SQL}, {TIERS_SQL}, tier_rows as (select source_id, run, name as tier, row_number() over (partition by source_id, run, name order by ord) - 1 as occurrence,
  first_at, last_at, monthly, annual, billing_unit, seats, is_free, is_enterprise, provenance from runs join tiers using (page_state))"""


def _tier_rows(spark, sf_dir) -> DataFrame:
    """The tiers of every observation; those of one name are told apart by their place."""
    runs = observe.observation_runs(_valid(spark, sf_dir)).select("source_id", "run", "first_at", "last_at", "page_state", "provenance")
    nth = F.row_number().over(W.partitionBy("page_state", "name").orderBy("ord")) - 1
    return runs.join(lenses.tiers(spark).withColumn("occurrence", nth), "page_state").withColumnRenamed("name", "tier")


@query(f"""with {_TIER_ROWS},
 tier_flags as (select *, case when lag(run) over w = run - 1 and {' and '.join(f'lag({c}) over w is not distinct from {c}' for c in _STATE)} then 0 else 1 end as opens
  from tier_rows window w as (partition by source_id, tier, occurrence order by run)),
 spans as (select *, sum(opens) over (partition by source_id, tier, occurrence order by run rows unbounded preceding) as span from tier_flags)
 select source_id, tier, occurrence, cast(span as bigint) as span, min(run) as first_run, max(run) as last_run, epoch_us(min(first_at)) as first_us, epoch_us(max(last_at)) as last_us, any_value(monthly) as monthly
 from spans group by source_id, tier, occurrence, span""")
def dataset_runs_simple(spark, sf_dir):
    """Spans of consecutive runs in which a tier is present and unchanged, compared strictly (nulls equal)."""
    order = W.partitionBy("source_id", "tier", "occurrence").orderBy("run")
    same = F.lag("run").over(order) == F.col("run") - 1
    for c in _STATE:
        same = same & F.lag(c).over(order).eqNullSafe(F.col(c))
    rows = _tier_rows(spark, sf_dir).withColumn("opens", F.when(same, 0).otherwise(1))
    rows = rows.withColumn("span", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("source_id", "tier", "occurrence", "span").agg(
        F.min("run").alias("first_run"), F.max("run").alias("last_run"), US(F.min("first_at")).alias("first_us"), US(F.max("last_at")).alias("last_us"), F.first("monthly").alias("monthly")
    )


#: o opens the run, r is the next row.
_SAME = """o.monthly is not distinct from r.monthly and o.seats is not distinct from r.seats and o.is_free = r.is_free and o.is_enterprise = r.is_enterprise
  and (o.billing_unit = r.billing_unit or o.billing_unit = 'unknown' or r.billing_unit = 'unknown')
  and (o.annual is not distinct from r.annual or (o.monthly = 0 and r.monthly = 0 and coalesce(o.annual, 0) = 0 and coalesce(r.annual, 0) = 0)) and r.run = o.run + 1"""
_OPEN = ["monthly", "annual", "billing_unit", "seats", "is_free", "is_enterprise"]


@query(f"""with recursive {_TIER_ROWS}, n as (select *, row_number() over (partition by source_id, tier, occurrence order by run) as k from tier_rows),
 f as (select source_id, tier, occurrence, k, run, {', '.join(_OPEN)}, annual as seen, first_at, last_at, provenance, 1 as span from n where k = 1
  union all select r.source_id, r.tier, r.occurrence, r.k, r.run, {', '.join(f'case when {_SAME} then o.{c} else r.{c} end' for c in _OPEN)}, r.annual, r.first_at, r.last_at, r.provenance, o.span + case when {_SAME} then 0 else 1 end
  from f o join n r on r.source_id = o.source_id and r.tier = o.tier and r.occurrence = o.occurrence and r.k = o.k + 1)
 select source_id, tier, occurrence, epoch_us(min(first_at)) as first_us, epoch_us(max(last_at)) as last_us, any_value(monthly) as monthly, coalesce(arg_min(annual, k), max(case when seen = 0 then 0.0 end)) as annual,
  arg_min(billing_unit, k) as billing_unit, any_value(seats) as seats, bool_or(is_free) as is_free, bool_or(is_enterprise) as is_enterprise,
  case when bool_or(provenance = 'mixed') or count(distinct provenance) > 1 then 'mixed' else any_value(provenance) end as provenance from f group by source_id, tier, occurrence, span""")
def dataset_runs(spark, sf_dir):
    """The published rows: runs in which a tier holds the state that opened the run."""
    return datasets.dataset_runs(_tier_rows(spark, sf_dir))


@query(f"""with {VALID_SQL}, {TIERS_SQL}, seen as (select source_id, min(observed_at) as f, max(observed_at) as l, count(distinct raw_hash) as states from snapshots where ok group by source_id),
 latest as (select source_id, arg_max(page_state, (observed_at, id)) as page_state from valid group by source_id),
 priced as (select page_state, min(monthly) as price, count(*) as tiers from tiers where monthly > 0 group by page_state)
 select source_id, epoch_us(f) as first_us, epoch_us(l) as last_us, states, page_state, price, coalesce(tiers, 0) as tiers from seen left join latest using (source_id) left join priced using (page_state)""")
def board(spark, sf_dir):
    """One row per source: its times, distinct states, current page state and cheapest paid price."""
    seen = lenses.snapshots(spark, sf_dir).where("ok").groupBy("source_id")
    seen = seen.agg(US(F.min("observed_at")).alias("first_us"), US(F.max("observed_at")).alias("last_us"), F.count_distinct("raw_hash").alias("states"))
    latest = _valid(spark, sf_dir).groupBy("source_id").agg(F.max_by("page_state", F.struct("observed_at", "id")).alias("page_state"))
    priced = lenses.tiers(spark).where("monthly > 0").groupBy("page_state").agg(F.min("monthly").alias("price"), F.count("*").alias("tiers"))
    rows = seen.join(latest, "source_id", "left").join(F.broadcast(priced), "page_state", "left")  # 16 states
    return rows.select("source_id", "first_us", "last_us", "states", "page_state", "price", F.coalesce("tiers", F.lit(0)).alias("tiers"))


#: The text whose absence tells that a page has changed its make, and what passes for a price on pages that sell nothing.
CANARY, PRICE = "<nav", r"[0-9]{3,}"


@query(f"select page_id, case when not contains(coalesce(html, ''), '{CANARY}') then 'canary missing' when not regexp_matches(html, '{PRICE}') then 'no price' end as problem from pages")
def page_health(spark, sf_dir):
    """The first problem of a raw page, the canary before the price; null if it is healthy."""
    html = F.coalesce("html", F.lit(""))
    problem = F.when(~html.contains(CANARY), "canary missing").when(~html.rlike(PRICE), "no price")
    return table(spark, sf_dir, "pages").select("page_id", problem.alias("problem"))


@query("""select doc_id, lang is null or lang = 'de' as explicit from documents d
 where lang is null or lang = 'de' or not exists (select 1 from labels l where l.doc_id = d.doc_id)""")
def candidate_pool_diff(spark, sf_dir):
    """Documents not labelled yet, and those asked for by name (here a language) in any case."""
    pool = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("lang") == "de", F.lit(True)).alias("explicit"))
    fresh = pool.where("not explicit").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return pool.where("explicit").unionByName(fresh)


PUBLISHED_AT = "2024-01-16 00:00:00"


@query(f"""with {SNAPSHOTS_SQL}, sizes as (select split_part(page_state, ':', 1) as artifact, count_if(observed_at >= timestamp '{PUBLISHED_AT}') as size, count_if(observed_at < timestamp '{PUBLISHED_AT}') as previous,
  count(distinct case when observed_at >= timestamp '{PUBLISHED_AT}' then source_id end) as sources, count(distinct case when observed_at < timestamp '{PUBLISHED_AT}' then source_id end) as before from snapshots where ok group by 1)
 select artifact, size, previous, case when sources = 0 then 'empty' when sources < before then 'fewer sources' when size * 2 < previous then 'shrunk' else 'ok' end as verdict from sizes""")
def publish_guard(spark, sf_dir):
    """What a publication of each artifact is held against: some source, no fewer than last time, half the size."""
    new, old = (F.col("observed_at") >= F.lit(PUBLISHED_AT).cast("timestamp_ntz"), F.col("observed_at") < F.lit(PUBLISHED_AT).cast("timestamp_ntz"))
    rows = lenses.snapshots(spark, sf_dir).where("ok").groupBy(F.split_part("page_state", F.lit(":"), F.lit(1)).alias("artifact"))
    sizes = rows.agg(F.count_if(new).alias("size"), F.count_if(old).alias("previous"), F.count_distinct(F.when(new, F.col("source_id"))).alias("sources"), F.count_distinct(F.when(old, F.col("source_id"))).alias("before"))
    verdict = F.when(F.col("sources") == 0, "empty").when(F.col("sources") < F.col("before"), "fewer sources").when(F.col("size") * 2 < F.col("previous"), "shrunk").otherwise("ok")
    return sizes.select("artifact", "size", "previous", verdict.alias("verdict"))


#: Loopback, link-local and private IPv4 networks as (address, prefix bits).
BLOCKED_NETWORKS = [("127.0.0.0", 8), ("169.254.0.0", 16), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16)]


def number(address: Column) -> Column:
    parts = F.split(address, r"\.")
    return sum((parts[i].cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), parts[0].cast("long") * (1 << 24))


def blocked(address: Column) -> Column:
    """Whether an IPv4 address lies in a blocked network."""
    inside = F.lit(False)
    for base, bits in BLOCKED_NETWORKS:
        inside = inside | (F.shiftright(number(address), 32 - bits) == F.shiftright(number(F.lit(base)), 32 - bits))
    return inside


#: Addresses around the edges of the networks, made from customer keys.
_FIRST = "case c_custkey % 6 when 0 then 10 when 1 then 127 when 2 then 169 when 3 then 172 when 4 then 192 else 11 end"
_SECOND = "case c_custkey % 6 when 2 then 253 + c_custkey % 3 when 3 then 14 + c_custkey % 20 when 4 then 167 + c_custkey % 4 else c_custkey % 256 end"
_ADDRESS = f"concat_ws('.', cast({_FIRST} as {{text}}), cast({_SECOND} as {{text}}), cast(c_custkey * 7 % 256 as {{text}}), '1')"
_N = "(cast(split_part({0}, '.', 1) as bigint) * 16777216 + cast(split_part({0}, '.', 2) as bigint) * 65536 + cast(split_part({0}, '.', 3) as bigint) * 256 + cast(split_part({0}, '.', 4) as bigint))"


@query(f"select c_custkey, address, {' or '.join(f'''{_N.format('address')} // {1 << (32 - bits)} = {_N.format(f"'{base}'")} // {1 << (32 - bits)}''' for base, bits in BLOCKED_NETWORKS)} as blocked from (select c_custkey, {_ADDRESS.format(text='varchar')} as address from customer)")
def blocked_destinations(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_ADDRESS.format(text="string")).alias("address"))
    return rows.withColumn("blocked", blocked(F.col("address")))
