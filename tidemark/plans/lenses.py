"""Views that give the benchmark tables the shape of a page archive.

``events`` becomes an archive: a source is a user, a snapshot an event, a page state an event
type with a quarter of the counter in its properties. ``orders`` and ``lineitem`` become lists of tiers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.storage import dealt, tasks_for

#: Queries that depend on the time take this one; nothing reads the clock.
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fetched(events: DataFrame) -> DataFrame:
    """One row per fetch, from events in a table or a stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = events.select("event_id", "ts", "user_id", "event_type", k.alias("k"))
    ok = F.col("event_type") != "error"
    key = F.concat_ws(":", "event_type", F.col("k").cast("string"))
    state = F.concat_ws(":", "event_type", F.floor(F.col("k") / 25).cast("string"))
    return rows.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("source_id"),
        F.col("ts").alias("observed_at"),
        ok.alias("ok"),
        F.when(~ok, "HTTP 500")
        .when(F.col("k") == 13, "extraction ungrounded: tiers.Pro = 7")
        .when(F.col("k") == 14, "extraction invalid: normalized slice is empty")
        .when(F.col("k") == 15, "curated: verified wrong")
        .alias("error"),
        F.when(ok, key).alias("raw_key"),
        F.when(ok, F.sha2(key, 256)).alias("raw_hash"),
        F.when(ok, state).alias("page_state"),
        F.when(ok, F.sha2(state, 256)).alias("normalized_hash"),
        F.when(F.col("k") % 3 == 0, "live").otherwise(F.concat(F.lit("wayback:"), F.date_format("ts", "yyyyMMddHHmmss"))).alias("provenance"),
        "k",
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per fetch; content only where its bytes are new to the source."""
    rows = fetched(table(spark, sf_dir, "events"))
    first = F.row_number().over(W.partitionBy("source_id", "raw_hash").orderBy("observed_at", "id")) == 1
    return rows.withColumn("raw_content", F.when(F.col("ok") & first, F.col("raw_key")))


#: Tiers of 16 page states: a dimension of fixed size. Two tiers named Addon give one path twice; Scale and Team 2.0 are renames.
TIERS = """
select concat(t, ':', cast(j as {text})) as page_state, ord, name, monthly, annual, billing_unit, seats, is_free, is_enterprise, features
from (select t, j, ord,
   case ord when 0 then 'Free' when 1 then case when t = 'purchase' then 'Pro Plan' else 'Pro' end when 2 then 'Enterprise'
     when 3 then case when t = 'purchase' then 'Team 2.0' else 'Scale' end else 'Addon' end as name,
   cast(case ord when 0 then 0 when 1 then case when t = 'signup' then null else 10 + 5 * j end when 2 then null when 3 then 50 + 10 * j when 4 then 5 + j else 20 + j end as double) as monthly,
   cast(case ord when 0 then case when j % 2 = 0 then 0 end when 1 then 96 + 24 * j end as double) as annual,
   case when ord = 1 then case t when 'click' then 'per_seat' when 'view' then 'unknown' else 'flat' end else 'flat' end as billing_unit,
   cast(case when ord = 1 then j end as double) as seats, ord = 0 as is_free, (ord = 2 or (ord = 1 and t = 'signup' and j = 3)) as is_enterprise,
   case when ord = 1 then concat('["f', cast(j % 2 as {text}), '"]') else '[]' end as features
 from (values ('click'),('purchase'),('signup'),('view')) a(t) cross join (values (0),(1),(2),(3)) b(j) cross join (values (0),(1),(2),(3),(4),(5)) c(ord)) x
where not (ord = 2 and t = 'view') and not (ord = 3 and not (t in ('purchase', 'click') and j >= 2)) and not (ord > 3 and t in ('purchase', 'signup'))
"""

#: Rates of the states: re-worded, repeated, ambiguous, and some that only a few states have.
RATES = """
select concat(t, ':', cast(j as {text})) as page_state, ord, metric, unit_price from (select t, j, ord,
   case ord when 0 then case when j % 2 = 1 then 'Egress (per GB)' else 'Egress per GB' end
     when 1 then case t when 'click' then 'AI credits (Enterprise tier)' when 'view' then 'AI credit (Enterprise)' else 'AI credits, overage' end
     else case when t = 'purchase' then case ord when 2 then 'API calls' else 'API call (billed monthly)' end else 'API calls' end end as metric,
   cast(case ord when 0 then case when t = 'click' then 0.5 else 0.25 end when 1 then 2 + j else ord end as double) as unit_price
 from (values ('click'),('purchase'),('signup'),('view')) a(t) cross join (values (0),(1),(2),(3)) b(j) cross join (values (0),(1),(2),(3)) c(ord)) x
where not (ord >= 2 and t = 'signup') and not (ord = 3 and t = 'view')
"""

EXTRACTIONS = """
select concat(t, ':', cast(j as {text})) as page_state, {sha} as normalized_hash,
   case when t = 'view' and j = 3 then 'low' else 'high' end as confidence, case when t = 'signup' and j = 1 then 'EUR' else 'USD' end as currency,
   t as notes, cast(8000 + 100 * j as bigint) as cost_micros
from (values ('click'),('purchase'),('signup'),('view')) a(t) cross join (values (0),(1),(2),(3)) b(j)
"""


def tiers(spark: SparkSession) -> DataFrame:
    return spark.sql(TIERS.format(text="string"))


def rates(spark: SparkSession) -> DataFrame:
    return spark.sql(RATES.format(text="string"))


def extractions(spark: SparkSession) -> DataFrame:
    return spark.sql(EXTRACTIONS.format(text="string", sha="sha2(concat(t, ':', cast(j as string)), 256)"))


#: Rows of a task that holds them sorted several times over.
SORTED_ROWS = 250_000


def order_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for both sides of ``order_tiers``."""
    return tasks_for(2 * table(spark, sf_dir, "lineitem").count(), SORTED_ROWS)


def order_tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tiers of each order and the order before it of the same customer: (before, after), keyed by pair_id."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    previous = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    pairs = orders.select(F.col("o_orderkey").alias("pair_id"), previous.alias("previous")).where("previous is not null")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    lines = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey", SORTED_ROWS).select(
        "l_orderkey",
        (F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)) - 1).alias("ord"),
        F.concat(F.lit("P"), (F.col("l_partkey") % 5).cast("string"), F.when(F.col("l_suppkey") % 3 == 0, " Plan").otherwise("")).alias("name"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("monthly"),
    )
    before = pairs.join(lines, F.col("previous") == F.col("l_orderkey")).select("pair_id", "ord", "name", "monthly")
    after = pairs.join(lines, F.col("pair_id") == F.col("l_orderkey")).select("pair_id", "ord", "name", "monthly")
    return before, after


# The same views for the DuckDB side.
SNAPSHOTS_SQL = """snapshots as (
 select *, case when ok and row_number() over (partition by source_id, raw_hash order by observed_at, id) = 1 then raw_key end as raw_content
 from (select event_id as id, user_id as source_id, ts as observed_at, event_type <> 'error' as ok,
   case when event_type = 'error' then 'HTTP 500' when k = 13 then 'extraction ungrounded: tiers.Pro = 7'
        when k = 14 then 'extraction invalid: normalized slice is empty' when k = 15 then 'curated: verified wrong' end as error,
   case when event_type <> 'error' then concat(event_type, ':', cast(k as varchar)) end as raw_key,
   case when event_type <> 'error' then sha256(concat(event_type, ':', cast(k as varchar))) end as raw_hash,
   case when event_type <> 'error' then concat(event_type, ':', cast(k // 25 as varchar)) end as page_state,
   case when event_type <> 'error' then sha256(concat(event_type, ':', cast(k // 25 as varchar))) end as normalized_hash,
   case when k % 3 = 0 then 'live' else concat('wayback:', strftime(ts, '%Y%m%d%H%M%S')) end as provenance, k
   from (select *, cast(json_extract(props, '$.k') as int) as k from events)))"""
TIERS_SQL = f"tiers as ({TIERS.format(text='varchar')})"
RATES_SQL = f"rates as ({RATES.format(text='varchar')})"
EXTRACTIONS_SQL = f"extractions as ({EXTRACTIONS.format(text='varchar', sha='sha256(concat(t, chr(58), cast(j as varchar)))')})"
