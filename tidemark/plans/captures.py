"""Queries of capture discovery and of the capture queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import lenses
from tidemark.plans.catalogue import query
from tidemark.plans.lenses import AS_OF
from tidemark.sources import captures


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index answers for each user: the first event of each day as a capture, some of them malformed."""
    events = lenses.table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    first = events.groupBy("user_id", F.substring("stamp", 1, 8).alias("day")).agg(F.min(F.struct("stamp", "k")).alias("e")).select("user_id", "day", "e.stamp", "e.k")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    stamp = F.when(F.col("k") % 11 == 1, F.concat(F.lit("202402"), F.lit("31"), F.substring("stamp", 9, 6))).otherwise(F.col("stamp"))
    cells = [F.when(F.col("k") % 11 == 2, stamp).otherwise(text(stamp)), text(F.lit("https://example.org/pricing")), F.when(F.col("k") % 11 == 3, text(F.lit("302"))).otherwise(text(F.lit("200"))), text(F.col("day"))]
    row = F.when(F.col("k") % 11 == 4, F.concat(F.lit("["), cells[0], F.lit("]"))).when(F.col("k") % 11 == 5, "null").otherwise(F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")))
    bodies = first.groupBy("user_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("day", row.alias("row")))), lambda r: r["row"])).alias("rows"))  # a row a day
    header = F.lit('[["timestamp","original","statuscode","digest"],')
    body = F.when(F.col("user_id") % 13 == 0, "<html>busy</html>").when(F.col("user_id") % 17 == 0, "").when(F.col("user_id") % 19 != 0, F.concat(header, F.col("rows"), F.lit("]")))
    return bodies.select(F.col("user_id").alias("source_id"), F.concat(F.lit("https://example.org/pricing?plan="), F.col("user_id").cast("string")).alias("url"), body.alias("body"))


_ANSWERS_SQL = """firsts as (select user_id, strftime(ts, '%Y%m%d') as day, arg_min(strftime(ts, '%Y%m%d%H%M%S'), (strftime(ts, '%Y%m%d%H%M%S'), k)) as stamp, arg_min(k, (strftime(ts, '%Y%m%d%H%M%S'), k)) as k
  from (select *, cast(json_extract(props, '$.k') as int) as k from events) group by 1, 2),
 good as (select user_id as source_id, day, stamp from firsts where user_id % 13 <> 0 and user_id % 17 <> 0 and user_id % 19 <> 0 and k % 11 not in (1, 2, 3, 4, 5))"""


@query(f"""with {_ANSWERS_SQL} select source_id, stamp as wayback_ts, concat('https://web.archive.org/web/', stamp, 'id_/https://example.org/pricing?plan=', source_id) as target_url, 'pending' as state, 0 as attempts
 from good where cast(day as int) % 3 <> 0""")
def backfill_discovery(spark, sf_dir):
    """Captures that the queue lacks; it has those of every third day."""
    found = captures.discovered(_answers(spark, sf_dir))
    queue = found.where("cast(digest as int) % 3 = 0").select("source_id", F.col("timestamp").alias("wayback_ts"))
    return captures.enqueued(found, queue)


@query(f"""with {_ANSWERS_SQL} select (select count(distinct user_id) from firsts) as sources, (select count(distinct user_id) from firsts where user_id % 13 <> 0 and user_id % 17 <> 0 and user_id % 19 = 0) as failed,
 count(*) as found, count(*) filter (cast(day as int) % 3 <> 0) as enqueued, count(*) filter (cast(day as int) % 3 = 0) as duplicate from good""")
def discovery_summary(spark, sf_dir):
    """The discovery in one row."""
    answers = _answers(spark, sf_dir)
    queue = captures.discovered(answers).where("cast(digest as int) % 3 = 0").select("source_id", F.col("timestamp").alias("wayback_ts"))
    return captures.discovery_summary(answers, queue)


@query(f"""select distinct user_id as source_id, concat('https://web.archive.org/cdx/search/cdx?url=https%3A%2F%2Fexample.org%2Fpricing%3Fplan%3D', user_id, '&output=json&collapse=timestamp%3A6&filter=statuscode%3A200&from=',
 strftime(date_trunc('month', date '{AS_OF[:10]}') - interval 18 months + (day(date '{AS_OF[:10]}') - 1) * interval 1 day, '%Y%m%d'), '&to={AS_OF[:10].replace("-", "")}&fl=timestamp%2Coriginal%2Cstatuscode%2Cdigest') as request from events""")
def index_requests(spark, sf_dir):
    """What to ask the index for each source: the last 18 months."""
    now = F.lit(AS_OF).cast("timestamp_ntz")
    target = F.concat(F.lit("https://example.org/pricing?plan="), F.col("user_id").cast("string"))
    rows = lenses.table(spark, sf_dir, "events").select("user_id").distinct()
    return rows.select(F.col("user_id").alias("source_id"), captures.index_url(target, captures.day_stamp(captures.months_back(now, captures.MONTHS)), captures.day_stamp(now)).alias("request"))


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queue, ledger): an item is a user and one of seven pages, an event is an attempt at it."""
    rows = lenses.table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), F.concat_ws(":", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")).alias("item"))
    fetched = ~F.col("event_type").isin("error", "view", "click")
    ledger = rows.select("item", F.struct("ts", "event_id").alias("at"), fetched.alias("fetched"), F.when(F.col("k") % 4 == 0, "no such page").otherwise("Pro $ 9").alias("body"), F.concat(F.lit("HTTP "), (500 + F.col("k") % 5).cast("string")).alias("error"))
    stamps = rows.groupBy("item").agg(F.min("ts").alias("first"), F.min("k").alias("k"))
    stamp = F.when(F.col("k") == 2, "20240231000000").otherwise(F.date_format("first", "yyyyMMddHHmmss"))
    return stamps.select("item", stamp.alias("wayback_ts")), ledger


_LEDGER_SQL = """rows_ as (select event_id, ts, event_type, cast(json_extract(props, '$.k') as int) as k, concat(user_id, ':', event_id % 7) as item from events),
 queue as (select item, case when min(k) = 2 then '20240231000000' else strftime(min(ts), '%Y%m%d%H%M%S') end as wayback_ts, min(k) = 2 as bad from rows_ group by item),
 tries as (select *, row_number() over (partition by item order by ts, event_id) as n from rows_),
 step as (select item, cast(0 as bigint) as n, 'pending' as state, 0 as attempts, cast(null as varchar) as last_error from queue union all
  select s.item, t.n, case when q.bad then 'skipped' when t.event_type in ('error', 'view', 'click') then case when s.attempts + 1 >= 3 then 'failed' else 'pending' end when t.k % 4 = 0 then 'skipped' else 'fetched' end,
   case when not q.bad and t.event_type in ('error', 'view', 'click') then s.attempts + 1 else s.attempts end,
   case when q.bad then concat('unparseable wayback timestamp "', q.wayback_ts, '"') when t.event_type in ('error', 'view', 'click') then concat('HTTP ', 500 + t.k % 5) when t.k % 4 = 0 then 'no price-like text in the capture' end
  from step s join queue q using (item) join tries t on t.item = s.item and t.n = s.n + 1 where s.state = 'pending'),
 states as (select item, wayback_ts, state, attempts, last_error from step join queue using (item) qualify row_number() over (partition by item order by n desc) = 1)"""


@query(f"with recursive {_LEDGER_SQL} select item, wayback_ts, state, attempts, last_error from states")
def queue_replay(spark, sf_dir):
    """The state of every capture after several attempts at it."""
    return captures.replayed(*_ledger(spark, sf_dir))


@query(f"with recursive {_LEDGER_SQL} select item, wayback_ts from states where state = 'pending' and attempts < 3 order by wayback_ts, item limit 20")
def queue_next_slice(spark, sf_dir):
    """The 20 oldest captures that may be tried again."""
    return captures.next_slice(captures.replayed(*_ledger(spark, sf_dir)), 20).select("item", "wayback_ts")
