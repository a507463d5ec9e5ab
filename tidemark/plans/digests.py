"""Queries of digests, cadence, states of sources and marks on charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import digests, observe, timeline
from tidemark.plans import lenses
from tidemark.plans.catalogue import CHANGES_SQL, CONFIRM_SQL, RUNS_SQL, _confirmed, _source_changes, _valid, query
from tidemark.plans.crawling import LABEL_SQL, _label
from tidemark.plans.lenses import AS_OF, SNAPSHOTS_SQL, TIERS_SQL, table

US = lambda c: F.unix_micros(c.cast("timestamp"))

#: A day of the archive is a run of the digest: the failures of the day are what is pending, and the last view of the seven days before is the last digest.
_DAYS_SQL = """d as (select date_trunc('day', ts) as day, count(*) filter (event_type = 'error' and user_id % 40 = 0) as pending, max(case when user_id % 60 = 1 and event_type = 'view' then ts end) as digest from events group by 1),
 t as (select day + interval 3 hours as now, pending, day(day) % 9 = 4 as force, max(digest) over (order by day rows between unbounded preceding and 1 preceding) as last_digest from d)"""


@query(f"""with {_DAYS_SQL} select epoch_us(now) as now_us, pending, case when pending = 0 then 'never' when force then 'fire' when dayofweek(now - interval 6 hours) <> 1 then 'hold' when pending >= 3 then 'fire'
 when last_digest is null or epoch_us(now) - epoch_us(last_digest) > 30 * 86400000000 then 'fire' else 'hold' end as decision from t""")
def digest_triggers(spark, sf_dir):
    """The decision of every day: what is pending, Mondays in Chicago, forced runs and the age of the last digest."""
    events = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", F.date_trunc("day", "ts").alias("day"))
    days = events.groupBy("day").agg(
        F.count_if((F.col("event_type") == "error") & (F.col("user_id") % 40 == 0)).alias("pending"), F.max(F.when((F.col("user_id") % 60 == 1) & (F.col("event_type") == "view"), F.col("ts"))).alias("digest")
    )
    before = lenses.W.orderBy("day").rowsBetween(lenses.W.unboundedPreceding, -1)  # a row a day
    rows = days.select((F.col("day") + F.expr("interval 3 hours")).alias("now"), "pending", (F.dayofmonth("day") % 9 == 4).alias("force"), F.max("digest").over(before).alias("last_digest"))
    return rows.select(US(F.col("now")).alias("now_us"), "pending", digests.trigger(F.col("pending"), F.col("now"), F.col("last_digest"), F.col("force")).alias("decision"))


@query(f"""with {CONFIRM_SQL}, p as (select *, to_id * 100 + row_number() over (partition by to_id order by json_path) as change_id from judged), q as (select * from p where state = 'confirmed' order by observed_at, change_id limit 20),
 l as (select string_agg(concat('[', n - 1, '] Source ', source_id, ' ', strftime(observed_at, '%Y-%m-%d'), ' ', change_type, ' ', json_path, ': ', before, ' -> ', after), chr(10) order by n) as lines from (select *, row_number() over (order by observed_at, change_id) as n from q)),
 g as (select string_agg(concat('--- digest ', n, ' ---', chr(10), left(body, 2000)), chr(10) order by n) as bodies from (select *, row_number() over (order by ts desc) as n from
  (select ts, repeat(concat(event_type, ' ', event_id, '; '), 200) as body from events where event_type = 'purchase' order by ts desc limit 4)))
 select concat('Confirmed changes (reference by index):', chr(10), lines, chr(10), chr(10), 'Prior digests, newest first:', chr(10), bodies) as prompt from l, g""")
def digest_request(spark, sf_dir):
    """What a digest is asked for: its changes by index, and the digests before it."""
    rank = F.row_number().over(lenses.W.partitionBy("to_id").orderBy("json_path"))
    rows = _confirmed(spark, sf_dir).withColumn("change_id", F.col("to_id") * 100 + rank).where("state = 'confirmed'")
    pending = rows.withColumn("competitor", F.concat(F.lit("Source "), F.col("source_id").cast("string")))
    bodies = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("ts").alias("created_at"), F.repeat(F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit("; ")), F.lit(200)).alias("body"))
    return digests.digest_request(pending, bodies)


@query(f"""with s as (select user_id as source_id, 6 + 6 * (user_id % 4) as cadence_hours, user_id % 6 <> 0 as active, max(date_trunc('second', case when user_id % 11 <> 3 then ts end)) as last from events group by 1)
 select source_id, epoch_us(last) as last_us from s where active and (last is null or epoch_us(timestamp '{AS_OF}') // 1000000 - epoch_us(last) // 1000000 >= cadence_hours * 3600)""")
def due_by_cadence(spark, sf_dir):
    """Active sources whose own cadence has passed since their last fetch; some were never fetched."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("ts").alias("fetched_at"))
    sources = events.select("source_id").distinct().withColumns({"cadence_hours": 6 + 6 * (F.col("source_id") % 4), "active": F.col("source_id") % 6 != 0})
    return digests.due(sources, events.where("source_id % 11 <> 3"), F.lit(AS_OF).cast("timestamp_ntz")).select("source_id", US(F.col("last")).alias("last_us"))


@query(f"""with {SNAPSHOTS_SQL}, c as (select distinct user_id as source_id from events), l as (select source_id, max(observed_at) as checked, arg_max(ok, (observed_at, id)) as ok, arg_max_null(case when ok then error end, (ok, observed_at, id)) as degraded from snapshots where source_id % 9 <> 5 group by 1)
 select source_id, case when checked is null then 'pending' when not ok then 'failing' when degraded is not null then 'degraded' else 'ok' end as state from c left join l using (source_id)""")
def source_states(spark, sf_dir):
    """The state of every source: some were never checked, and the reason of the last good fetch outlives failed ones."""
    rows = lenses.snapshots(spark, sf_dir).where("source_id % 9 <> 5").groupBy("source_id").agg(
        F.max("observed_at").alias("checked"), F.max_by("ok", F.struct("observed_at", "id")).alias("ok"), F.max_by(F.when(F.col("ok"), F.col("error")), F.struct("ok", "observed_at", "id")).alias("degraded")
    )
    sources = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id")).distinct()
    return sources.join(rows, "source_id", "left").select("source_id", digests.state_of(F.col("checked"), F.col("ok"), F.col("degraded")).alias("state"))


_MARKS_SQL = f"""{CHANGES_SQL}, plot as (select source_id, min(first_at) as a, max(first_at) as b from runs join tiers using (page_state) where monthly is not null group by 1),
 marks as (select c.source_id, observed_at as seen, {LABEL_SQL} as label from (select * from pairs join state_changes using (before_state, after_state) where materiality >= 40 and change_type = 'price_changed') c join plot p on p.source_id = c.source_id and observed_at between a and b)"""
_PRICE_SQL = r"cast(nullif(replace(regexp_extract(label, '\$([0-9,]+(?:\.[0-9]+)?)\s*→\s*\$([0-9,]+(?:\.[0-9]+)?)$', {0}), ',', ''), '') as double)"


@query(f"""with {_MARKS_SQL}, m as (select source_id, strftime(seen, '%Y-%m-%d') as day, case when {_PRICE_SQL.format(2)} > {_PRICE_SQL.format(1)} then 'rise' when {_PRICE_SQL.format(2)} < {_PRICE_SQL.format(1)} then 'fall' else 'flat' end as d from marks)
 select source_id, day, count(*) as marks, case when count(distinct d) = 1 then min(d) else 'flat' end as direction from m group by 1, 2""")
def marks_of_days(spark, sf_dir):
    """Marks of prices within the plotted times, one for each day, with the direction that its labels share."""
    marks = _label(_source_changes(spark, sf_dir).where("materiality >= 40 and change_type = 'price_changed'")).select("source_id", F.col("observed_at").alias("at"), "label")
    points = timeline.price_points(observe.observation_runs(_valid(spark, sf_dir)), F.broadcast(lenses.tiers(spark)))  # of 16 states
    return digests.day_marks(digests.inside_plot(marks, points))


@query(f"with {RUNS_SQL} select epoch_us(min(first_at)) as earliest_us, epoch_us(max(last_at)) as latest_us, count(distinct source_id) as sources from runs")
def earliest_observation(spark, sf_dir):
    """The archive's first and last observation over all sources."""
    runs = observe.observation_runs(_valid(spark, sf_dir))
    return runs.agg(US(F.min("first_at")).alias("earliest_us"), US(F.max("last_at")).alias("latest_us"), F.count_distinct("source_id").alias("sources"))


@query(f"""with {TIERS_SQL}, {SNAPSHOTS_SQL}, n as (select page_state, count(*) filter (monthly is not null) as priced, count(*) as tiers from tiers group by 1) select id, priced, tiers from snapshots join n using (page_state) where ok""")
def priced_tiers(spark, sf_dir):
    """How many tiers each stored document prices."""
    counts = lenses.tiers(spark).groupBy("page_state").agg(F.count_if(F.col("monthly").isNotNull()).alias("priced"), F.count("*").alias("tiers"))
    return lenses.snapshots(spark, sf_dir).where("ok").join(F.broadcast(counts), "page_state").select("id", "priced", "tiers")  # 16 states


@query("select distinct concat('backup-', strftime(ts, '%Y%m%d'), '.db') as name from events where strftime(ts, '%Y%m%d') not in (select distinct strftime(ts, '%Y%m%d') from events order by 1 desc limit 7)")
def retired_backups(spark, sf_dir):
    """Daily backups that go: all but the last seven by name."""
    name = F.concat(F.lit("backup-"), F.date_format("ts", "yyyyMMdd"), F.lit(".db"))
    return digests.retired(table(spark, sf_dir, "events").select(name.alias("name")).distinct())
