"""Registered queries of timelines, archive health, spending, screening and publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import match, observe, timeline
from tidemark.plans import lenses
from tidemark.plans.catalogue import CHANGES_SQL, CONFIRM_SQL, PAIRS_SQL, RATES_MATCH_SQL, RUNS_SQL, _confirmed, _on, _pairs, _source_changes, _state_pairs, _valid, query
from tidemark.plans.lenses import AS_OF, EXTRACTIONS_SQL, RATES_SQL, SNAPSHOTS_SQL, TIERS_SQL, table

#: Micro-dollars; nothing runs once a month has cost so much.
BUDGET = 5_000_000
US = lambda c: F.unix_micros(c.cast("timestamp"))

# ---------------------------------------------------------------- timelines


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.price_points(observe.observation_runs(_valid(spark, sf_dir)), F.broadcast(lenses.tiers(spark)))  # of 16 states


POINTS_SQL = f"""{RUNS_SQL}, {TIERS_SQL}, points as (
 select source_id, run, name as tier, any_value(first_at) as seen_at, arg_max(monthly, ord) as price, min(ord) as ord
 from runs join tiers using (page_state) where monthly is not null group by source_id, run, name)"""
LINES_SQL = f"""{POINTS_SQL}, lines as (select *, sum(opens) over (partition by source_id, tier order by run rows unbounded preceding) as segment from (
 select *, case when run - lag(run) over w = 1 and seen_at - lag(seen_at) over w <= interval 75 days then 0 else 1 end as opens
 from points window w as (partition by source_id, tier order by run)))"""


@query(f"with {LINES_SQL} select source_id, tier, cast(segment as bigint) as segment, run, epoch_us(seen_at) as at_us, price from lines")
def timeline_segments(spark, sf_dir):
    return timeline.segments(_points(spark, sf_dir)).select("source_id", "tier", "segment", "run", US(F.col("at")).alias("at_us"), "price")


@query(f"""with {LINES_SQL} select source_id, tier, cast(segment as bigint) as segment, run, epoch_us(seen_at) as at_us, price, false as step from lines
 union all select * from (select source_id, tier, cast(segment as bigint), run, epoch_us(lead(seen_at) over (partition by source_id, tier, segment order by run)) as at_us, price, true from lines) where at_us is not null""")
def step_points(spark, sf_dir):
    found = timeline.step_points(timeline.segments(_points(spark, sf_dir)))
    return found.select("source_id", "tier", "segment", "run", US(F.col("at")).alias("at_us"), "price", "step")


@query(f"""with {POINTS_SQL}, l as (select source_id, tier, arg_max(price, run) as price, min((run, ord)) as seen from points group by source_id, tier)
 select source_id, tier, price, case when price = 0 then 'free' when row_number() over w = 1 then 'entry'
  when row_number() over w = count(*) over (partition by source_id, price <> 0) then 'enterprise' else 'mid' end as rung
 from l window w as (partition by source_id, price <> 0 order by price, seen, tier)""")
def tier_rungs(spark, sf_dir):
    return timeline.rungs(_points(spark, sf_dir))


@query(f"with {CHANGES_SQL} select strftime(observed_at, '%Y-%m-%d') as day, count(*) as changes, count(distinct source_id) as sources, max(materiality) as most from pairs join state_changes using (before_state, after_state) where materiality >= 40 group by 1")
def marker_day_groups(spark, sf_dir):
    rows = _source_changes(spark, sf_dir).where(F.col("materiality") >= X.THRESHOLD)
    day = F.date_format("observed_at", "yyyy-MM-dd").alias("day")
    return rows.groupBy(day).agg(F.count("*").alias("changes"), F.count_distinct("source_id").alias("sources"), F.max("materiality").alias("most"))


@query(f"with {CONFIRM_SQL} select to_id, epoch_us(observed_at) as at_us, change_type, json_path, before, after, materiality from judged where state = 'confirmed' order by observed_at desc, to_id desc, json_path limit 200")
def confirmed_feed_topk(spark, sf_dir):
    """The feed's 200 latest confirmed changes."""
    rows = _confirmed(spark, sf_dir).where("state = 'confirmed'")
    return rows.orderBy(F.desc("observed_at"), F.desc("to_id"), "json_path").limit(200).select("to_id", US(F.col("observed_at")).alias("at_us"), "change_type", "json_path", "before", "after", "materiality")


@query(f"""with {PAIRS_SQL}, {RATES_SQL}, sp as (select distinct before_state, after_state, concat(before_state, '>', after_state) as pair_id from pairs), {RATES_MATCH_SQL}
 select pair_id, cast(bo as bigint) as before_ord, cast(ao as bigint) as after_ord, how from rate_match""")
def rate_match_unambiguous(spark, sf_dir):
    pairs, rates = _state_pairs(_pairs(spark, sf_dir)), lenses.rates(spark)
    found = match.match_rates(_on(pairs, rates, "before"), _on(pairs, rates, "after"))
    return found.select("pair_id", F.col("before.ord").cast("long").alias("before_ord"), F.col("after.ord").cast("long").alias("after_ord"), "how")


# ---------------------------------------------------------------- health


@query(f"with {SNAPSHOTS_SQL} select source_id, id, error as reason, coalesce(lag(error) over (partition by source_id order by observed_at, id) is not null and error is null, false) as cleared from snapshots where ok")
def degraded_lifecycle(spark, sf_dir):
    return timeline.degraded_lifecycle(lenses.snapshots(spark, sf_dir))


@query(f"""with {SNAPSHOTS_SQL}, o as (select *, case when raw_content is not null then normalized_hash end as own from snapshots where ok)
 select id, coalesce(own, max(own) over (partition by source_id, raw_hash)) as normalized_hash, own is null as inherited from o""")
def hash_propagation(spark, sf_dir):
    rows = lenses.snapshots(spark, sf_dir).where("ok")
    rows = rows.withColumn("own", F.when(F.col("raw_content").isNotNull(), F.col("normalized_hash"))).select("id", "source_id", "raw_hash", "own")
    return observe.with_inherited(rows).select("id", "normalized_hash", "inherited")


@query(f"""with {SNAPSHOTS_SQL}, {EXTRACTIONS_SQL} select s.source_id, arg_max(s.id, (s.observed_at, s.id)) as id, arg_max(s.page_state, (s.observed_at, s.id)) as page_state
 from snapshots s join extractions x using (normalized_hash) where s.ok and x.currency = 'USD' group by s.source_id""")
def latest_extraction_per_source(spark, sf_dir):
    """Good fetches with an extraction, also those with a note of an error."""
    wanted = F.broadcast(lenses.extractions(spark).where("currency = 'USD'").select("normalized_hash"))  # at most 16 rows
    latest = F.struct("observed_at", "id")
    rows = lenses.snapshots(spark, sf_dir).where("ok").join(wanted, "normalized_hash")
    return rows.groupBy("source_id").agg(F.max_by("id", latest).alias("id"), F.max_by("page_state", latest).alias("page_state"))


@query(f"with {SNAPSHOTS_SQL}, l as (select source_id, arg_max(ok, (observed_at, id)) as ok from snapshots group by source_id) select count(*) as sources, count_if(ok) as healthy from l")
def status_totals(spark, sf_dir):
    last = lenses.snapshots(spark, sf_dir).groupBy("source_id").agg(F.max_by("ok", F.struct("observed_at", "id")).alias("ok"))
    return last.agg(F.count("*").alias("sources"), F.count_if("ok").alias("healthy"))


_GATES = ["Repeat fetch, byte-identical", "Repeat page state, already extracted", "Short-circuited before any request", "Called and succeeded", "Called and rejected"]
#: Page states without an extraction: not yet due.
PENDING_STATES = ("view:2",)


@query(f"""with {SNAPSHOTS_SQL}, {EXTRACTIONS_SQL}, s as (select *, coalesce(error like 'extraction ungrounded:%' or (error like 'extraction invalid:%' and error not like 'extraction invalid: normalized slice is empty%'), false) as rejected from snapshots where ok),
 x as (select count(*) as rows, count(distinct normalized_hash) as states from s where raw_content is not null and not rejected and page_state <> 'view:2' and normalized_hash in (select normalized_hash from extractions)),
 c as (select (select count(*) from s) as total, (select count(*) from s where raw_content is null) as same, (select count(*) from s where raw_content is not null and rejected) as refused, rows, states from x),
 a as (select unnest([{{'gate': 0, 'name': '{_GATES[0]}', 'n': same}}, {{'gate': 1, 'name': '{_GATES[1]}', 'n': rows - states}}, {{'gate': 2, 'name': '{_GATES[2]}', 'n': total - same - refused - rows}}, {{'gate': 3, 'name': '{_GATES[3]}', 'n': states}}, {{'gate': 4, 'name': '{_GATES[4]}', 'n': refused}}], recursive := true) from c)
 select name, cast(n as bigint) as eliminated, cast(sum(n) over () - sum(n) over (order by gate) as bigint) as remaining from a""")
def funnel_gates(spark, sf_dir):
    """Every good fetch falls to one of five gates; what is left after each."""
    e = F.coalesce("error", F.lit(""))
    rejected = e.startswith("extraction ungrounded:") | (e.startswith("extraction invalid:") & ~e.startswith("extraction invalid: normalized slice is empty"))
    known = lenses.extractions(spark).where(~F.col("page_state").isin(*PENDING_STATES)).select("normalized_hash", F.lit(True).alias("known"))
    rows = lenses.snapshots(spark, sf_dir).where("ok").withColumn("rejected", rejected).join(known, "normalized_hash", "left")
    fresh, called = F.col("raw_content").isNotNull(), F.col("raw_content").isNotNull() & ~F.col("rejected") & F.col("known").isNotNull()
    totals = rows.agg(
        F.count("*").alias("total"), F.count_if(~fresh).alias("same"), F.count_if(fresh & F.col("rejected")).alias("refused"),
        F.count_if(called).alias("rows"), F.count_distinct(F.when(called, F.col("normalized_hash"))).alias("states"),
    )
    n = [F.col("same"), F.col("rows") - F.col("states"), F.col("total") - F.col("same") - F.col("refused") - F.col("rows"), F.col("states"), F.col("refused")]
    gone = [sum(n[: i + 1], F.lit(0)) for i in range(5)]
    gates = F.array(*[F.struct(F.lit(name).alias("name"), x.alias("eliminated"), (F.col("total") - g).alias("remaining")) for name, x, g in zip(_GATES, n, gone, strict=True)])
    return totals.select(F.inline(gates))


# ---------------------------------------------------------------- runs of the archive's own jobs

_RUNS = "job_runs as (select event_id as id, event_type as kind, ts as started_at, case when k < 80 then 'ok' when k < 95 then 'failed' else 'running' end as state from (select *, cast(json_extract(props, '$.k') as int) as k from events))"


def _job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    state = F.when(k < 80, "ok").when(k < 95, "failed").otherwise("running")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("started_at"), state.alias("state"))


@query(f"with {_RUNS} select kind, arg_max(id, (started_at, id)) as id, arg_max(state, (started_at, id)) as state from job_runs where state <> 'running' group by kind")
def latest_run_per_kind(spark, sf_dir):
    latest = F.struct("started_at", "id")
    return _job_runs(spark, sf_dir).where("state <> 'running'").groupBy("kind").agg(F.max_by("id", latest).alias("id"), F.max_by("state", latest).alias("state"))


@query(f"with {_RUNS} select kind, count_if(state = 'running' and started_at <= timestamp '{AS_OF}' - interval 6 hours) as crashed, coalesce(bool_or(state = 'running' and started_at > timestamp '{AS_OF}' - interval 6 hours), false) as locked from job_runs group by kind")
def run_lock_state(spark, sf_dir):
    """Runs of over six hours have crashed; a younger one holds the lock."""
    running, recent = F.col("state") == "running", F.col("started_at") > F.expr(f"timestamp'{AS_OF}' - interval 6 hours")
    return _job_runs(spark, sf_dir).groupBy("kind").agg(F.count_if(running & ~recent).alias("crashed"), F.bool_or(running & recent).alias("locked"))


#: A kind for each event type, some never good, some old, some that need not run at all.
_WATCHED = "watched as (select id, case when kind = 'error' and id % 3 = 0 then 'restic' when kind = 'signup' and state = 'ok' then 'never' else kind end as kind, started_at + interval 5 minutes as ended_at, case when kind in ('signup', 'error') and state = 'ok' then 'failed' when kind = 'view' and id % 2 = 0 then 'failed' else state end as state from job_runs where kind <> 'purchase' or started_at < timestamp '2024-01-20 00:00:00')"
OPTIONAL_KINDS = ("restic",)


@query(f"""with {_RUNS}, {_WATCHED}, l as (select kind, arg_max(state, id) as state, arg_max(ended_at, id) as ended_at, max(ended_at) filter (state = 'ok') as last_ok from watched group by kind)
 select kind, state = 'failed' and ended_at > timestamp '{AS_OF}' - interval 25 hours as failed,
  case when last_ok is null then kind <> 'restic' else not last_ok > timestamp '{AS_OF}' - interval 26 hours end as absent, last_ok is null as never from l""")
def heartbeat_alerts(spark, sf_dir):
    """A kind alerts where its latest run failed within 25 hours, and where no run was good within 26; both may hold.

    A kind that never was good alerts once there is an archive, unless it is optional."""
    rows = _job_runs(spark, sf_dir)
    kind = F.when((F.col("kind") == "error") & (F.col("id") % 3 == 0), "restic").when((F.col("kind") == "signup") & (F.col("state") == "ok"), "never").otherwise(F.col("kind"))
    bad = (F.col("kind").isin("signup", "error") & (F.col("state") == "ok")) | ((F.col("kind") == "view") & (F.col("id") % 2 == 0))
    rows = rows.where("kind <> 'purchase' or started_at < timestamp'2024-01-20 00:00:00'")
    rows = rows.select("id", kind.alias("kind"), (F.col("started_at") + F.expr("interval 5 minutes")).alias("ended_at"), F.when(bad, "failed").otherwise(F.col("state")).alias("state"))
    within = lambda c, hours: F.col(c) > F.expr(f"timestamp'{AS_OF}' - interval {hours} hours")
    last = rows.groupBy("kind").agg(F.max_by("state", "id").alias("state"), F.max_by("ended_at", "id").alias("ended_at"), F.max(F.when(F.col("state") == "ok", F.col("ended_at"))).alias("last_ok"))
    never = F.col("last_ok").isNull()
    absent = F.when(never, ~F.col("kind").isin(*OPTIONAL_KINDS)).otherwise(~within("last_ok", 26))
    return last.select("kind", ((F.col("state") == "failed") & within("ended_at", 25)).alias("failed"), absent.alias("absent"), never.alias("never"))


@query(f"with {SNAPSHOTS_SQL} select id, k % 4 as attempts, case when ok then 'done' when k % 4 >= 3 then 'failed' else 'pending' end as state, not ok and k % 4 < 3 as eligible from snapshots where provenance <> 'live'")
def backfill_queue_state(spark, sf_dir):
    """Attempts count failed fetches; the third one ends them."""
    rows = lenses.snapshots(spark, sf_dir).where("provenance <> 'live'").withColumn("attempts", F.col("k") % 4)
    state = F.when(F.col("ok"), "done").when(F.col("attempts") >= 3, "failed").otherwise("pending")
    return rows.select("id", "attempts", state.alias("state"), (state == "pending").alias("eligible"))


# ---------------------------------------------------------------- spending


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.broadcast(lenses.extractions(spark).select("normalized_hash", "cost_micros"))  # 16 rows
    return lenses.snapshots(spark, sf_dir).where("ok").join(cost, "normalized_hash").withColumn("live", F.col("provenance") == "live")


COSTS_SQL = f"{SNAPSHOTS_SQL}, {EXTRACTIONS_SQL}, costs as (select s.*, x.cost_micros, s.provenance = 'live' as live from snapshots s join extractions x using (normalized_hash) where s.ok)"


@query(f"with {COSTS_SQL} select strftime(observed_at, '%Y-%m') as month, count(*) as calls, cast(sum(cost_micros) as bigint) as spent, cast(coalesce(sum(cost_micros) filter (not live), 0) as bigint) as backfill from costs group by 1")
def cost_summary(spark, sf_dir):
    month = F.date_format("observed_at", "yyyy-MM").alias("month")
    return _costs(spark, sf_dir).groupBy(month).agg(F.count("*").alias("calls"), F.sum("cost_micros").alias("spent"), F.sum(F.when(F.col("live"), 0).otherwise(F.col("cost_micros"))).alias("backfill"))


@query(f"with {COSTS_SQL} select cast(coalesce(sum(cost_micros), 0) as bigint) as spent, coalesce(sum(cost_micros), 0) >= {BUDGET} as refused from costs where observed_at >= date_trunc('month', timestamp '{AS_OF}')")
def month_spend_budget_gate(spark, sf_dir):
    spent = F.coalesce(F.sum("cost_micros"), F.lit(0))
    rows = _costs(spark, sf_dir).where(F.col("observed_at") >= F.expr(f"date_trunc('month', timestamp'{AS_OF}')"))
    return rows.agg(spent.alias("spent"), (spent >= BUDGET).alias("refused"))


@query(f"""with {COSTS_SQL}, d as (select *, strftime(observed_at, '%Y-%m-%d') as day from costs where live)
 select id, day, cast(spent as bigint) as spent, spent >= 200000 as stopped from (select *, coalesce(sum(cost_micros) over (partition by day order by observed_at, id rows between unbounded preceding and 1 preceding), 0) as spent from d)""")
def budget_running_stop(spark, sf_dir):
    """Live calls in order; once a day has cost its budget, the rest of the day stops."""
    rows = _costs(spark, sf_dir).where("live").withColumn("day", F.date_format("observed_at", "yyyy-MM-dd"))
    found = timeline.spent_before(rows, F.col("cost_micros"), "day", ["observed_at", "id"])
    return found.select("id", "day", "spent", (F.col("spent") >= 200_000).alias("stopped"))


#: Captures that one run drains.
SLICE = 500


@query(f"""with {SNAPSHOTS_SQL}, {EXTRACTIONS_SQL}, x as (select * from extractions where page_state <> 'view:2'), q as (select least(count(*), {SLICE}) as n from snapshots where provenance <> 'live' and not ok and k % 4 < 3),
 u as (select count(*) as n from snapshots s where ok and raw_content is not null and error is null and not exists (select 1 from x where x.normalized_hash = s.normalized_hash)),
 m as (select case when avg(cost_micros) > 0 then cast(floor(avg(cost_micros) + 0.5) as bigint) else 10000 end as mean from x)
 select q.n + u.n as pending, mean, (q.n + u.n) * mean as micros, (q.n + u.n) * mean <= {BUDGET} as within_budget, {BUDGET} // mean as max_calls from q, u, m""")
def backfill_estimate(spark, sf_dir):
    """Captures to drain, at most a slice, and drained ones to extract, at the mean cost of an extraction."""
    x = lenses.extractions(spark).where(~F.col("page_state").isin(*PENDING_STATES))
    rows = lenses.snapshots(spark, sf_dir).join(x.select("normalized_hash", F.lit(True).alias("known")), "normalized_hash", "left")
    queued = F.count_if((F.col("provenance") != "live") & ~F.col("ok") & (F.col("k") % 4 < 3))
    waiting = F.count_if(F.col("ok") & F.col("raw_content").isNotNull() & F.col("error").isNull() & F.col("known").isNull())
    mean = F.avg("cost_micros")
    each = x.agg(F.when(mean > 0, F.floor(mean + 0.5)).otherwise(10_000).alias("mean"))
    work = rows.agg((F.least(queued, F.lit(SLICE)) + waiting).alias("pending")).join(each, F.lit(True))  # one row each
    micros = F.col("pending") * F.col("mean")
    return work.select("pending", "mean", micros.alias("micros"), (micros <= BUDGET).alias("within_budget"), F.floor(F.lit(BUDGET) / F.col("mean")).alias("max_calls"))


@query(f"""with {CHANGES_SQL}, c as (select count(*) as pending, max(observed_at) as last from pairs join state_changes using (before_state, after_state) where materiality >= 40 and observed_at > timestamp '{AS_OF}' - interval 7 days)
 select pending, case when pending = 0 then 'never' when dayofweek(timestamp '{AS_OF}' - interval 6 hours) <> 1 then 'hold' when pending >= 3 then 'fire' else 'hold' end as decision from c""")
def synthesis_trigger(spark, sf_dir):
    """Whether a digest is due: on a Monday in Chicago, with three material changes or more of the last week."""
    recent = F.col("observed_at") > F.expr(f"timestamp'{AS_OF}' - interval 7 days")
    rows = _source_changes(spark, sf_dir).where((F.col("materiality") >= X.THRESHOLD) & recent).agg(F.count("*").alias("pending"))
    monday = F.date_format(F.from_utc_timestamp(F.lit(AS_OF), "America/Chicago"), "E") == "Mon"
    pending = F.col("pending")
    return rows.select("pending", F.when(pending == 0, "never").when(~monday, "hold").when(pending >= 3, "fire").otherwise("hold").alias("decision"))


# ---------------------------------------------------------------- screening and publishing


@query(r"""with o as (select doc_id // 2 as candidate, len(regexp_extract_all(coalesce(text, ''), '[$€£]\s?[0-9]')) as priced, coalesce(len(text), 0) < 200 as low from documents),
 p as (select candidate, count(*) as looks, bool_or(low) as low, min(priced) as least, max(priced) as most from o group by candidate)
 select candidate, case when looks < 2 then 'waiting' when low or least <> most or least < 2 then 'rejected' when least > 8 then 'per product' else 'admitted' end as decision from p""")
def two_observation_admission(spark, sf_dir):
    """A candidate is admitted by two trusted looks that find the same number of prices, 2 to 8."""
    text = F.coalesce("text", F.lit(""))
    looks = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 2).alias("candidate"), X.price_count(text).alias("priced"), (F.char_length(text) < 200).alias("low"))
    rows = looks.groupBy("candidate").agg(F.count("*").alias("looks"), F.bool_or("low").alias("low"), F.min("priced").alias("least"), F.max("priced").alias("most"))
    refused = F.col("low") | (F.col("least") != F.col("most")) | (F.col("least") < 2)
    return rows.select("candidate", F.when(F.col("looks") < 2, "waiting").when(refused, "rejected").when(F.col("least") > 8, "per product").otherwise("admitted").alias("decision"))


@query(r"select doc_id, len(regexp_extract_all(coalesce(text, ''), '[$€£]\s?[0-9]')) as prices from documents")
def price_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.price_count(F.coalesce("text", F.lit(""))).cast("long").alias("prices"))


@query("select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path from pages")
def url_parts(spark, sf_dir):
    part = lambda pattern: F.regexp_extract("url", pattern, 1)
    return table(spark, sf_dir, "pages").select("page_id", part("^([a-z]+)://").alias("scheme"), part("^[a-z]+://([^/?#]*)").alias("host"), part("^[a-z]+://[^/?#]*([^?#]*)").alias("path"))


@query(f"with {RUNS_SQL} select source_id // 3 as competitor, count(distinct source_id) as sources, count(*) as observations, cast(sum(rows) as bigint) as fetches from runs group by 1")
def competitor_payload_counts(spark, sf_dir):
    runs = observe.observation_runs(_valid(spark, sf_dir))
    return runs.groupBy(F.floor(F.col("source_id") / 3).alias("competitor")).agg(F.count_distinct("source_id").alias("sources"), F.count("*").alias("observations"), F.sum("rows").alias("fetches"))


@query("select concat('- ', n_name, ': /', trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-'), '.json') as line from nation")
def llms_lines(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("- "), "n_name", F.lit(": /"), X.slug(F.col("n_name")), F.lit(".json")).alias("line"))


_TABLES = ["customer", "events", "lineitem", "orders", "part", "supplier"]
_TOLERANCE = " union all ".join(f"select '{t}' as name, count(*) as live, count(*) filter (rn > 1) as kept from (select row_number() over () as rn from {t})" for t in _TABLES)


@query(f"select name, live, kept, kept >= live * 0.5 and abs(live - kept) <= greatest(10, live * 0.02) as within from ({_TOLERANCE})")
def backup_tolerance(spark, sf_dir):
    """Row counts of tables against those of a copy that lacks one row."""
    counts = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("live")) for t in _TABLES]
    rows = counts[0]
    for other in counts[1:]:
        rows = rows.unionByName(other)
    kept = F.greatest(F.col("live") - 1, F.lit(0))
    within = (kept >= F.col("live") * 0.5) & (F.abs(F.col("live") - kept) <= F.greatest(F.lit(10.0), F.col("live") * 0.02))
    return rows.select("name", "live", kept.alias("kept"), within.alias("within"))
