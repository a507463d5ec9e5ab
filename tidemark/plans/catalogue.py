"""Registered queries of the archive operators and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import changes, match, observe
from tidemark.plans import lenses
from tidemark.sources import storage
from tidemark.plans.lenses import AS_OF, EXTRACTIONS_SQL, RATES_SQL, SNAPSHOTS_SQL, TIERS_SQL, table

FLAGSHIP = "price_changes_scored"
QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.valid_observations(lenses.snapshots(spark, sf_dir), F.broadcast(lenses.extractions(spark)))  # 16 rows


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = observe.consecutive_pairs(observe.observation_runs(_valid(spark, sf_dir)))
    return pairs.withColumn("pair_id", F.col("to_id"))  # a representative row opens one pair only


VALID_SQL = f"""{SNAPSHOTS_SQL}, {EXTRACTIONS_SQL}, valid as (
 select s.source_id, s.id, s.observed_at, s.page_state, s.normalized_hash, s.provenance, x.confidence
 from snapshots s join extractions x using (normalized_hash) where s.ok and s.error is null and x.currency = 'USD')"""
RUNS_SQL = f"""{VALID_SQL}, flagged as (
 select *, case when lag(normalized_hash) over w is distinct from normalized_hash then 1 else 0 end as changed, lead(page_state) over w as next_state, lead(confidence) over w as next_confidence
 from valid window w as (partition by source_id order by observed_at, id)), numbered as (
 select *, sum(changed) over (partition by source_id order by observed_at, id rows unbounded preceding) as run from flagged), runs as (
 select source_id, cast(run as bigint) as run, arg_min(id, (observed_at, id)) as first_id, min(observed_at) as first_at, max(observed_at) as last_at,
  arg_min(page_state, (observed_at, id)) as page_state, arg_min(confidence, (observed_at, id)) as confidence,
  max(case when rn = 1 then next_state end) as next_state, max(case when rn = 1 then next_confidence end) as next_confidence, count(*) as rows,
  case when count(distinct provenance like 'wayback:%') > 1 then 'mixed' when bool_or(provenance like 'wayback:%') then 'wayback' else 'live' end as provenance
 from (select *, row_number() over (partition by source_id, run order by observed_at, id) as rn from numbered) group by source_id, run)"""
PAIRS_SQL = f"""{RUNS_SQL}, pairs as (select * from (
 select source_id, run, lag(first_id) over w as from_id, first_id as to_id, first_at as observed_at, lag(page_state) over w as before_state, page_state as after_state,
  lag(confidence) over w as before_confidence, confidence as after_confidence, next_state, next_confidence, first_id as pair_id
 from runs window w as (partition by source_id order by run)) where from_id is not null)"""


@query(f"with {VALID_SQL} select source_id, id, epoch_us(observed_at) as at_us, page_state, confidence from valid")
def valid_observations(spark, sf_dir):
    return _valid(spark, sf_dir).select("source_id", "id", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("at_us"), "page_state", "confidence")


@query(f"with {RUNS_SQL} select source_id, run, first_id, epoch_us(first_at) as first_us, epoch_us(last_at) as last_us, page_state, rows, provenance from runs")
def observation_runs(spark, sf_dir):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return observe.observation_runs(_valid(spark, sf_dir)).select("source_id", "run", "first_id", us("first_at").alias("first_us"), us("last_at").alias("last_us"), "page_state", "rows", "provenance")


@query(f"with {PAIRS_SQL} select source_id, run, from_id, to_id, before_state, after_state from pairs")
def consecutive_pairs(spark, sf_dir):
    return observe.consecutive_pairs(observe.observation_runs(_valid(spark, sf_dir))).select("source_id", "run", "from_id", "to_id", "before_state", "after_state")


@query(f"with {VALID_SQL} select source_id, id, lead(id) over (partition by source_id order by observed_at, id) as next_id from valid")
def next_raw_observation(spark, sf_dir):
    return _valid(spark, sf_dir).select("source_id", "id", F.lead("id").over(W.partitionBy("source_id").orderBy("observed_at", "id")).alias("next_id"))


# ---------------------------------------------------------------- changes

#: What changes between two states is worked out once for each two that follow each other somewhere, and joined to the pairs.


#: Pairs of states that are matched in one task.
FEW_STATES = 20_000


def _state_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, before_state and after_state of every two states that follow each other."""
    return pairs.select("before_state", "after_state").distinct().withColumn("pair_id", F.concat_ws(">", "before_state", "after_state"))


def _on(pairs: DataFrame, rows: DataFrame, side: str) -> DataFrame:
    return pairs.select("pair_id", F.col(f"{side}_state").alias("page_state")).join(F.broadcast(rows), "page_state")  # of 16 states


def _state_changes(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """All typed and scored changes between the states of ``pairs``: pair_id and the change."""
    tiers, rates, x = lenses.tiers(spark), lenses.rates(spark), lenses.extractions(spark).select("page_state", "notes")
    of_tiers = changes.tier_changes(match.match_tiers(_on(pairs, tiers, "before"), _on(pairs, tiers, "after"), changes.FIELDS))
    of_rates = changes.rate_changes(match.match_rates(_on(pairs, rates, "before"), _on(pairs, rates, "after")))
    noted = _on(pairs, x, "before").select("pair_id", F.col("notes").alias("before_notes")).join(_on(pairs, x, "after").select("pair_id", F.col("notes").alias("after_notes")), "pair_id")
    return changes.scored(changes.first_emissions(of_tiers.unionByName(of_rates).unionByName(changes.notes_changes(noted))))


def _source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = storage.written(_pairs(spark, sf_dir).drop("pair_id"), "pairs")
    states = storage.written(_state_pairs(pairs), "state-pairs")
    if states.count() <= FEW_STATES:
        states = states.coalesce(1)  # matching has a dozen windows over a pair: none of them shuffles one partition
    found = storage.written(_state_changes(spark, states).join(states, "pair_id").drop("pair_id"), "state-changes")
    return pairs.join(storage.small(found), ["before_state", "after_state"])


_NAME = r"trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g'), '\b(plan|tier)\b', '', 'g'))"
_CLOSE = "((b.monthly is null and a.monthly is null) or coalesce(abs(b.monthly - a.monthly) / nullif(greatest(abs(b.monthly), abs(a.monthly)), 0) <= 0.15, b.monthly = a.monthly, false))"
#: Needs tables before_t and after_t with pair_id, ord, name, monthly.
MATCH_SQL = f"""b1 as (select *, row_number() over (partition by pair_id, name order by ord) as k from before_t),
 a1 as (select *, row_number() over (partition by pair_id, name order by ord) as k from after_t),
 m1 as (select b.pair_id, b.ord as before_ord, a.ord as after_ord, 'exact' as how from b1 b join a1 a on b.pair_id = a.pair_id and b.name = a.name and b.k = a.k),
 b2 as (select *, row_number() over (partition by pair_id, {_NAME} order by ord) as k from before_t t where not exists (select 1 from m1 where m1.pair_id = t.pair_id and m1.before_ord = t.ord)),
 a2 as (select *, row_number() over (partition by pair_id, {_NAME} order by ord) as k from after_t t where not exists (select 1 from m1 where m1.pair_id = t.pair_id and m1.after_ord = t.ord)),
 m2 as (select b.pair_id, b.ord as before_ord, a.ord as after_ord, 'normalized' as how from b2 b join a2 a on b.pair_id = a.pair_id and {_NAME.replace('name', 'b.name')} = {_NAME.replace('name', 'a.name')} and b.k = a.k),
 b3 as (select * from b2 t where not exists (select 1 from m2 where m2.pair_id = t.pair_id and m2.before_ord = t.ord)),
 a3 as (select * from a2 t where not exists (select 1 from m2 where m2.pair_id = t.pair_id and m2.after_ord = t.ord)),
 m3 as (select b.pair_id, b.ord as before_ord, a.ord as after_ord, 'positional' as how from b3 b join a3 a on b.pair_id = a.pair_id and b.ord = a.ord and {_CLOSE}),
 matched as (select * from m1 union all select * from m2 union all select * from m3
  union all select pair_id, ord, null, 'removed' from b3 t where not exists (select 1 from m3 where m3.pair_id = t.pair_id and m3.before_ord = t.ord)
  union all select pair_id, null, ord, 'added' from a3 t where not exists (select 1 from m3 where m3.pair_id = t.pair_id and m3.after_ord = t.ord))"""
_NUM = "coalesce(case when {0} = floor({0}) then cast(cast({0} as bigint) as varchar) else cast({0} as varchar) end, 'null')"
_TEXT = "coalesce(concat('\"', {0}, '\"'), 'null')"
_FLAGS = "concat('{{\"is_free\":', {0}.is_free, ',\"is_enterprise\":', {0}.is_enterprise, '}}')"


def _tier_sql(t: str) -> str:
    parts = [f"'{{\"name\":\"', {t}.name, '\",\"monthly_price_usd\":', {_NUM.format(t + '.monthly')}, ',\"annual_price_usd\":', {_NUM.format(t + '.annual')}, ',\"billing_unit\":\"', {t}.billing_unit"]
    parts.append(f"'\",\"included_seats\":', {_NUM.format(t + '.seats')}, ',\"is_free\":', {t}.is_free, ',\"is_enterprise\":', {t}.is_enterprise, ',\"headline_features\":', {t}.features, '}}'")
    return f"concat({', '.join(parts)})"


_METRIC = r"array_to_string([case when length(w) > 3 and w like '%s' then w[:-2] else w end for w in string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' ') if w not in ('', 'plan', 'tier', 'the', 'a', 'an', 'billed', 'monthly', 'annually')], ' ')"
#: Needs sp (pair_id, before_state, after_state) and the tables of states.
RATES_MATCH_SQL = f"""rb as (select pair_id, r.*, row_number() over (partition by pair_id, metric order by ord) as k from sp join rates r on r.page_state = before_state),
 ra as (select pair_id, r.*, row_number() over (partition by pair_id, metric order by ord) as k from sp join rates r on r.page_state = after_state),
 r1 as (select b.pair_id, b.ord as bo, a.ord as ao from rb b join ra a on a.pair_id = b.pair_id and a.metric = b.metric and a.k = b.k),
 rb2 as (select *, {_METRIC.format('metric')} as key from rb where not exists (select 1 from r1 where r1.pair_id = rb.pair_id and r1.bo = rb.ord)),
 ra2 as (select *, {_METRIC.format('metric')} as key from ra where not exists (select 1 from r1 where r1.pair_id = ra.pair_id and r1.ao = ra.ord)),
 r2 as (select b.pair_id, any_value(b.ord) as bo, any_value(a.ord) as ao from rb2 b join ra2 a on a.pair_id = b.pair_id and a.key = b.key group by b.pair_id, b.key having count(*) = 1),
 rate_match as (select pair_id, bo, ao, 'exact' as how from r1 union all select pair_id, bo, ao, 'normalized' from r2
  union all select pair_id, ord, null, 'removed' from rb2 where not exists (select 1 from r2 where r2.pair_id = rb2.pair_id and r2.bo = rb2.ord)
  union all select pair_id, null, ord, 'added' from ra2 where not exists (select 1 from r2 where r2.pair_id = ra2.pair_id and r2.ao = ra2.ord))"""
_KINDS = [
    ("tier_added", "concat('tiers.', a.name)", "'null'", _tier_sql("a"), "how = 'added'"),
    ("tier_removed", "concat('tiers.', b.name)", _tier_sql("b"), "'null'", "how = 'removed'"),
    ("tier_renamed", "concat('tiers.', a.name)", _TEXT.format("b.name"), _TEXT.format("a.name"), "how = 'positional'"),
    *[("price_changed", f"concat('tiers.', a.name, '.{name}')", _NUM.format(f"b.{f}"), _NUM.format(f"a.{f}"), f"how not in ('added', 'removed') and b.{f} is distinct from a.{f}") for f, name in (("monthly", "monthly_price_usd"), ("annual", "annual_price_usd"))],
    ("billing_unit_changed", "concat('tiers.', a.name, '.billing_unit')", _TEXT.format("b.billing_unit"), _TEXT.format("a.billing_unit"), "how not in ('added', 'removed') and b.billing_unit <> a.billing_unit"),
    ("seats_changed", "concat('tiers.', a.name, '.included_seats')", _NUM.format("b.seats"), _NUM.format("a.seats"), "how not in ('added', 'removed') and b.seats is distinct from a.seats"),
    ("flag_changed", "concat('tiers.', a.name, '.flags')", _FLAGS.format("b"), _FLAGS.format("a"), "how not in ('added', 'removed') and (b.is_free <> a.is_free or b.is_enterprise <> a.is_enterprise)"),
    ("features_changed", "concat('tiers.', a.name, '.headline_features')", "b.features", "a.features", "how not in ('added', 'removed') and b.features <> a.features"),
]
_JOINED = "from matched m left join before_t b on b.pair_id = m.pair_id and b.ord = m.before_ord left join after_t a on a.pair_id = m.pair_id and a.ord = m.after_ord"
_PLACE = "case how when 'exact' then 0 when 'normalized' then 1 when 'positional' then 2 when 'removed' then 3 else 4 end"
_TIER_EVENTS = " union all ".join(
    f"select m.pair_id, '{k}' as change_type, {path} as json_path, {b} as before, {a} as after, {'b.' + f if k == 'price_changed' else 'null::double'} as x, {'a.' + f if k == 'price_changed' else 'null::double'} as y, (0, {_PLACE}, coalesce(b.ord, a.ord), {i}) as place {_JOINED} where {when}"
    for i, (k, path, b, a, when) in enumerate(_KINDS) for f in ["monthly" if "monthly" in path else "annual"]
)
_RATE_EVENTS = " union all ".join(
    f"select m.pair_id, '{k}', concat('usage_rates.', {metric}), {b}, {a}, null, null, (1, {_PLACE}, coalesce(b.ord, a.ord), {i}) from rate_match m left join rb b on b.pair_id = m.pair_id and b.ord = m.bo left join ra a on a.pair_id = m.pair_id and a.ord = m.ao where {when}"
    for i, (k, metric, b, a, when) in enumerate((
        ("usage_rate_added", "a.metric", "'null'", _NUM.format("a.unit_price"), "how = 'added'"),
        ("usage_rate_removed", "b.metric", _NUM.format("b.unit_price"), "'null'", "how = 'removed'"),
        ("usage_rate_changed", "a.metric", _NUM.format("b.unit_price"), _NUM.format("a.unit_price"), "how in ('exact', 'normalized') and a.unit_price <> b.unit_price"),
    ))
)
STATE_CHANGES_SQL = f"""{TIERS_SQL}, {RATES_SQL},
 sp as (select distinct before_state, after_state, concat(before_state, '>', after_state) as pair_id from pairs),
 before_t as (select sp.pair_id, t.* from sp join tiers t on t.page_state = sp.before_state), after_t as (select sp.pair_id, t.* from sp join tiers t on t.page_state = sp.after_state), {MATCH_SQL}, {RATES_MATCH_SQL},
 ev as (select * from ({_TIER_EVENTS} union all {_RATE_EVENTS}
  union all select pair_id, 'notes_changed', 'notes', {_TEXT.format('b.notes')}, {_TEXT.format('a.notes')}, null, null, (2, 0, 0, 0) from sp join extractions b on b.page_state = before_state join extractions a on a.page_state = after_state where a.notes <> b.notes)
  qualify row_number() over (partition by pair_id, json_path order by place) = 1),
 state_changes as (select sp.before_state, sp.after_state, change_type, json_path, before, after, cast(case change_type when 'tier_added' then 100 when 'tier_removed' then 100
   when 'price_changed' then case when x is null or y is null then 35 when x = 0 then 80 else least(100, 80 + least(20, floor(abs((y - x) / x * 100) + 0.5))) end
   when 'billing_unit_changed' then case when before = '"unknown"' or after = '"unknown"' then 35 else 70 end when 'flag_changed' then 60 when 'seats_changed' then 50 when 'tier_renamed' then 35
   when 'features_changed' then 10 when 'notes_changed' then 5 else 30 end as integer) as materiality from ev join sp using (pair_id))"""
CHANGES_SQL = f"{PAIRS_SQL}, {STATE_CHANGES_SQL}"
#: What the paths of each state hold.
VALUES_SQL = f"""firsts as (select * from tiers qualify row_number() over (partition by page_state, name order by ord) = 1), held as (
 select page_state, concat('tiers.', name) as json_path, {_tier_sql('t')} as value from firsts t union all select page_state, concat('tiers.', name, '.monthly_price_usd'), {_NUM.format('monthly')} from firsts
 union all select page_state, concat('tiers.', name, '.annual_price_usd'), {_NUM.format('annual')} from firsts union all select page_state, concat('tiers.', name, '.billing_unit'), {_TEXT.format('billing_unit')} from firsts
 union all select page_state, concat('tiers.', name, '.included_seats'), {_NUM.format('seats')} from firsts union all select page_state, concat('tiers.', name, '.flags'), {_FLAGS.format('t')} from firsts t
 union all select page_state, concat('tiers.', name, '.headline_features'), features from firsts)"""
_SHOWN = ["source_id", "from_id", "to_id", "change_type", "json_path", "before", "after", "materiality"]


@query(f"with {CHANGES_SQL} select before_state, after_state, change_type, json_path, before, after, materiality from state_changes")
def materiality_scores(spark, sf_dir):
    states = _state_pairs(_pairs(spark, sf_dir))
    return _state_changes(spark, states).join(states, "pair_id").select("before_state", "after_state", "change_type", "json_path", "before", "after", "materiality")


@query(f"with {CHANGES_SQL} select source_id, from_id, to_id, change_type, json_path, before, after, materiality from pairs join state_changes using (before_state, after_state)")
def change_events_all(spark, sf_dir):
    return _source_changes(spark, sf_dir).select(*_SHOWN)


@query(f"with {CHANGES_SQL} select source_id, from_id, to_id, change_type, json_path, before, after, materiality from pairs join state_changes using (before_state, after_state) where change_type = 'price_changed' and materiality >= 40")
def price_changes_scored(spark, sf_dir):
    return _source_changes(spark, sf_dir).where((F.col("change_type") == "price_changed") & (F.col("materiality") >= X.THRESHOLD)).select(*_SHOWN)


CONFIRM_SQL = f"""{CHANGES_SQL}, {VALUES_SQL}, judged as (
 select c.*, case when next_state is null or coalesce(after_confidence = 'low' or next_confidence = 'low', false) then 'candidate'
  when change_type in ('tier_added', 'tier_removed') then case when (nv <> 'null') = (after <> 'null') then 'confirmed' else 'retracted' end
  when nv = after then 'confirmed' when nv = before then 'retracted' else 'disputed' end as state
 from (select c.*, coalesce(h.value, 'null') as nv from (select * from pairs join state_changes using (before_state, after_state) where materiality >= 40) c
  left join held h on h.page_state = c.next_state and h.json_path = c.json_path) c)"""


def _confirmed(spark, sf_dir) -> DataFrame:
    """Material changes with their state by the next look at the page."""
    rows = _source_changes(spark, sf_dir).where(F.col("materiality") >= X.THRESHOLD)
    looks = changes.values_at(lenses.tiers(spark), lenses.rates(spark), lenses.extractions(spark))
    rows = rows.join(F.broadcast(looks.select(F.col("page_state").alias("next_state"), "json_path", F.col("value").alias("next_value"))), ["next_state", "json_path"], "left")
    low = (F.col("after_confidence") == "low") | (F.col("next_confidence") == "low")
    return changes.confirmed(rows.withColumns({"next_seen": F.col("next_state").isNotNull(), "low": low}))


@query(f"with {CONFIRM_SQL} select to_id, json_path, change_type, state from judged where change_type not in ('tier_added', 'tier_removed')")
def confirm_states(spark, sf_dir):
    """Confirmation of values by the next look."""
    return _confirmed(spark, sf_dir).where(~F.col("change_type").isin("tier_added", "tier_removed")).select("to_id", "json_path", "change_type", "state")


@query(f"with {CONFIRM_SQL} select to_id, json_path, change_type, state from judged where change_type in ('tier_added', 'tier_removed')")
def confirm_presence_tiers(spark, sf_dir):
    """Tiers that came or went are confirmed by presence, not by what they hold."""
    return _confirmed(spark, sf_dir).where(F.col("change_type").isin("tier_added", "tier_removed")).select("to_id", "json_path", "change_type", "state")


_OD_SQL = """op as (select o_orderkey as pair_id, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous from orders),
 ot as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as ord,
  concat('P', cast(l_partkey % 5 as varchar), case when l_suppkey % 3 = 0 then ' Plan' else '' end) as name, cast(floor(l_extendedprice / l_quantity) as double) as monthly from lineitem),
 before_t as (select pair_id, ord, name, monthly from op join ot on previous = l_orderkey), after_t as (select pair_id, ord, name, monthly from op join ot on pair_id = l_orderkey where previous is not null)"""


@query(f"with {_OD_SQL}, {MATCH_SQL} select pair_id, cast(before_ord as bigint) as before_ord, cast(after_ord as bigint) as after_ord, how from matched")
def tier_match_exact_norm_positional(spark, sf_dir):
    found = match.match_tiers(*lenses.order_tiers(spark, sf_dir), tasks=lenses.order_tasks(spark, sf_dir))
    return found.select("pair_id", F.col("before.ord").cast("long").alias("before_ord"), F.col("after.ord").cast("long").alias("after_ord"), "how")


# ---------------------------------------------------------------- archive health and reports


@query(f"with {SNAPSHOTS_SQL} select id, source_id, first_value(id) over w as content_id, row_number() over w = 1 as keeps_bytes from snapshots where ok window w as (partition by source_id, raw_hash order by observed_at, id)")
def content_dedup(spark, sf_dir):
    return observe.content_dedup(lenses.snapshots(spark, sf_dir)).drop("raw_hash")


@query(f"with {RUNS_SQL} select source_id, count_if(provenance = 'live') as live, count_if(provenance = 'wayback') as wayback, count_if(provenance = 'mixed') as mixed from runs group by source_id")
def provenance_mix(spark, sf_dir):
    count = lambda kind: F.count_if(F.col("provenance") == kind).alias(kind)
    return observe.observation_runs(_valid(spark, sf_dir)).groupBy("source_id").agg(count("live"), count("wayback"), count("mixed"))


@query(f"with {RUNS_SQL} select source_id, epoch_us(min(first_at)) as first_us, epoch_us(max(last_at)) as last_us from runs group by source_id")
def first_last_observed(spark, sf_dir):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return observe.observation_runs(_valid(spark, sf_dir)).groupBy("source_id").agg(us(F.min("first_at")).alias("first_us"), us(F.max("last_at")).alias("last_us"))


def _recent(hours: int):
    return F.expr(f"timestamp'{AS_OF}' - interval {hours} hours")


@query(f"with {SNAPSHOTS_SQL} select source_id from snapshots group by source_id having max(date_trunc('second', observed_at)) <= timestamp '{AS_OF}' - interval 24 hours")
def due_sources(spark, sf_dir):
    last = lenses.snapshots(spark, sf_dir).groupBy("source_id").agg(F.max(F.date_trunc("second", "observed_at")).alias("last"))
    return last.where(F.col("last") <= _recent(24)).select("source_id")


@query(f"with {SNAPSHOTS_SQL} select source_id from snapshots group by source_id having coalesce(max(case when ok then date_trunc('second', observed_at) end) <= timestamp '{AS_OF}' - interval 48 hours, true)")
def stale_sources(spark, sf_dir):
    last = lenses.snapshots(spark, sf_dir).groupBy("source_id").agg(F.max(F.when(F.col("ok"), F.date_trunc("second", "observed_at"))).alias("last"))
    return last.where(F.coalesce(F.col("last") <= _recent(48), F.lit(True))).select("source_id")


@query(f"with {SNAPSHOTS_SQL}, l as (select source_id, arg_max(ok, (observed_at, id)) as ok, arg_max(coalesce(error, ''), (observed_at, id)) as e, count(distinct raw_hash) as states from snapshots group by source_id) select source_id, states, case when not ok then 'failing' when e <> '' then 'degraded' else 'ok' end as state from l")
def source_health_state(spark, sf_dir):
    latest = F.struct("observed_at", "id")
    rows = lenses.snapshots(spark, sf_dir).groupBy("source_id").agg(F.max_by("ok", latest).alias("ok"), F.max_by(F.coalesce("error", F.lit("")), latest).alias("e"), F.count_distinct("raw_hash").alias("states"))
    return rows.select("source_id", "states", F.when(~F.col("ok"), "failing").when(F.col("e") != "", "degraded").otherwise("ok").alias("state"))


@query(f"with {SNAPSHOTS_SQL} select count(*) as snapshots, count_if(ok) as ok_rows, count(distinct normalized_hash) as states, count_if(ok and raw_content is null) as identical, count_if(error like 'extraction%') as rejected, epoch_us(min(observed_at)) as first_us, epoch_us(max(observed_at)) as last_us, count(distinct strftime(observed_at, '%Y-%m')) as months from snapshots")
def coverage(spark, sf_dir):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return lenses.snapshots(spark, sf_dir).agg(
        F.count("*").alias("snapshots"), F.count_if("ok").alias("ok_rows"), F.count_distinct("normalized_hash").alias("states"),
        F.count_if(F.col("ok") & F.col("raw_content").isNull()).alias("identical"), F.count_if(F.col("error").like("extraction%")).alias("rejected"),
        us(F.min("observed_at")).alias("first_us"), us(F.max("observed_at")).alias("last_us"), F.count_distinct(F.date_format("observed_at", "yyyy-MM")).alias("months"),
    )


@query(r"select n_name, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') as slug from nation")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", X.slug(F.col("n_name")).alias("slug"))


@query(r"""select p_partkey, concat_ws(',', cast(p_partkey as varchar), case when t like '%"%' or t like '%,%' then concat('"', replace(t, '"', '""'), '"') else t end) as line
 from (select p_partkey, case when regexp_matches(p_name, '^[=+@-]') then concat('''', p_name) else coalesce(p_name, '') end as t from part)""")
def csv_lines(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", F.col("p_partkey").cast("string"), X.csv_field(F.col("p_name"))).alias("line"))


@query(f"with {SNAPSHOTS_SQL} select id, epoch_us(observed_at) // 1000000 as captured from snapshots where provenance like 'wayback:%'")
def wayback_timestamps(spark, sf_dir):
    rows = lenses.snapshots(spark, sf_dir).where(F.col("provenance").startswith("wayback:"))
    return rows.select("id", F.unix_seconds(X.capture_instant(F.substring("provenance", 9, 14)).cast("timestamp")).alias("captured"))
