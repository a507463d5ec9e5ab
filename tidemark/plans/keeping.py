"""Queries of addresses, stored documents, merges by natural key, and orders of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import addresses, documents
from tidemark.operators import merging, observe
from tidemark.plans import lenses
from tidemark.plans.catalogue import EXTRACTIONS_SQL, RUNS_SQL, query
from tidemark.plans.lenses import table
from tidemark.sources.storage import dealt, new_folder

_V4 = "concat_ws('.', cast(n % 256 as {text}), cast(n * 7 % 256 as {text}), cast(n * 3 % 256 as {text}), '1')"
_HOSTS = [
    "{v4}", "concat('::ffff:', {v4})", "concat('[fc', lpad(cast(n % 100 as {text}), 2, '0'), '::', cast(n % 1000 as {text}), ']')", "concat('fe', cast(70 + n % 30 as {text}), ':0:0:0:0:0:0:', cast(n % 9999 as {text}))",
    "case when n % 2 = 0 then '::1' else '::2' end", "concat('2001:DB8::', cast(n % 9999 as {text}), ':1')", "concat(cast(n % 9999 as {text}), '::2::3')", "concat('host', cast(n as {text}), '.example')",
    "case when n % 2 = 0 then '::ffff:7f00:1' else '::FFFF:808:808' end", "concat('1.2.3.', cast(200 + n % 100 as {text}))",
]


def _host(text: str) -> str:
    forms = " ".join(f"when {i} then {f.format(v4=_V4.format(text=text), text=text)}" for i, f in enumerate(_HOSTS))
    return f"case n % {len(_HOSTS)} {forms} end"


_IN_V4 = "(n % 256 in (127, 10) or (n % 256 = 169 and n * 7 % 256 = 254) or (n % 256 = 172 and n * 7 % 256 between 16 and 31) or (n % 256 = 192 and n * 7 % 256 = 168))"


@query(f"""select n, {_host('varchar')} as host, case n % {len(_HOSTS)} when 0 then {_IN_V4} when 1 then {_IN_V4} when 2 then true when 3 then 70 + n % 30 between 80 and 99 when 4 then n % 2 = 0 when 6 then true
 when 8 then n % 2 = 0 when 9 then 200 + n % 100 > 255 else false end as blocked from (select cast(c_custkey as bigint) as n from customer)""")
def destinations_of_both_families(spark, sf_dir):
    """Hosts in every form: IPv4, IPv6 with groups left out, one inside the other, names, and what is no address."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("n")).withColumn("host", F.expr(_host("string")))
    return rows.withColumn("blocked", addresses.blocked_host(F.col("host")))


# ---------------------------------------------------------------- stored documents

#: A sound document, and parts of it that are replaced: fault -> (part, replacement, what is found).
_SOUND = '{"currency":"USD","tiers":[{"name":"Pro","monthly_price_usd":9.5,"annual_price_usd":null,"billing_unit":"flat","included_seats":3,"is_free":false,"is_enterprise":false,"headline_features":["a"]}],"usage_rates":[{"metric":"calls","unit_price_usd":1}],"notes":null,"extraction_confidence":"high"}'
_FAULTS = [
    ("", "", ""),
    ('"high"}', '"high"', "not JSON"),
    ('"USD"', "7", "currency: expected string, got number"),
    ('"name":"Pro",', "", "tiers[0].name: expected string, got missing"),
    ("9.5", '"9.5"', "tiers[0].monthly_price_usd: expected number or null, got string"),
    ('"flat"', '"yearly"', "tiers[0].billing_unit: expected one of per_seat, flat, usage, unknown"),
    ('["a"]', '["a","b","c","d","e","f","g","h","i"]', "tiers[0].headline_features: more than 8 items"),
    ('"is_free":false', '"is_free":"no"', "tiers[0].is_free: expected boolean, got string"),
    (',"notes":null', "", "notes: expected string or null, got missing"),
    ('"high"', '"sure"', "extraction_confidence: expected one of high, medium, low"),
    ('"metric":"calls","unit_price_usd":1', '"metric":null', "usage_rates[0].metric: expected string, got null; usage_rates[0].unit_price_usd: expected number, got missing"),
    ('{"metric":"calls","unit_price_usd":1}', "3", "usage_rates[0]: expected object, got number"),
]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    fault = F.get_json_object("props", "$.k").cast("int") % len(_FAULTS)
    text = F.lit(_SOUND)
    for i, (part, other, _) in enumerate(_FAULTS):
        if part:
            text = F.when(fault == i, F.lit(_SOUND.replace(part, other, 1))).otherwise(text)
    return dealt(table(spark, sf_dir, "events"), "event_id", 100_000).select(F.col("event_id").alias("id"), text.alias("data"))


_FOUND_SQL = " ".join(f"when {i} then '{found}'" for i, (_, _, found) in enumerate(_FAULTS))


@query(f"select event_id as id, case cast(json_extract(props, '$.k') as int) % {len(_FAULTS)} {_FOUND_SQL} end as violations, cast(json_extract(props, '$.k') as int) % {len(_FAULTS)} = 0 as valid from events")
def schema_valid_rows(spark, sf_dir):
    """Stored documents, with what is wrong with each."""
    found = documents.schema_violations(F.col("data"))
    return _documents(spark, sf_dir).select("id", F.array_join(found, "; ").alias("violations")).withColumn("valid", F.col("violations") == "")


#: States whose stored document is broken, and states that only another version of the prompt has read.
BROKEN, OTHER_VERSION = ("click:2", "view:1"), ("purchase:1",)
_SKIPPED = ", ".join(f"'{s}'" for s in BROKEN + OTHER_VERSION)
_VERSIONED_RUNS_SQL = RUNS_SQL.replace("x.currency = 'USD'", f"x.currency = 'USD' and s.page_state not in ({_SKIPPED})")


@query(f"with {_VERSIONED_RUNS_SQL} select source_id, run, first_id, page_state, rows from runs")
def runs_of_sound_documents(spark, sf_dir):
    """Runs over rows whose document is sound and of the current version; the others are transparent."""
    x = lenses.extractions(spark)
    data = F.when(F.col("page_state").isin(*BROKEN), F.lit(_SOUND.replace('"flat"', '"yearly"'))).otherwise(F.lit(_SOUND))
    first = x.withColumns({"data": data, "prompt_version": F.when(F.col("page_state").isin(*OTHER_VERSION), "v0").otherwise("v1")})
    again = first.where("page_state in ('view:0', 'click:3')").withColumn("prompt_version", F.lit("v0"))  # read by both versions
    sound = observe.sound_extractions(first.unionByName(again), "v1")
    runs = observe.observation_runs(observe.valid_observations(lenses.snapshots(spark, sf_dir), F.broadcast(sound)))  # 16 rows
    return runs.select("source_id", "run", "first_id", "page_state", "rows")


# ---------------------------------------------------------------- merges


def _seed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(stored, config): customers as sources; the configuration names some of them anew, some twice."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("n"), "c_name")
    slug = F.concat(F.lit("c"), F.col("n").cast("string")).alias("slug")
    stored = c.where("n % 3 <> 0").select(slug, F.col("c_name").alias("name"), F.lit(24).alias("cadence"), (F.col("n") % 7 != 0).alias("active"), F.when(F.col("n") % 5 == 0, "HTTP 500").alias("degraded"))
    some = c.where("n % 2 = 0").select("n", slug, F.explode(F.when(F.col("n") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("nth"))
    config = some.select("slug", F.concat(F.lit("Config "), F.col("n").cast("string"), F.lit("."), F.col("nth").cast("string")).alias("name"), (F.col("nth") * 6).alias("cadence"), F.lit(True).alias("active"), "nth")
    return stored, merging.last_of_key(config, ["slug"], "nth").drop("nth")


def _upsert(stored: DataFrame, config: DataFrame) -> DataFrame:
    return merging.upserted(stored, config, ["slug"], ["name", "cadence", "active"], {"degraded": F.lit(None)})


@query("""select concat('c', n) as slug, case when n % 4 = 0 then concat('Config ', n, '.2') when n % 2 = 0 then concat('Config ', n, '.1') else c_name end as name, case when n % 4 = 0 then 12 when n % 2 = 0 then 6 else 24 end as cadence,
 n % 2 = 0 or n % 7 <> 0 as active, case when n % 3 <> 0 and n % 5 = 0 then 'HTTP 500' end as degraded from (select cast(c_custkey as bigint) as n, c_name from customer) where n % 3 <> 0 or n % 2 = 0""")
def seed_upsert(spark, sf_dir):
    """Sources after two runs of one configuration, kept as versions of a table: what runs have left on them stays."""
    folder = new_folder(spark, "sources")
    stored, config = _seed(spark, sf_dir)
    merging.published(stored, folder)
    for _ in range(2):
        merging.published(_upsert(merging.current(spark, folder), config), folder)
    return merging.current(spark, folder)


# ---------------------------------------------------------------- orders of names

_NAMED = "concat(case p_partkey % 6 when 0 then 'éclair' when 1 then 'Eclair' when 2 then 'eclair' when 3 then 'zeta' when 4 then 'Äpfel' else 'Zeta' end, ' ', cast(p_partkey % 50 as {text}))"


@query(f"select p_brand, p_partkey, name, row_number() over (partition by p_brand order by name collate en, p_partkey) as place, row_number() over (partition by p_brand order by name, p_partkey) as binary_place from (select p_brand, p_partkey, {_NAMED.format(text='varchar')} as name from part)")
def series_order(spark, sf_dir):
    """Series of each brand as a reader of the language sorts them, and as bytes sort."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.expr(_NAMED.format(text="string")).alias("name"))
    place = lambda c: F.row_number().over(W.partitionBy("p_brand").orderBy(c, "p_partkey")).cast("long")
    return rows.withColumns({"place": place(F.collate("name", "UNICODE")), "binary_place": place(F.col("name"))})
