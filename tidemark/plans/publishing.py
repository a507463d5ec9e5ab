"""Queries of what is published. A source belongs to the competitor of its number's remainder by 40."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import datasets, publishing
from tidemark.plans import lenses
from tidemark.plans.catalogue import CONFIRM_SQL, ORACLES, _confirmed, _valid, query
from tidemark.plans.crawling import _PLAIN, _XML, LABEL_SQL
from tidemark.plans.guards import _tier_rows
from tidemark.plans.lenses import AS_OF
from tidemark.sources.storage import new_folder, written

COMPETITORS, VERSION = 40, "v2"
SITE, TITLE, ABOUT = "https://tidemark.example", "Price changes", "Confirmed price changes & plans."


def _dimensions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(competitors, sources)."""
    sources = lenses.table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id")).distinct().withColumn("competitor_id", F.col("source_id") % COMPETITORS)
    n = F.col("competitor_id").cast("string")
    competitors = sources.select("competitor_id").distinct().select("competitor_id", F.concat(F.lit('Maker "'), n, F.lit('" & Co')).alias("name"), F.concat(F.lit("maker-"), n).alias("slug"), F.concat(F.lit("https://maker"), n, F.lit(".example/")).alias("homepage"))
    return competitors, sources


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    competitors, sources = _dimensions(spark, sf_dir)
    path_rank = F.row_number().over(lenses.W.partitionBy("to_id").orderBy("json_path"))
    rows = written(_confirmed(spark, sf_dir).withColumn("change_id", F.col("to_id") * 100 + path_rank), "published-changes")
    analyses = rows.select("change_id", F.explode(F.when(F.col("to_id") % 3 == 0, F.array(F.lit("v1"), F.lit(VERSION))).when(F.col("to_id") % 3 == 1, F.array(F.lit("v1"))).otherwise(F.array().cast("array<string>"))).alias("prompt_version"))
    note = lambda what: F.concat(F.lit(f"{what} "), F.col("change_id").cast("string"), F.lit(" <"), "prompt_version", F.lit(">"))
    analyses = analyses.select("change_id", "prompt_version", note("it means").alias("implication"), note("so").alias("so_what"), F.lit("high").alias("confidence"))
    changes = rows.select("change_id", "source_id", "change_type", "json_path", "before", "after", "materiality", "observed_at", "state")
    return publishing.change_feed(changes, sources, competitors, analyses, VERSION, 40)


_ISO_SQL = "'%Y-%m-%dT%H:%M:%SZ'"
_NAME_SQL = f"concat('Maker \"', source_id % {COMPETITORS}, '\" & Co')"
_FEED_SQL = f"""{CONFIRM_SQL}, ch as (select *, to_id * 100 + row_number() over (partition by to_id order by json_path) as change_id from judged),
 feed as (select change_id, source_id, {_NAME_SQL} as competitor, concat('maker-', source_id % {COMPETITORS}) as slug, change_type, json_path, before, after, materiality, observed_at,
  case when to_id % 3 = 0 then concat('it means ', change_id, ' <{VERSION}>') end as implication, case when to_id % 3 = 0 then concat('so ', change_id, ' <{VERSION}>') end as so_what,
  case when to_id % 3 = 0 then 'high' end as confidence from ch where state = 'confirmed' order by observed_at desc, change_id desc limit 200)"""
_ENTRY_SQL = f"""concat('{{"competitor":', to_json(competitor), ',"slug":', to_json(slug), ',"change_type":', to_json(change_type), ',"json_path":', to_json(json_path), ',"before":', before, ',"after":', after,
 ',"materiality":', materiality, ',"observed_at":"', strftime(observed_at, {_ISO_SQL}), '","annotation":', case when implication is null then 'null' else concat('{{"implication":', to_json(implication), ',"so_what":', to_json(so_what), ',"confidence":"high"}}') end, '}}')"""


@query(f"with {_FEED_SQL} select change_id, {_ENTRY_SQL} as entry from feed")
def change_feed(spark, sf_dir):
    """The 200 latest confirmed changes with their competitor and the annotation of the current prompt."""
    feed = _feed(spark, sf_dir)
    return feed.select("change_id", publishing.entry_json(feed).alias("entry"))


_SOURCES_SQL = f"""src as (select source_id, source_id % {COMPETITORS} as competitor_id, max(observed_at) filter (ok) as last_ok, count(distinct raw_hash) as states, arg_max_null(error, (observed_at, id)) as reason from snapshots group by source_id),
 cur as (select source_id, arg_max(page_state, (observed_at, id)) as page_state from valid group by source_id),
 src_json as (select competitor_id, concat('kind', lpad(source_id::varchar, 9, '0')) as kind, concat('{{"kind":"', concat('kind', lpad(source_id::varchar, 9, '0')), '","url":"https://maker', competitor_id, '.example/pricing/', source_id, '","state":"', case when reason is null then 'ok' else 'degraded' end,
  '","last_ok_at":', coalesce('"' || strftime(last_ok, {_ISO_SQL}) || '"', 'null'), ',"distinct_states":', states, ',"degraded_reason":', coalesce('"' || reason || '"', 'null'), ',"current_pricing":', coalesce('{{"state":"' || page_state || '"}}', 'null'), '}}') as j
  from src left join cur using (source_id))"""


@query(f"""with {_FEED_SQL}, {_SOURCES_SQL}, b as (select competitor_id, concat('[', string_agg(j, ',' order by kind), ']') as j from src_json group by 1),
 e as (select slug, concat('[', string_agg({_ENTRY_SQL}, ',' order by observed_at desc, change_id desc), ']') as j from feed group by 1)
 select concat('maker-', competitor_id) as slug, concat('{{"generated_at":"{AS_OF}","slug":"maker-', competitor_id, '","name":', to_json(concat('Maker "', competitor_id, '" & Co')), ',"homepage":"https://maker', competitor_id, '.example/","sources":', b.j, ',"changes":', coalesce(e.j, '[]'), '}}') as payload
 from b left join e on e.slug = concat('maker-', competitor_id)""")
def competitor_payloads(spark, sf_dir):
    """One JSON document a competitor, written as one file a slug and read back."""
    competitors, sources = _dimensions(spark, sf_dir)
    rows = lenses.snapshots(spark, sf_dir).groupBy("source_id").agg(
        F.max(F.when(F.col("ok"), F.col("observed_at"))).alias("last_ok_at"), F.count_distinct("raw_hash").alias("distinct_states"), F.max_by("error", F.struct("observed_at", "id")).alias("degraded_reason")
    )
    state = _valid(spark, sf_dir).groupBy("source_id").agg(F.max_by("page_state", F.struct("observed_at", "id")).alias("page_state"))
    rows = sources.join(rows, "source_id").join(state, "source_id", "left")
    url = F.concat(F.lit("https://maker"), F.col("competitor_id").cast("string"), F.lit(".example/pricing/"), F.col("source_id").cast("string"))
    rows = rows.select(
        "competitor_id", F.concat(F.lit("kind"), F.lpad(F.col("source_id").cast("string"), 9, "0")).alias("kind"), url.alias("url"), F.when(F.col("degraded_reason").isNull(), "ok").otherwise("degraded").alias("state"),
        "last_ok_at", "distinct_states", "degraded_reason", F.concat(F.lit('{"state":"'), "page_state", F.lit('"}')).alias("current"),
    )
    folder = new_folder(spark, "payloads")
    publishing.write_payloads(publishing.competitor_payloads(competitors, rows, _feed(spark, sf_dir), AS_OF), folder)
    return spark.read.schema("value string, slug string").text(folder, wholetext=True).select("slug", F.rtrim(F.regexp_replace("value", "\n$", "")).alias("payload"))


_CSV_NUMBER = "coalesce(case when {0} = floor({0}) then cast(cast({0} as bigint) as varchar) else cast({0} as varchar) end, '')"


@query(f"""select concat_ws(',', concat('"Maker ""', source_id % {COMPETITORS}, '"" & Co"'), tier, strftime(make_timestamp(first_us), {_ISO_SQL}), strftime(make_timestamp(last_us), {_ISO_SQL}), {_CSV_NUMBER.format('monthly')}, {_CSV_NUMBER.format('annual')}, billing_unit, {_CSV_NUMBER.format('seats')},
 case when is_free then 'true' else 'false' end, case when is_enterprise then 'true' else 'false' end, 'USD', provenance) as line from ({ORACLES['dataset_runs']})
 union all select 'competitor,tier,first_observed_at,last_observed_at,monthly_price_usd,annual_price_usd,billing_unit,included_seats,is_free,is_enterprise,currency,provenance'""")
def dataset_csv(spark, sf_dir):
    """The published dataset: its header, and a line for each run of a tier."""
    rows = datasets.dataset_runs(_tier_rows(spark, sf_dir))
    at = lambda c: F.date_format(F.timestamp_micros(c).cast("timestamp_ntz"), publishing.ISO)
    rows = rows.select(
        F.concat(F.lit('Maker "'), (F.col("source_id") % COMPETITORS).cast("string"), F.lit('" & Co')).alias("competitor"), "tier", at(F.col("first_us")).alias("first_observed_at"), at(F.col("last_us")).alias("last_observed_at"),
        F.col("monthly").alias("monthly_price_usd"), F.col("annual").alias("annual_price_usd"), "billing_unit", F.col("seats").alias("included_seats"), "is_free", "is_enterprise", F.lit("USD").alias("currency"), "provenance",
    )
    return publishing.csv_rows(rows).select("line").unionByName(spark.range(1).select(F.lit(",".join(publishing.CSV_COLUMNS)).alias("line")))


_RSS_LABEL = LABEL_SQL
_ITEM_SQL = f"""concat('<item><title>', {_XML.format("concat(competitor, ' ', label)")}, '</title><link>{SITE}/c/', slug, '/</link><description>', {_XML.format("case when implication is not null then concat(implication, ' — ', so_what) when before like '{%' or after like '{%' then label else concat(" + _PLAIN.format('before') + ", ' -> ', " + _PLAIN.format('after') + ") end")},
 '</description><guid isPermaLink=' || chr(34) || 'false' || chr(34) || '>', slug, '|', {_XML.format('json_path')}, '|', strftime(observed_at, {_ISO_SQL}), '</guid><pubDate>', strftime(observed_at, '%a, %d %b %Y %H:%M:%S GMT'), '</pubDate></item>')"""


@query(f"""with {_FEED_SQL}, t as (select *, {_RSS_LABEL} as label from feed order by observed_at desc, change_id desc limit 50)
 select concat('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{TITLE}</title><link>{SITE}</link><description>Confirmed price changes &amp; plans.</description><lastBuildDate>', strftime(timestamp '{AS_OF}', '%a, %d %b %Y %H:%M:%S GMT'), '</lastBuildDate>',
  coalesce(string_agg({_ITEM_SQL}, '' order by observed_at desc, change_id desc), ''), '</channel></rss>') as xml from t""")
def rss_channel(spark, sf_dir):
    """The whole channel: what it is, and its 50 newest items with links and annotations."""
    return publishing.rss_channel(_feed(spark, sf_dir), TITLE, ABOUT, SITE, AS_OF)
