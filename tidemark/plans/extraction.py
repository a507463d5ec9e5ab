"""Registered queries of page normalisation, extraction checks and screening, over parts as priced pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.functions import markup
from tidemark.operators import extraction
from tidemark.plans.catalogue import query
from tidemark.plans.lenses import table
from tidemark.sources.storage import dealt


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, dealt to tasks by their number: a row of few bytes becomes a page or a text that takes its time."""
    return dealt(table(spark, sf_dir, "part"), "p_partkey")


_PRICED = (
    "concat('<html><body><nav>Home $1</nav><div class=\"cookie-banner\">ok $2</div><main><div><h2>', p_type, '</h2><p>$', cast(p_size as {t}), '/mo</p></div> <div><h2>Pro</h2><p>$', cast(cast(floor(p_retailprice) as bigint) as {t}), "
    "'/mo</p></div></main><style>p {{ }}</style ><footer>$3</footer></body></html>')"
)
_PRICED_TEXT = "concat(p_type, '$', cast(p_size as varchar), '/mo Pro$', cast(cast(floor(p_retailprice) as bigint) as varchar), '/mo')"


@query(f"select p_partkey, {_PRICED_TEXT} as text, sha256({_PRICED_TEXT}) as normalized_hash from part")
def html_normalize_closed_form(spark, sf_dir):
    """Pages whose text is known: noise goes, the slice stops where each of two blocks holds half of the prices."""
    pages = _parts(spark, sf_dir).select("p_partkey", F.expr(_PRICED.format(t="string")).alias("html"))
    return pages.select("p_partkey", markup.normalized(F.col("html")).alias("n")).select("p_partkey", "n.*")


@query()
def html_normalize(spark, sf_dir):
    """The normal text of every page; without prices it is that of the whole body. (No SQL: it needs a parser.)"""
    return table(spark, sf_dir, "pages").select("page_id", markup.normalized(F.col("html")).alias("n")).select("page_id", "n.*")


_HAYSTACK = "concat(repeat('ab ', cast(p_partkey % 50 as int)), '$1 $2', repeat(' cd', 60), ' $3 £4 €5 ', repeat('ef', cast(p_size as int)), ' $6')"


@query(rf"""with t as (select p_partkey, {_HAYSTACK} as text from part), s as (select p_partkey, text, unnest(range(0, greatest(0, length(text) - 100) + 1, 12)) as start from t),
 n as (select p_partkey, start, len(regexp_extract_all(text[start + 1:start + 100], '[$€£]\s?[0-9]')) as prices from s)
 select p_partkey, cast(arg_max(start, (prices, -start)) as bigint) as start, max(prices) as prices from n group by p_partkey""")
def densest_window(spark, sf_dir):
    """Where the window of 100 characters with most prices starts."""
    rows = _parts(spark, sf_dir).select("p_partkey", F.expr(_HAYSTACK).alias("text"))
    best = X.densest_window(F.col("text"), 100, 12)
    return rows.select("p_partkey", best.alias("b")).select("p_partkey", (-F.col("b.start")).cast("long").alias("start"), F.col("b.prices").cast("long").alias("prices"))


#: What a page says and what was read from it; every fifth reading is made up.
_SAID = """select p_partkey, concat(p_type, '$', cast(p_size as {t}), '/mo Pro$', {price}, '/mo',
  case p_partkey % 5 when 0 then ' StarterFree plan' when 1 then ' Starter - Free forever' when 2 then ' Risk-free guarantee' when 3 then ' Free' else ' starter Freelance' end) as text, p_size, p_retailprice from part"""
_CLAIMS = [
    ("'tiers.Starter.monthly_price_usd'", "'Starter'", "cast(0 as double)", "true"),
    ("'tiers.Free.monthly_price_usd'", "'Free'", "cast(0 as double)", "true"),
    ("'tiers.Pro.monthly_price_usd'", "'Pro'", "cast(floor(p_retailprice) as double)", "false"),
    ("'tiers.Team.monthly_price_usd'", "'Team'", "cast(case when p_partkey % 5 = 4 then p_size + 0.5 else p_size end as double)", "false"),
    ("'usage_rates.calls.unit_price_usd'", "cast(null as {t})", "cast(case when p_partkey % 3 = 0 then 0 end as double)", "cast(null as boolean)"),
]


def _claims_sql(t: str, price: str) -> str:
    said = _SAID.format(t=t, price=price)
    return " union all ".join(f"select p_partkey, text, {place} as place, {name.format(t=t)} as name, {value} as value, {free} as is_free from ({said}) s" for place, name, value, free in _CLAIMS)


_SHOWN = "case when value = floor(value) then cast(cast(value as bigint) as varchar) else cast(value as varchar) end"
_STANDS = r"regexp_matches(replace(text, ',', ''), concat('(^|[^0-9.])', replace({0}, '.', '\.'), '($|[^0-9.])'))"
_TWO = "printf('%.2f', value)"


@query(rf"""with c as ({_claims_sql('varchar', "format('{:,}', cast(floor(p_retailprice) as bigint))")}) select p_partkey, concat(place, ' = ', {_SHOWN}, ' does not appear in the page text') as violation from c
 where value is not null and not ({_STANDS.format(_SHOWN)} or {_STANDS.format(_TWO)} or {_STANDS.format(f"regexp_replace({_TWO}, '[.]?0+$', '')")})
 and not (value = 0 and coalesce(is_free, false) and case when lower(trim(coalesce(name, ''))) = 'free' then regexp_matches(text, '(^|[^a-zA-Z])(?i:free)($|[^a-z])')
  else regexp_matches(text, concat('(^|[^a-zA-Z])(?i:', coalesce(name, ''), ')[\s\pP]{{0,6}}(?i:free)($|[^a-z])')) end)""")
def grounding_violations(spark, sf_dir):
    """Read prices that the page does not hold."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    claims = spark.sql(_claims_sql("string", "format_number(floor(p_retailprice), 0)"))
    return extraction.grounding_violations(claims).select("p_partkey", "violation")


_FREE = "select p_partkey, concat('T', cast(p_partkey % 9 as {t})) as name, cast(case p_partkey % 4 when 0 then 0 when 1 then null when 2 then p_size + 0.5 else p_size end as double) as monthly, cast(case p_partkey % 3 when 0 then 0 when 1 then null else p_size end as double) as annual, p_partkey % 5 < 3 as is_free from part"


@query(f"""with f as ({_FREE.format(t='varchar')}), v as (
 select p_partkey, concat('tiers.', name, '.is_free = true but monthly_price_usd = ', coalesce({_SHOWN.replace('value', 'monthly')}, 'null'), ' (free tiers must price at 0)') as violation from f where is_free and monthly is distinct from 0
 union all select p_partkey, concat('tiers.', name, '.is_free = true but annual_price_usd = ', {_SHOWN.replace('value', 'annual')}, ' (free tiers must price at 0)') from f where is_free and annual <> 0) select * from v""")
def consistency_violations(spark, sf_dir):
    """Tiers called free with a price, or without a known one."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return extraction.consistency_violations(spark.sql(_FREE.format(t="string"))).select("p_partkey", "violation")


_WORDS = "case p_partkey % 5 when 0 then 'Business' when 1 then 'Kilimanjaro' when 2 then 'Sales' when 3 then 'Tiny' else 'Professional' end"
_OTHER = "case p_partkey % 3 when 0 then 'Business' when 1 then 'Everest' else 'Ordinaryly' end"
_SECOND = "case when p_partkey % 7 = 0 then 'free' else '$9' end"
_CANDIDATE = f"concat('<html><body><nav>Home $1</nav><main><div><h2>', {_WORDS}, '</h2><p>$', cast(p_size as {{t}}), '/mo</p></div> <div><h2>', {_OTHER}, '</h2><p>', {_SECOND}, '</p></div></main></body></html>')"
_NAMES = "['Enterprise', 'Business', 'Professional', 'Team', 'Starter', 'Growth', 'Scale', 'Premium', 'Standard', 'Individual', 'Organization', 'Developer', 'Hobby', 'Solo', 'Basic', 'Plus', 'Pro']"
SCREEN_SQL = rf"""raw as (select p_partkey, {_CANDIDATE.format(t='varchar')} as raw, case when p_partkey % 7 = 0 then concat('$', cast(p_size as varchar), '/mo') else concat({_WORDS}, '$', cast(p_size as varchar), '/mo ', {_OTHER}, '$9') end as text from part),
 h as (select *, len(regexp_extract_all(text, '[$€£]\s?[0-9]')) as prices, [x for x in regexp_extract_all(text, '([A-Z][a-zA-Z]{{1,24}})[$€£]\s?[0-9]', 1) if x <> 'Sales'] as found from raw),
 p as (select p_partkey, arg_min(name, (n, -length(name), i)) as plan from (select p_partkey, name, i, (length(raw) - length(replace(raw, name, ''))) // length(name) as n from raw, (select unnest({_NAMES}) as name, generate_subscripts({_NAMES}, 1) as i)) where n >= 1 group by p_partkey),
 w as (select p_partkey, arg_min(x, (case when n <= 2 then 0 else 1 end, -length(x), i)) as word from (select p_partkey, x, i, (length(raw) - length(replace(raw, x, ''))) // length(x) as n from (select p_partkey, raw, unnest(found) as x, generate_subscripts(found, 1) as i from h) where length(x) >= 8) where n >= 1 group by p_partkey),
 screened as (select p_partkey, prices, len(found) as headings, coalesce(plan, word) as canary from h left join p using (p_partkey) left join w using (p_partkey))"""


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _parts(spark, sf_dir).select("p_partkey", F.expr(_CANDIDATE.format(t="string")).alias("raw"))
    return extraction.screened(pages.withColumn("text", markup.normalized(F.col("raw"))["text"]))


@query(f"""with {SCREEN_SQL} select p_partkey, case when prices >= 2 then 'pass' else 'fail' end as verdict, prices as price_matches, headings as tier_headings,
 case when prices >= 2 then concat(prices, ' price matches in the normalized text (', headings, ' tier-like headings)') else concat('fewer than 2 price matches (found ', prices, ')') end as reason from screened""")
def candidate_score(spark, sf_dir):
    """Whether a page has prices enough to be a source."""
    found = _screened(spark, sf_dir)
    return found.select("p_partkey", "verdict", F.col("price_matches").cast("long").alias("price_matches"), F.col("tier_headings").cast("long").alias("tier_headings"), "reason")


@query(f"with {SCREEN_SQL} select p_partkey, canary from screened")
def canary_pick(spark, sf_dir):
    """The text of the raw page whose loss tells of a redesign."""
    return _screened(spark, sf_dir).select("p_partkey", F.col("proposed_canary").alias("canary"))
