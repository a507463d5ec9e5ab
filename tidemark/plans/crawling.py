"""Registered queries of crawling rules, screening in numbers, feeds and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import crawling
from tidemark.plans.catalogue import CHANGES_SQL, CONFIRM_SQL, _confirmed, _source_changes, query
from tidemark.plans.lenses import table
from tidemark.sources import storage
from tidemark.streaming import archive

AGENT = "Archivist"
_ROBOTS = r"""case n_regionkey % 5
 when 0 then concat('User-agent: *', chr(10), 'Disallow: /es/', chr(10), 'Allow: /es/1*', chr(10), 'Disallow: /*5$')
 when 1 then concat('# rules', chr(13), chr(10), 'User-Agent: other', chr(10), 'user-agent: archivist', chr(10), 'Disallow: /en', chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow: /')
 when 2 then concat('User-agent: *', chr(10), 'Disallow:', chr(10), 'User-agent: archivist', chr(10), 'Allow: /', chr(10), 'Disallow: /de/ # closed')
 when 3 then concat('User-agent: nobody', chr(10), 'Disallow: /')
 else concat('User-agent: *', chr(10), 'Disallow: /fr', chr(10), 'Allow: /fr', chr(10), 'User-agent: *', chr(10), 'Disallow: /news/*x') end"""
_PATH = "regexp_extract(coalesce(url, ''), '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_HOST = "page_id % 25"


@query(rf"""with f as (select n_nationkey as host, {_ROBOTS} as robots from nation),
 l as (select host, pos, trim(regexp_replace(regexp_replace(line, '\r$', ''), '#.*$', '')) as line from (select host, unnest(string_split(robots, chr(10))) as line, generate_subscripts(string_split(robots, chr(10)), 1) as pos from f)),
 r as (select host, pos, lower(trim(split_part(line, ':', 1))) as field, trim(line[instr(line, ':') + 1:]) as value from l where instr(line, ':') > 0),
 k as (select * from r where field = 'user-agent' or (field in ('allow', 'disallow') and value <> '')),
 g as (select *, sum(opens) over (partition by host order by pos) as part from (select *, case when field = 'user-agent' and coalesce(lag(field) over (partition by host order by pos), '') <> 'user-agent' then 1 else 0 end as opens from k)),
 a as (select host, part, lower(value) as agent from g where field = 'user-agent'),
 c as (select distinct host, part from a where agent = case when exists (select 1 from a b where b.host = a.host and b.agent = 'archivist') then 'archivist' else '*' end),
 u as (select host, field = 'allow' as allow, length(value) as n, concat('^', replace(regexp_replace(regexp_replace(value, '\$$', ''), '([.+?^${{}}()|\[\]\\])', '\\\1', 'g'), '*', '.*'), case when value like '%$' then '$' else '' end) as regex from g join c using (host, part) where field <> 'user-agent'),
 p as (select page_id, {_HOST} as host, {_PATH} as path from pages),
 b as (select page_id, coalesce(max(n) filter (allow), -1) as a, coalesce(max(n) filter (not allow), -1) as d from p left join u on u.host = p.host and regexp_matches(path, regex) group by page_id)
 select page_id, d = -1 or a >= d as allowed from b""")
def robots_decision(spark, sf_dir):
    """Whether each page's path may be fetched by the robots file of its host."""
    files = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("host"), F.expr(_ROBOTS.replace("\n", " ")).alias("robots"))
    paths = table(spark, sf_dir, "pages").select("page_id", F.expr(_HOST).cast("long").alias("host"), F.expr(_PATH).alias("path"))
    return crawling.robots_decisions(paths, crawling.robots_rules(files, AGENT)).select("page_id", "allowed")


@query("""with recursive e as (select event_id, user_id as host, epoch(date_trunc('second', ts)) as sec, row_number() over (partition by user_id order by ts, event_id) as k from events),
 s as (select event_id, host, sec, k, sec as starts from e where k = 1 union all select e.event_id, e.host, e.sec, e.k, greatest(e.sec, s.starts + 3600) from s join e on e.host = s.host and e.k = s.k + 1)
 select event_id, cast(starts as bigint) as starts from s""")
def host_rate_schedule(spark, sf_dir):
    """Requests of a user an hour apart at least."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("host"), "ts", F.unix_seconds(F.date_trunc("second", "ts").cast("timestamp")).alias("at"))
    return crawling.spaced(rows, "host", "at", ["ts", "event_id"], 3600).select("event_id", F.col("starts").cast("long").alias("starts"))


# ---------------------------------------------------------------- screening in numbers

_KINDS = {
    "Prices per product or unit, not per plan": "reason like 'prices per product or unit rather than per plan%'",
    "Extraction failed grounding or schema": "reason like '%failed:%'",
    "Attempts did not reproduce a plausible tier count": "reason like 'attempt 1 extracted%attempt 2 extracted%' and reason not like '%failed:%'",
}
_CANDIDATES = """select d.doc_id, d.lang as category, case when quality = 1 and toxic = 0 then 'admit' when toxic = 1 and quality = 0 then 'fail' else 'reject' end as verdict,
 case d.doc_id % 4 when 0 then 'prices per product or unit rather than per plan (12 rows)' when 1 then 'attempt 2 failed: ungrounded' when 2 then 'attempt 1 extracted 3, attempt 2 extracted 5' else 'attempt 1 extracted 3, attempt 2 failed: invalid' end as reason
 from documents d join labels l on l.doc_id = d.doc_id"""


@query(f"""with c as ({_CANDIDATES}), n as (select count(*) as all_, count_if(verdict = 'admit') as good from c), s as (
 select 'verdict' as kind, verdict as name, count(*) as n from c group by verdict union all select 'admitted', category, count(*) from c where verdict = 'admit' group by category
 {' '.join(f"union all select 'rejected', '{k}', count_if(verdict = 'reject' and {w}) from c" for k, w in _KINDS.items())})
 select kind, name, n, case when kind = 'verdict' and name = 'admit' and all_ > 0 then floor(good * 1000 / all_ + 0.5) / 10 end as percent from s, n""")
def screening_summary(spark, sf_dir):
    """Candidates by verdict, admitted ones by category, rejected ones by three kinds of reason; the share admitted."""
    for name in ("documents", "labels"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    rows = spark.sql(_CANDIDATES)
    count = F.count("*").alias("n")
    verdicts = rows.groupBy("verdict").agg(count).select(F.lit("verdict").alias("kind"), F.col("verdict").alias("name"), "n")
    admitted = rows.where("verdict = 'admit'").groupBy("category").agg(count).select(F.lit("admitted").alias("kind"), F.col("category").alias("name"), "n")
    of = [F.struct(F.lit(k).alias("name"), F.count_if((F.col("verdict") == "reject") & F.expr(w)).alias("n")) for k, w in _KINDS.items()]
    rejected = rows.agg(F.array(*of).alias("r")).select(F.lit("rejected").alias("kind"), F.inline("r"))
    share = rows.agg(F.count("*").alias("all"), F.count_if(F.col("verdict") == "admit").alias("good"))
    found = verdicts.unionByName(admitted).unionByName(rejected).join(share, F.lit(True))  # one row of totals
    percent = F.when((F.col("kind") == "verdict") & (F.col("name") == "admit") & (F.col("all") > 0), F.floor(F.col("good") * 1000 / F.col("all") + 0.5) / 10)
    return found.select("kind", "name", "n", percent.alias("percent"))


# ---------------------------------------------------------------- labels, feed, annotations


def _label(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label", X.change_label(F.col("change_type"), F.col("json_path"), F.col("before"), F.col("after")))


_PLAIN = "case when {0} = 'null' then 'none' when {0} like '\"%' then {0}[2:-2] when {0} like '[%' then array_to_string(cast(cast({0} as json) as varchar[]), ',') when {0} like '{{%' then '[object Object]' else {0} end"
_MONEY = "concat('$', case when cast({0} as double) = floor(cast({0} as double)) then format('{{:,}}', cast({0} as bigint)) else {0} end)"
_NAME = r"regexp_replace(json_path, '^tiers[.]', '')"
_TIER = rf"case when json_path not like 'tiers.%' then json_path when regexp_matches({_NAME}, '[.]') then regexp_replace({_NAME}, '[.][^.]*$', '') else {_NAME} end"
_FIELD = "regexp_extract(json_path, '[^.]*$')"
LABEL_SQL = f"""case when change_type = 'price_changed' then concat({_TIER}, ' ', case when {_FIELD} = 'monthly_price_usd' then '' else concat(replace(regexp_replace({_FIELD}, '_usd$', ''), '_', ' '), ' ') end,
 case when before <> 'null' and after <> 'null' then concat({_MONEY.format('before')}, ' → ', {_MONEY.format('after')}) else concat({_PLAIN.format('before')}, ' to ', {_PLAIN.format('after')}) end)
 else concat({_TIER}, ' ', replace(change_type, '_', ' ')) end"""


@query(f"with {CHANGES_SQL} select distinct change_type, json_path, before, after, {LABEL_SQL} as label from state_changes")
def marker_labels(spark, sf_dir):
    """The literal label of every change."""
    rows = _source_changes(spark, sf_dir).select("change_type", "json_path", "before", "after").distinct()
    return _label(rows).select("change_type", "json_path", "before", "after", "label")


_XML = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&apos;')"


@query(f"""with {CONFIRM_SQL}, t as (select to_id, observed_at, json_path, {LABEL_SQL} as label, before, after, source_id from judged where state = 'confirmed' order by observed_at desc, to_id desc, json_path limit 50)
 select to_id, json_path, concat('<item><title>', {_XML.format("concat('Source ', source_id, ' ', label)")}, '</title><description>', {_XML.format("case when before like '{%' or after like '{%' then label else concat(" + _PLAIN.format('before') + ", ' -> ', " + _PLAIN.format('after') + ") end")},
 '</description><guid isPermaLink=' || chr(34) || 'false' || chr(34) || '>', {_XML.format('source_id::varchar')}, '|', {_XML.format('json_path')}, '|', strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ'), '</guid><pubDate>', strftime(observed_at, '%a, %d %b %Y %H:%M:%S GMT'), '</pubDate></item>') as item from t""")
def rss_items(spark, sf_dir):
    """The feed's 50 latest confirmed changes as items; a change of a whole tier is described by its label."""
    rows = _confirmed(spark, sf_dir).where("state = 'confirmed'").orderBy(F.desc("observed_at"), F.desc("to_id"), "json_path").limit(50)
    rows = _label(rows)
    whole = F.col("before").startswith("{") | F.col("after").startswith("{")
    described = F.when(whole, F.col("label")).otherwise(F.concat(X.plain_value(F.col("before")), F.lit(" -> "), X.plain_value(F.col("after"))))
    at = lambda pattern: F.date_format("observed_at", pattern)
    item = F.concat(
        F.lit("<item><title>"), X.escape_xml(F.concat(F.lit("Source "), F.col("source_id").cast("string"), F.lit(" "), F.col("label"))), F.lit("</title><description>"), X.escape_xml(described),
        F.lit('</description><guid isPermaLink="false">'), F.col("source_id").cast("string"), F.lit("|"), X.escape_xml(F.col("json_path")), F.lit("|"), at("yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("</guid><pubDate>"), at("EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate></item>"),
    )
    return rows.select("to_id", "json_path", item.alias("item"))


#: Notes hang on changes of the archive before a rebuild: one or two on some, another version on others, and some on a path that is gone.
NOTES = [("to_id % 3 = 0", "json_path", 1, 0), ("to_id % 15 = 0", "json_path", 1, 1), ("to_id % 21 = 0", "json_path", 2, 2), ("to_id % 97 = 0", "'tiers.Gone'", 1, 3)]


@query(f"""with {CHANGES_SQL}, c as (select source_id, json_path, observed_at, to_id as change_id, to_id from pairs join state_changes using (before_state, after_state) where materiality >= 40),
 a as ({" union all ".join(f"select distinct concat(to_id, ':', json_path, ':', {kind}) as note_id, source_id, {path} as json_path, observed_at, {version} as version from c where {which}" for which, path, version, kind in NOTES)}),
 s as (select source_id, json_path, observed_at, min(change_id) as change_id from c group by all),
 m as (select a.note_id, s.change_id, row_number() over (partition by s.change_id, s.json_path, version order by note_id) as nth from a left join s using (source_id, json_path, observed_at))
 select note_id, case when nth = 1 then change_id end as change_id, case when change_id is null then 'orphaned' when nth > 1 then 'redundant' else 'relinked' end as fate from m""")
def annotation_relink(spark, sf_dir):
    """Notes go back to the first rebuilt change of their source, path and time; redundant ones and those without one are orphans."""
    rows = _source_changes(spark, sf_dir).where(F.col("materiality") >= X.THRESHOLD).select("source_id", "json_path", "observed_at", "to_id")
    rows = storage.written(rows, "relink-changes")
    kinds = [F.when(F.expr(which), F.struct(F.lit(kind).alias("kind"), F.expr(path).alias("path"), F.lit(version).alias("version"))) for which, path, version, kind in NOTES]
    notes = rows.select("*", F.explode(F.filter(F.array(*kinds), lambda n: n.isNotNull())).alias("n"))
    note_id = F.concat_ws(":", F.col("to_id").cast("string"), "json_path", F.col("n.kind").cast("string"))
    notes = notes.select(note_id.alias("note_id"), "source_id", F.col("n.path").alias("json_path"), "observed_at", F.col("n.version").alias("version")).distinct()
    found = archive.relinked(notes, rows.select("source_id", "json_path", "observed_at", F.struct("to_id", "json_path").alias("change_id")))
    return found.select("note_id", F.col("change_id.to_id").alias("change_id"), "fate")


@query(f"""with {CONFIRM_SQL} select to_id, json_path from judged j where state = 'confirmed' and to_id % 2 = 1 order by observed_at, to_id, json_path limit 20""")
def pending_synthesis(spark, sf_dir):
    """The 20 oldest confirmed changes without an analysis; every other change has one."""
    rows = _confirmed(spark, sf_dir).where("state = 'confirmed'")
    analysed = rows.where("to_id % 2 = 0").select("to_id", "json_path").distinct()
    return rows.join(analysed, ["to_id", "json_path"], "left_anti").orderBy("observed_at", "to_id", "json_path").limit(20).select("to_id", "json_path")
