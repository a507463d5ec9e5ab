"""URL filter by rules and, beyond them, by trust and distrust over the host link graph.

Rules are (host, path prefix, verdict); the longest that fits a url decides. The pages that no
rule fits are judged by their host. Personalised PageRank spreads trust along links from hosts
with allowed pages; the same walk on reversed links spreads distrust from hosts with blocked
pages, since a page that links to a blocked host is suspect. Both are distributions: each host starts with
its share of all allowed (blocked) pages, and what hosts without links would lose goes back to the
seeds. Rounds end when the ranks have settled. A host is blocked where its distrust exceeds its trust.

DataFrame operations only. Edges are counted per pair of hosts before anything is joined, so a
page that repeats a link, or a host with a third of all pages, adds one row per target.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and
is allowed unless its host '' is distrusted; null html has no links; repeated rows are judged
alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_now, written

# The rules of the query (host, path prefix, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DAMPING = 0.85
#: Ranks have settled when a round moves no more than this share of the trust and of the distrust;
#: a round moves DAMPING of what the one before moved at most, so that about 60 rounds always do.
SETTLED = 1e-4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Targets of absolute and protocol-relative links.
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def ranked(nodes: DataFrame, flows: DataFrame, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """host, trust, distrust: personalised PageRank of the seeds t0 along the flows, and of d0 against them.

    ``nodes``: host, t0, d0 (each sums to 1, or to 0 without seeds); ``flows``: src, dst, fwd, bwd (shares of a host's links)."""
    spark = nodes.sparkSession
    rank, path = nodes.select("host", "t0", "d0", F.col("t0").alias("t"), F.col("d0").alias("d")), None
    moved = 1.0 if flows.head(1) else 0.0
    while moved > settled:
        gained = flows.join(rank.select(F.col("host").alias("src"), "t"), "src").select(F.col("dst").alias("host"), (F.col("t") * F.col("fwd")).alias("t"), F.lit(0.0).alias("d"))
        lost = flows.join(rank.select(F.col("host").alias("dst"), "d"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("d") * F.col("bwd")).alias("d"))
        flow = gained.unionByName(lost).groupBy("host").agg(F.sum("t").alias("ft"), F.sum("d").alias("fd"))
        rows = rank.join(flow, "host", "left").select("host", "t0", "d0", "t", "d", F.coalesce("ft", F.lit(0.0)).alias("ft"), F.coalesce("fd", F.lit(0.0)).alias("fd"))
        back = rows.agg((F.sum("t") - F.sum("ft")).alias("bt"), (F.sum("d") - F.sum("fd")).alias("bd"))  # one row
        step = lambda f, s, b: (1 - damping) * F.col(s) + damping * (F.col(f) + F.col(b) * F.col(s))
        now = rows.crossJoin(F.broadcast(back)).select("host", "t0", "d0", step("ft", "t0", "bt").alias("t"), step("fd", "d0", "bd").alias("d"), F.col("t").alias("was_t"), F.col("d").alias("was_d"))
        now, new_path = written(now, "host-rank")
        change = now.agg(F.sum(F.abs(F.col("t") - F.col("was_t"))), F.sum(F.abs(F.col("d") - F.col("was_d")))).first()
        rank, moved = now.drop("was_t", "was_d"), max(x or 0.0 for x in change)
        if path:
            drop_now(spark, path)
        path = new_path
    return rank.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"))


def judged(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules=RULES, damping: float = DAMPING, threshold: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    pages = df.select(df[page_id].alias("page_id"), host_of(df[url]).alias("host"), path_of(df[url]).alias("path"), df[html].alias("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.withColumn("rule", rule).withColumn("ruled", verdict)
    seeds = pages.groupBy("host").agg(
        F.count_if(F.col("ruled") == "allow").cast("double").alias("t0"), F.count_if(F.col("ruled") == "block").cast("double").alias("d0")
    )
    links = F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda x: F.translate(x, UPPER, LOWER))
    edges = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(links)).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    edges, _ = written(edges, "host-edges")
    # Each node's links are shares of 1, forwards for trust and backwards for distrust.
    outs, ins = edges.groupBy("src").agg(F.sum("w").alias("out")), edges.groupBy("dst").agg(F.sum("w").alias("in"))
    flows, _ = written(edges.join(outs, "src").join(ins, "dst").select("src", "dst", (F.col("w") / F.col("out")).alias("fwd"), (F.col("w") / F.col("in")).alias("bwd")), "host-flows")
    nodes = seeds.select("host", "t0", "d0").unionByName(edges.select(F.col("dst").alias("host"), F.lit(0.0).alias("t0"), F.lit(0.0).alias("d0")))
    nodes = nodes.groupBy("host").agg(F.sum("t0").alias("t0"), F.sum("d0").alias("d0"))
    nodes, _ = written(nodes, "host-seeds")
    totals = nodes.agg(F.sum("t0").alias("all_t"), F.sum("d0").alias("all_d"))  # one row
    share = lambda n, of: F.coalesce(F.try_divide(F.col(n), of), F.lit(0.0)).alias(n)
    nodes = nodes.crossJoin(F.broadcast(totals)).select("host", share("t0", F.col("all_t")), share("d0", F.col("all_d")))
    by_host = F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")
    found = pages.drop("html").join(ranked(nodes, flows, damping), "host", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), "trust", "distrust")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judged(table(spark, sf_dir, "pages"))
