"""Captures of pages in a web archive: what to ask its index for, what its answers hold, and the queue they go through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.expressions import PRICE, capture_instant

# The archive's host, the fields of its index and their filters, and how long a capture is tried.
HOST = "web.archive.org"
FIELDS = ("timestamp", "original", "statuscode", "digest")
INDEX_OPTIONS = (("output", "json"), ("collapse", "timestamp:6"), ("filter", "statuscode:200"))
MAX_ATTEMPTS = 3
MONTHS = 18

CAPTURES = "array<struct<timestamp:string,original:string,statuscode:string,digest:string>>"


def day_stamp(at: Column) -> Column:
    """YYYYMMDD."""
    return F.date_format(at, "yyyyMMdd")


def months_back(at: Column, months: int) -> Column:
    """The same day of an earlier month; days that the month lacks run into the next one."""
    day = at.cast("date")
    return F.date_add(F.trunc(F.add_months(F.trunc(day, "month"), -months), "month"), F.dayofmonth(day) - 1)


def index_url(target: Column, start: Column, end: Column) -> Column:
    """What to ask the index: one good capture a month, as rows of FIELDS."""
    pairs = [F.concat(F.lit("url="), F.url_encode(target))]
    pairs += [F.concat(F.lit(f"{name}="), F.url_encode(F.lit(value))) for name, value in INDEX_OPTIONS]
    pairs += [F.concat(F.lit("from="), start), F.concat(F.lit("to="), end), F.concat(F.lit("fl="), F.url_encode(F.lit(",".join(FIELDS))))]
    return F.concat(F.lit(f"https://{HOST}/cdx/search/cdx?"), F.concat_ws("&", *pairs))


def capture_url(stamp: Column, target: Column) -> Column:
    """The stored bytes of a capture, without what the archive puts into its pages."""
    return F.concat(F.lit(f"https://{HOST}/web/"), stamp, F.lit("id_/"), target)


def instant(stamp: Column) -> Column:
    """When a capture was taken: 14 digits that name a real time from the year 100 on; null otherwise."""
    return F.when(stamp >= "01", capture_instant(stamp))


def parsed_captures(body: Column) -> Column:
    """The captures of an index answer. Nothing raises: an answer that is no array of arrays has none, and rows that are short,
    hold other things than text, are not of status 200 or have an impossible stamp are left out, as is the header."""
    rows = F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")
    cells = F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda r: F.try_variant_get(r, "$", "array<variant>"))
    cells = F.filter(cells, lambda r: F.size(F.coalesce(r, F.array().cast("array<variant>"))) >= len(FIELDS))
    texts = F.filter(cells, lambda r: F.forall(F.slice(r, 1, len(FIELDS)), lambda c: F.schema_of_variant(c) == "STRING"))
    found = F.transform(texts, lambda r: F.struct(*[F.try_variant_get(r[i], "$", "string").alias(n) for i, n in enumerate(FIELDS)]))
    good = F.filter(found, lambda c: (c["statuscode"] == "200") & instant(c["timestamp"]).isNotNull())
    return F.coalesce(good, F.array().cast(CAPTURES))


def monthly(captures: DataFrame) -> DataFrame:
    """The first capture of each source and month, for answers that were not collapsed."""
    month = F.substring("timestamp", 1, 6)
    return captures.groupBy("source_id", month.alias("month")).agg(F.min(F.struct("timestamp", *[c for c in captures.columns if c not in ("source_id", "timestamp")])).alias("c")).select("source_id", "c.*")


def discovered(answers: DataFrame) -> DataFrame:
    """source_id, url and each capture of the answers (source_id, url, body; a body that is null could not be had)."""
    return answers.select("source_id", "url", F.explode(parsed_captures(F.col("body"))).alias("c")).select("source_id", "url", "c.*")


def enqueued(captures: DataFrame, queue: DataFrame) -> DataFrame:
    """The rows that the queue lacks: source_id, wayback_ts, target_url, state, attempts. Running it again adds none."""
    rows = captures.groupBy("source_id", F.col("timestamp").alias("wayback_ts")).agg(F.min("url").alias("url"))
    rows = rows.join(queue.select("source_id", "wayback_ts"), ["source_id", "wayback_ts"], "left_anti")
    return rows.select("source_id", "wayback_ts", capture_url(F.col("wayback_ts"), F.col("url")).alias("target_url"), F.lit("pending").alias("state"), F.lit(0).alias("attempts"))


def discovery_summary(answers: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: sources asked, failed answers, captures found, how many of them are new to the queue, and how many it has."""
    asked = answers.agg(F.count("*").alias("sources"), F.count_if(F.col("body").isNull()).alias("failed"), F.coalesce(F.sum(F.size(parsed_captures(F.col("body")))), F.lit(0)).alias("found"))
    added = enqueued(discovered(answers), queue).agg(F.count("*").alias("enqueued"))
    return asked.join(added).select("sources", "failed", "found", "enqueued", (F.col("found") - F.col("enqueued")).alias("duplicate"))  # one row each


def replayed(queue: DataFrame, ledger: DataFrame) -> DataFrame:
    """The queue (item, wayback_ts) after a ledger of attempts (item, at, fetched, body, error): item, wayback_ts, state, attempts, last_error.

    An attempt at an item that is no longer pending is void. Only fetches that fail count as attempts, and the third one ends the
    item; a fetched page without a price is skipped, one with a price is stored. A stamp that names no time is skipped at
    its first attempt, without a fetch.
    """
    order = W.partitionBy("item").orderBy("at")
    failed = ~F.col("fetched")
    priced = F.coalesce(F.col("body"), F.lit("")).rlike(PRICE)
    rows = ledger.select("item", "at", failed.alias("failed"), priced.alias("priced"), "error")
    rows = rows.withColumn("failures", F.count_if("failed").over(order.rowsBetween(W.unboundedPreceding, 0)))
    ends = F.when(~F.col("failed") | (F.col("failures") >= MAX_ATTEMPTS), F.struct("at", "failed", "priced", "failures", "error"))
    last = F.max(F.struct("at", "failures", "error"))
    seen = rows.groupBy("item").agg(F.min(ends).alias("end"), last.alias("last"))
    bad = instant(F.col("wayback_ts")).isNull() & F.col("last").isNotNull()
    state = F.when(bad, "skipped").when(F.col("end").isNull(), "pending").when(F.col("end.failed"), "failed").when(F.col("end.priced"), "fetched").otherwise("skipped")
    tries = F.when(bad, 0).otherwise(F.coalesce("end.failures", "last.failures", F.lit(0)))
    error = (
        F.when(bad, F.concat(F.lit('unparseable wayback timestamp "'), "wayback_ts", F.lit('"'))).when(F.col("end").isNull(), F.col("last.error"))
        .when(F.col("end.failed"), F.col("end.error")).when(~F.col("end.priced"), "no price-like text in the capture")
    )
    return queue.select("item", "wayback_ts").join(seen, "item", "left").select("item", "wayback_ts", state.alias("state"), tries.cast("int").alias("attempts"), error.alias("last_error"))


def next_slice(queue: DataFrame, limit: int = 0) -> DataFrame:
    """The pending items that may be tried, the oldest captures first; 0 is no limit."""
    rows = queue.where((F.col("state") == "pending") & (F.col("attempts") < MAX_ATTEMPTS)).orderBy("wayback_ts", "item")
    return rows.limit(limit) if limit else rows
