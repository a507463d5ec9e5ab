"""When a digest of changes is due, what is asked for it, and how changes are marked on a chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Changes of a digest and before a Monday suffices, days after which fewer do, earlier digests that are shown and how much of each, backups that are kept.
DIGEST_CHANGES, ENOUGH, STALE_DAYS, PRIOR_DIGESTS, PRIOR_CHARS, BACKUPS = 20, 3, 30, 4, 2000, 7
#: The end of a price label.
SPAN = r"\$([0-9,]+(?:\.[0-9]+)?)\s*→\s*\$([0-9,]+(?:\.[0-9]+)?)$"
DAY_US = 86_400_000_000


def trigger(pending: Column, now: Column, last_digest: Column, force: Column) -> Column:
    """never (nothing is pending), fire or hold: forced; or on a Monday in Chicago with enough changes, or with few and no digest for long.
    ``now`` and ``last_digest`` are times in UTC."""
    monday = F.date_format(F.from_utc_timestamp(now.cast("timestamp"), "America/Chicago"), "E") == "Mon"
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_digest.cast("timestamp"))
    stale = last_digest.isNull() | (age > STALE_DAYS * DAY_US)
    return F.when(pending == 0, "never").when(force, "fire").when(monday & ((pending >= ENOUGH) | stale), "fire").otherwise("hold")


def digest_request(pending: DataFrame, digests: DataFrame) -> DataFrame:
    """One row, ``prompt``: the oldest pending changes by index, and the newest earlier digests.

    ``pending``: change_id, competitor, observed_at, change_type, json_path, before, after; ``digests``: created_at, body.
    """
    oldest = pending.orderBy("observed_at", "change_id").limit(DIGEST_CHANGES)
    index = F.row_number().over(W.orderBy("observed_at", "change_id")) - 1  # DIGEST_CHANGES rows
    none = lambda c: F.coalesce(c, F.lit("none"))
    line = F.concat(
        F.lit("["), index.cast("string"), F.lit("] "), "competitor", F.lit(" "), F.date_format("observed_at", "yyyy-MM-dd"), F.lit(" "), "change_type", F.lit(" "), "json_path",
        F.lit(": "), none(F.col("before")), F.lit(" -> "), none(F.col("after")),
    )
    lines = oldest.select(index.alias("i"), line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    newest = digests.orderBy(F.desc("created_at")).limit(PRIOR_DIGESTS)
    nth = F.row_number().over(W.orderBy(F.desc("created_at")))  # PRIOR_DIGESTS rows
    shown = F.concat(F.lit("--- digest "), nth.cast("string"), F.lit(" ---\n"), F.substring("body", 1, PRIOR_CHARS))
    priors = newest.select(nth.alias("n"), shown.alias("body")).agg(F.array_sort(F.collect_list(F.struct("n", "body"))).alias("d"))
    texts = lambda rows, name: F.transform(rows, lambda r: r[name])
    heading = F.when(F.size("d") > 0, "Prior digests, newest first:").otherwise("No prior digests.")
    parts = F.concat(F.array(F.lit("Confirmed changes (reference by index):")), texts("l", "line"), F.array(F.lit(""), heading), texts("d", "body"))
    return lines.join(priors).select(F.array_join(parts, "\n").alias("prompt"))  # one row each


def due(sources: DataFrame, fetches: DataFrame, now: Column) -> DataFrame:
    """The active sources (source_id, cadence_hours, active) without a fetch (source_id, fetched_at) within their own cadence, to the second."""
    last = fetches.groupBy("source_id").agg(F.max(F.date_trunc("second", "fetched_at")).alias("last"))
    rows = sources.where("active").join(last, "source_id", "left")
    waited = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))
    return rows.where(F.col("last").isNull() | (waited >= F.col("cadence_hours") * 3600)).select("source_id", "last")


def state_of(checked: Column, latest_ok: Column, degraded: Column) -> Column:
    """pending (never checked), failing, degraded or ok, in this order."""
    return F.when(checked.isNull(), "pending").when(~F.coalesce(latest_ok, F.lit(False)), "failing").when(degraded.isNotNull(), "degraded").otherwise("ok")


def inside_plot(markers: DataFrame, points: DataFrame) -> DataFrame:
    """The markers (source_id, at) within the times that are plotted of their source, both ends included; a source without points has none."""
    plotted = points.groupBy("source_id").agg(F.min("at").alias("_from"), F.max("at").alias("_to"))
    return markers.join(plotted, "source_id").where(F.col("at").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def direction(label: Column) -> Column:
    """rise or fall of a label that ends with two prices, flat otherwise."""
    price = lambda i: F.replace(F.regexp_extract(label, SPAN, i), F.lit(","), F.lit("")).try_cast("double")
    return F.when(price(2) > price(1), "rise").when(price(2) < price(1), "fall").otherwise("flat")


def day_marks(markers: DataFrame) -> DataFrame:
    """source_id, day, marks, direction: the markers of one day are one event, whose direction is the common one, or flat."""
    found = markers.select("source_id", F.date_format("at", "yyyy-MM-dd").alias("day"), direction(F.col("label")).alias("d"))
    days = found.groupBy("source_id", "day").agg(F.count("*").alias("marks"), F.min("d").alias("low"), F.max("d").alias("high"))
    return days.select("source_id", "day", "marks", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("flat").alias("direction"))


def number_of(cell: Column) -> Column:
    """The number that a JSON cell is; null for text, other values and what is no JSON."""
    v = F.try_parse_json(cell)
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(v, "$", "double"))


def first_line(error: Column, chars: int = 300) -> Column:
    return F.substring(F.substring_index(error, "\n", 1), 1, chars)


def retired(backups: DataFrame, keep: int = BACKUPS) -> DataFrame:
    """The backups (name) that go: all but the last ``keep`` names."""
    kept = backups.select("name").distinct().orderBy(F.desc("name")).limit(keep)
    return backups.join(F.broadcast(kept), "name", "left_anti")  # ``keep`` rows
