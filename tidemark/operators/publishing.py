"""What is published: the feed of changes with its joins, one document a competitor, the dataset as CSV, the RSS channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import change_label, csv_field, escape_xml, json_text, number_text, plain_value
from tidemark.sources.storage import small, written

# The columns of the dataset, and how many changes the feed and the channel show.
CSV_COLUMNS = (
    "competitor", "tier", "first_observed_at", "last_observed_at", "monthly_price_usd", "annual_price_usd", "billing_unit",
    "included_seats", "is_free", "is_enterprise", "currency", "provenance",
)
FEED_ROWS, CHANNEL_ROWS = 200, 50
ISO, MAIL_DATE = "yyyy-MM-dd'T'HH:mm:ss'Z'", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"


def change_feed(changes: DataFrame, sources: DataFrame, competitors: DataFrame, analyses: DataFrame, version: str, threshold: int, limit: int = FEED_ROWS) -> DataFrame:
    """The latest confirmed changes of weight, with their competitor and, if this version of the prompt wrote one, their annotation.

    ``changes``: change_id, source_id, change_type, json_path, before, after, materiality, observed_at, state; ``sources``: source_id,
    competitor_id; ``competitors``: competitor_id, name, slug; ``analyses``: change_id, prompt_version, implication, so_what,
    confidence. The version belongs to the join: a change that only another version has annotated stays, without.
    """
    shown = changes.where((F.col("state") == "confirmed") & (F.col("materiality") >= threshold)).drop("state")
    of = sources.join(competitors, "competitor_id").select("source_id", F.col("name").alias("competitor"), "slug")
    latest = shown.join(small(written(of, "feed-sources")), "source_id").orderBy(F.desc("observed_at"), F.desc("change_id")).limit(limit)
    notes = analyses.where(F.col("prompt_version") == version).drop("prompt_version")
    return notes.join(F.broadcast(latest), "change_id", "right")  # ``limit`` rows


def _object(**parts: Column) -> Column:
    """A JSON object of parts that are JSON already."""
    pairs = [F.concat(F.lit(f'{"," if i else ""}"{name}":'), part) for i, (name, part) in enumerate(parts.items())]
    return F.concat(F.lit("{"), *pairs, F.lit("}"))


def iso(at: Column) -> Column:
    return json_text(F.date_format(at, ISO))


def entry_json(row) -> Column:
    """A change as the published feed has it; before and after are values, not text."""
    note = _object(implication=json_text(row["implication"]), so_what=json_text(row["so_what"]), confidence=json_text(row["confidence"]))
    return _object(
        competitor=json_text(row["competitor"]), slug=json_text(row["slug"]), change_type=json_text(row["change_type"]), json_path=json_text(row["json_path"]),
        before=F.coalesce(row["before"], F.lit("null")), after=F.coalesce(row["after"], F.lit("null")), materiality=row["materiality"].cast("string"),
        observed_at=iso(row["observed_at"]), annotation=F.when(row["implication"].isNull(), "null").otherwise(note),
    )


def competitor_payloads(competitors: DataFrame, sources: DataFrame, feed: DataFrame, generated_at: str) -> DataFrame:
    """slug and payload: each competitor's sources, by kind, and its part of the feed, newest first, as one JSON document.

    ``sources``: competitor_id, kind, url, state, last_ok_at, distinct_states, degraded_reason, current (JSON or null).
    """
    one = _object(
        kind=json_text(F.col("kind")), url=json_text(F.col("url")), state=json_text(F.col("state")), last_ok_at=iso(F.col("last_ok_at")),
        distinct_states=F.col("distinct_states").cast("string"), degraded_reason=json_text(F.col("degraded_reason")), current_pricing=F.coalesce("current", F.lit("null")),
    )
    inner = lambda rows: F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["json"]), ","), F.lit("]"))
    board = sources.groupBy("competitor_id").agg(F.array_sort(F.collect_list(F.struct("kind", "url", one.alias("json")))).alias("s"))  # a document's own rows
    entries = feed.select("slug", F.struct((-F.unix_micros(F.col("observed_at").cast("timestamp"))).alias("newest"), (-F.col("change_id")).alias("last"), entry_json(feed).alias("json")).alias("e"))
    changes = entries.groupBy("slug").agg(F.array_sort(F.collect_list("e")).alias("c"))
    rows = competitors.join(board, "competitor_id", "left").join(changes, "slug", "left")
    empty = F.lit("[]")
    payload = _object(
        generated_at=json_text(F.lit(generated_at)), slug=json_text(F.col("slug")), name=json_text(F.col("name")), homepage=json_text(F.col("homepage")),
        sources=F.when(F.col("s").isNull(), empty).otherwise(inner(F.col("s"))), changes=F.when(F.col("c").isNull(), empty).otherwise(inner(F.col("c"))),
    )
    return rows.select("slug", payload.alias("payload"))


def write_payloads(payloads: DataFrame, folder: str) -> None:
    """One text file of JSON for each slug."""
    payloads.repartition("slug").select("slug", F.col("payload").alias("value")).write.mode("overwrite").partitionBy("slug").text(folder)


def csv_rows(rows: DataFrame) -> DataFrame:
    """Adds ``line``: the row of CSV_COLUMNS as CSV. Unknown prices and seats are empty, never 0."""
    flag = lambda c: F.when(F.col(c), "true").otherwise("false")
    number = lambda c: csv_field(number_text(F.col(c)))
    special = {"monthly_price_usd": number, "annual_price_usd": number, "included_seats": number, "is_free": flag, "is_enterprise": flag}
    plain = {"first_observed_at", "last_observed_at", "currency", "provenance"}
    fields = [special[c](c) if c in special else F.col(c) if c in plain else csv_field(F.col(c)) for c in CSV_COLUMNS]
    return rows.withColumn("line", F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields]))


def rss_channel(feed: DataFrame, title: str, about: str, site: str, generated_at: str) -> DataFrame:
    """One row, ``xml``: the channel with its newest items."""
    rows = feed.where("observed_at is not null").orderBy(F.desc("observed_at"), F.desc("change_id")).limit(CHANNEL_ROWS)
    label = change_label(F.col("change_type"), F.col("json_path"), F.col("before"), F.col("after"))
    whole = F.col("before").startswith("{") | F.col("after").startswith("{")
    noted = F.concat("implication", F.lit(" — "), "so_what")
    described = F.when(F.col("implication").isNotNull(), noted).when(whole, label).otherwise(F.concat(plain_value(F.col("before")), F.lit(" -> "), plain_value(F.col("after"))))
    at = lambda pattern: F.date_format("observed_at", pattern)
    parts = {
        "title": escape_xml(F.concat("competitor", F.lit(" "), label)), "link": escape_xml(F.concat(F.lit(f"{site}/c/"), "slug", F.lit("/"))), "description": escape_xml(described),
        'guid isPermaLink="false"': F.concat_ws("|", escape_xml(F.col("slug")), escape_xml(F.col("json_path")), at(ISO)), "pubDate": at(MAIL_DATE),
    }
    item = F.concat(F.lit("<item>"), *[F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag.split()[0]}>")) for tag, text in parts.items()], F.lit("</item>"))
    items = rows.select("observed_at", "change_id", item.alias("item")).agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("observed_at").cast("timestamp"))).alias("newest"), (-F.col("change_id")).alias("last"), "item"))).alias("i"))  # CHANNEL_ROWS
    built = F.date_format(F.lit(generated_at).cast("timestamp_ntz"), MAIL_DATE)
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>'), escape_xml(F.lit(title)), F.lit("</title><link>"), escape_xml(F.lit(site)),
        F.lit("</link><description>"), escape_xml(F.lit(about)), F.lit("</description><lastBuildDate>"), built, F.lit("</lastBuildDate>"),
    )
    return items.select(F.concat(head, F.array_join(F.transform("i", lambda r: r["item"]), ""), F.lit("</channel></rss>")).alias("xml"))
