"""The published feed, documents, dataset and channel, and how values are shown, in small cases."""

import json
import xml.etree.ElementTree as ET
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import extraction, publishing
from tidemark.sources.storage import new_folder

CHANGE = "change_id long, source_id long, change_type string, json_path string, before string, after string, materiality int, observed_at timestamp_ntz, state string"


@pytest.fixture(scope="module")
def feed(spark):
    at = lambda d: datetime(2024, 1, d)
    changes = [
        (1, 1, "price_changed", "tiers.Pro.monthly_price_usd", "9", "1234.5", 90, at(1), "confirmed"), (2, 1, "tier_added", "tiers.A & B", "null", '{"name":"A & B"}', 100, at(3), "confirmed"),
        (3, 2, "features_changed", "tiers.Pro.headline_features", '["a","b"]', "[]", 50, at(2), "confirmed"), (4, 1, "price_changed", "tiers.X.monthly_price_usd", "1", "2", 80, at(4), "candidate"),
        (5, 1, "notes_changed", "notes", "null", '"x"', 5, at(5), "confirmed"), (6, 9, "price_changed", "tiers.X.monthly_price_usd", "1", "2", 80, at(6), "confirmed"),
    ]
    notes = [(1, "v1", "old", "old", "low"), (3, "v2", "it <means>", 'so "much"', "high"), (3, "v1", "old", "old", "low")]
    return publishing.change_feed(
        spark.createDataFrame(changes, CHANGE), spark.createDataFrame([(1, 10), (2, 20)], "source_id long, competitor_id long"), spark.createDataFrame([(10, "Ten", "ten"), (20, 'T "20"', "t20")], "competitor_id long, name string, slug string"),
        spark.createDataFrame(notes, "change_id long, prompt_version string, implication string, so_what string, confidence string"), "v2", 40,
    )


def test_the_version_belongs_to_the_join(spark, feed):
    rows = {r["change_id"]: json.loads(r["e"]) for r in feed.select("change_id", publishing.entry_json(feed).alias("e")).collect()}
    assert set(rows) == {1, 2, 3}  # not the candidate, the minor one, or that of an unknown source
    assert rows[1]["annotation"] is None and rows[1]["before"] == 9 and rows[1]["after"] == 1234.5
    assert rows[3]["annotation"] == {"implication": "it <means>", "so_what": 'so "much"', "confidence": "high"} and rows[3]["before"] == ["a", "b"]
    assert rows[2]["after"] == {"name": "A & B"} and rows[3]["competitor"] == 'T "20"' and rows[2]["observed_at"] == "2024-01-03T00:00:00Z"


def test_documents_nest_sources_and_changes(spark, feed):
    sources = spark.createDataFrame(
        [(10, "pricing", "u2", "ok", None, 3, None, None), (10, "docs", "u1", "degraded", datetime(2024, 1, 1), 1, 'HTTP "500"', '{"a":1}')],
        "competitor_id long, kind string, url string, state string, last_ok_at timestamp_ntz, distinct_states long, degraded_reason string, current string",
    )
    competitors = spark.createDataFrame([(10, "Ten", "ten", "h"), (20, 'T "20"', "t20", "h"), (30, "None", "n30", "h")], "competitor_id long, name string, slug string, homepage string")
    payloads = publishing.competitor_payloads(competitors, sources, feed, "now")
    found = {r["slug"]: json.loads(r["payload"]) for r in payloads.collect()}
    assert [s["kind"] for s in found["ten"]["sources"]] == ["docs", "pricing"] and found["ten"]["sources"][0]["current_pricing"] == {"a": 1} and found["ten"]["sources"][0]["degraded_reason"] == 'HTTP "500"'
    assert [c["materiality"] for c in found["ten"]["changes"]] == [100, 90] and found["t20"]["sources"] == [] and found["n30"]["changes"] == []
    folder = new_folder(spark, "test-payloads")
    publishing.write_payloads(payloads, folder)
    back = spark.read.schema("value string, slug string").text(folder, wholetext=True).collect()
    assert {r["slug"]: json.loads(r["value"]) for r in back} == found


def test_the_channel_is_xml(spark, feed):
    xml = publishing.rss_channel(feed, "T & T", "about", "https://s.example", "2024-01-31 00:00:00").first()["xml"]
    channel = ET.fromstring(xml).find("channel")
    assert channel.find("title").text == "T & T" and channel.find("lastBuildDate").text == "Wed, 31 Jan 2024 00:00:00 GMT"
    items = channel.findall("item")
    assert [i.find("title").text for i in items] == ["Ten A & B tier added", 'T "20" Pro features changed', "Ten Pro $9 → $1,234.5"]
    assert [i.find("description").text for i in items] == ["Ten A & B tier added".removeprefix("Ten "), 'it <means> — so "much"', "9 -> 1234.5"]
    assert items[0].find("link").text == "https://s.example/c/ten/" and items[2].find("guid").text == "ten|tiers.Pro.monthly_price_usd|2024-01-01T00:00:00Z"
    assert publishing.rss_channel(feed.where("1 = 0"), "T", "a", "s", "2024-01-31 00:00:00").first()["xml"].endswith("</lastBuildDate></channel></rss>")


def test_the_dataset_is_safe_csv(spark):
    row = [("=cmd|' /C calc'!A0", 'a,"b"', "2024", "2025", None, 9.5, "flat", 3.0, True, False, "USD", "live")]
    types = {"monthly_price_usd": "double", "annual_price_usd": "double", "included_seats": "double", "is_free": "boolean", "is_enterprise": "boolean"}
    line = publishing.csv_rows(spark.createDataFrame(row, ", ".join(f"{c} {types.get(c, 'string')}" for c in publishing.CSV_COLUMNS))).first()["line"]
    assert line == "'=cmd|' /C calc'!A0,\"a,\"\"b\"\"\",2024,2025,,9.5,flat,3,true,false,USD,live"


def test_values_are_shown_as_they_are(spark):
    cases = {"9.9996": "$10", "-1.5": "$-1.5", "1234.5": "$1,234.5", "0": "$0", "1234567": "$1,234,567", "0.0005": "$0.001", "19.990": "$19.99", "-1234.5678": "$-1,234.568"}
    shown = spark.createDataFrame([(c,) for c in cases], "c string").select("c", X.money(F.col("c")).alias("m")).collect()
    assert {r["c"]: r["m"] for r in shown} == cases
    values = {'"a\\n\\"b\\u00e9"': 'a\n"bé', "null": "none", "[1,null,\"x\"]": "1,,x", '{"a":1}': "[object Object]", "true": "true", '"open': "none", "[": "none", "7.5": "7.5"}
    shown = spark.createDataFrame([(c,) for c in values], "c string").select("c", X.plain_value(F.col("c")).alias("m")).collect()
    assert {r["c"]: r["m"] for r in shown} == values
    texts = ["plain", 'q"\\', "line\nend\ttab", "", "é漢", None]
    shown = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.json_text(F.col("t")).alias("j")).collect()
    assert all(json.loads(r["j"]) == r["t"] for r in shown)


def test_two_decimals_are_those_of_the_exact_value(spark):
    values = [1.005, 2.675, 0.125, 0.375, 1.115, 8.345, 19.99, 0.0, 1e6 + 0.005, 0.045, 12.5, -1.005, 4.35, 1.25, 0.615, 1234.565] + [k / 200 for k in range(1, 400, 2)]
    shown = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.two_decimals(F.col("v")).alias("t")).collect()
    for r in shown:
        exact = Decimal(abs(r["v"])).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert r["t"] == ("-" if r["v"] < 0 else "") + str(exact), r
    one = spark.range(1).select(extraction.number_appears(F.lit(1.005), F.lit("at $1.01 now")).alias("no"), extraction.number_appears(F.lit(1.005), F.lit("at $1.00 now")).alias("yes")).first()
    assert not one["no"] and one["yes"]


def test_names_and_spaces_of_any_kind(spark):
    rows = [("Pro\\E.*", "Pro\\E.* Free", True), ("Pro\\E.*", "Pro\\Exx Free", False), ("Pro", "Pro Free", True), ("Pro", "Pro ﻿- Free", True), ("Pro", "Pro and more Free", False)]
    df = spark.createDataFrame(rows, "name string, text string, ok boolean")
    assert all(r["f"] == r["ok"] for r in df.select("ok", extraction.free_appears(F.col("name"), F.col("text")).alias("f")).collect())
    assert spark.range(1).select(X.price_count(F.lit("$ 5 and € 7 and $ 9")).alias("n")).first()["n"] == 3
