"""Captures and their queue, addresses, stored documents, merges and published versions."""

import ipaddress
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import addresses, documents
from tidemark.operators import merging
from tidemark.sources import captures
from tidemark.sources.storage import new_folder

ROW = ["20250116002909", "https://example.org/", "200", "D1"]


def found(spark, body):
    return [tuple(c) for c in spark.createDataFrame([(body,)], "body string").select(captures.parsed_captures(F.col("body")).alias("c")).first()["c"]]


@pytest.mark.parametrize(
    ("body", "n"),
    [
        (json.dumps([captures.FIELDS, ROW, ROW[:3], "text", None, 7, {"a": 1}, [*ROW, "more"]]), 2), ("", 0), ("  ", 0), ("<html>busy</html>", 0), ("{}", 0), ("[]", 0), ("[[]]", 0), ('["header"]', 0), (None, 0),
        (json.dumps([captures.FIELDS]), 0), (json.dumps([captures.FIELDS, [20250116002909, *ROW[1:]], [ROW[0], None, *ROW[2:]], [*ROW[:2], 200, "D"], [*ROW[:3], ["D"]]]), 0),
        (json.dumps([captures.FIELDS, ["20250132000000", *ROW[1:]], ["20250230000000", *ROW[1:]], ["20250101240000", *ROW[1:]], ["2025", *ROW[1:]], ["00500101000000", *ROW[1:]], [*ROW[:2], "404", "D"]]), 0),
        (json.dumps([captures.FIELDS, ["20240229235959", *ROW[1:]]]), 1),
    ],
)
def test_index_answers_never_raise(spark, body, n):
    rows = found(spark, body)
    assert len(rows) == n and all(len(r) == 4 for r in rows)


def test_requests_and_urls(spark):
    row = spark.sql("select timestamp_ntz'2025-03-31 10:00:00' as now").select(
        captures.day_stamp(captures.months_back(F.col("now"), 1)).alias("over"), captures.day_stamp(captures.months_back(F.col("now"), 18)).alias("far"),
        captures.index_url(F.lit("https://a.b/c d?x=1&y"), F.lit("20240101"), F.lit("20250101")).alias("url"), captures.capture_url(F.lit("20240101000000"), F.lit("https://a.b/")).alias("capture"),
    ).first()
    assert row["over"] == "20250303" and row["far"] == "20231001"  # 31 February and 31 September run over
    assert row["url"] == "https://web.archive.org/cdx/search/cdx?url=https%3A%2F%2Fa.b%2Fc+d%3Fx%3D1%26y&output=json&collapse=timestamp%3A6&filter=statuscode%3A200&from=20240101&to=20250101&fl=timestamp%2Coriginal%2Cstatuscode%2Cdigest"
    assert row["capture"] == "https://web.archive.org/web/20240101000000id_/https://a.b/"


def test_discovery_is_idempotent(spark):
    answers = spark.createDataFrame([(1, "u1", json.dumps([captures.FIELDS, ROW, ROW, ["20250216002909", *ROW[1:]]])), (2, "u2", None), (3, "u3", "")], "source_id long, url string, body string")
    empty = spark.createDataFrame([], "source_id long, wayback_ts string")
    added = captures.enqueued(captures.discovered(answers), empty)
    assert sorted((r["source_id"], r["wayback_ts"]) for r in added.collect()) == [(1, "20250116002909"), (1, "20250216002909")]
    assert captures.enqueued(captures.discovered(answers), added).count() == 0
    assert captures.discovery_summary(answers, empty).first().asDict() == {"sources": 3, "failed": 1, "found": 3, "enqueued": 2, "duplicate": 1}
    assert captures.discovery_summary(answers, added).first()["enqueued"] == 0
    per_month = captures.monthly(captures.discovered(answers).unionByName(captures.discovered(answers).withColumn("timestamp", F.lit("20250101000000"))))
    assert sorted(r["timestamp"] for r in per_month.collect()) == ["20250101000000", "20250216002909"]


def test_queue_states(spark):
    queue = [("new", "20250101000000"), ("bad", "20250230000000"), ("untried", "20250230000000"), ("third", "20250102000000"), ("late", "20250103000000"), ("twice", "20250104000000"), ("wall", "20250105000000")]
    fail = lambda item, at: (item, at, False, None, f"HTTP {500 + at}")
    ledger = [("bad", 1, True, "$ 9", None), fail("third", 1), fail("third", 2), fail("third", 3), ("third", 4, True, "$ 9", None), fail("late", 1), fail("late", 2), ("late", 3, True, "from $9", None), fail("late", 4), fail("twice", 2), fail("twice", 1), ("wall", 1, True, "consent", None)]
    rows = captures.replayed(spark.createDataFrame(queue, "item string, wayback_ts string"), spark.createDataFrame(ledger, "item string, at long, fetched boolean, body string, error string"))
    assert {r["item"]: (r["state"], r["attempts"], r["last_error"]) for r in rows.collect()} == {
        "new": ("pending", 0, None), "bad": ("skipped", 0, 'unparseable wayback timestamp "20250230000000"'), "untried": ("pending", 0, None), "third": ("failed", 3, "HTTP 503"),
        "late": ("fetched", 2, None), "twice": ("pending", 2, "HTTP 502"), "wall": ("skipped", 0, "no price-like text in the capture"),
    }
    assert [r["item"] for r in captures.next_slice(rows).collect()] == ["new", "twice", "untried"]
    assert [r["item"] for r in captures.next_slice(rows, 1).collect()] == ["new"]


def test_addresses_of_both_families(spark):
    good = ["1.2.3.4", "::1", "::", "fe80::1", "[2001:db8::8:800:200c:417a]", "::ffff:127.0.0.1", "::FFFF:7f00:1", "1:2:3:4:5:6:7:8", "1::8", "64:ff9b::192.0.2.33"]
    bad = ["1:2:3", "1::2::3", "12345::", "256.1.1.1", "1.2.3", "g::1", ":::", "1:2:3:4:5:6:7:8:9", "::1.2.3.400", "", "host.example"]
    rows = {r["h"]: r for r in spark.createDataFrame([(h,) for h in good + bad], "h string").select("h", addresses.address_hex(F.col("h")).alias("x"), addresses.blocked_host(F.col("h")).alias("b")).collect()}
    for h in good:
        a = ipaddress.ip_address(h.strip("[]"))
        assert int(rows[h]["x"], 16) == (int(a) if a.version == 6 else 0xFFFF << 32 | int(a)), h
    assert all(rows[h]["x"] is None for h in bad)
    assert [rows[h]["b"] for h in ("::1", "::ffff:127.0.0.1", "::FFFF:7f00:1", "fe80::1", "1::2::3", "256.1.1.1", "host.example", "1.2.3.4", "1::8")] == [True] * 6 + [False] * 3


SOUND = {"currency": "USD", "tiers": [], "usage_rates": [], "notes": None, "extraction_confidence": "high"}


def violations(spark, *texts):
    return [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(documents.schema_violations(F.col("t")).alias("v")).collect()]


def test_documents_are_judged_path_by_path(spark):
    rate = {"metric": "m", "unit_price_usd": 1.5}
    cases = [SOUND, SOUND | {"more": 1}, SOUND | {"usage_rates": [rate] * 100}, SOUND | {"usage_rates": [rate] * 101}, SOUND | {"tiers": {}}, SOUND | {"tiers": [3, {}]}, SOUND | {"notes": 1, "currency": None}, []]
    found = violations(spark, *map(json.dumps, cases), "{", None)
    assert found[:3] == [[], [], []] and found[3] == ["usage_rates: more than 100 items"] and found[4] == ["tiers: expected array, got object"]
    assert found[5][0] == "tiers[0]: expected object, got number" and len(found[5]) == 9 and all(v.startswith("tiers[1].") for v in found[5][1:])
    assert found[6] == ["currency: expected string, got null", "notes: expected string or null, got number"]
    assert found[7:] == [["expected object, got array"], ["not JSON"], ["not JSON"]]


TABLE = "key string, name string, cadence int, degraded string"


def test_merges(spark):
    stored = spark.createDataFrame([("a", "A", 24, "down"), ("b", "B", 24, None), (None, "N", 1, "x")], TABLE)
    config = merging.last_of_key(spark.createDataFrame([("a", "A1", 6, 1), ("a", "A2", 12, 2), ("c", "C", 6, 1)], "key string, name string, cadence int, nth int"), ["key"], "nth").drop("nth")
    once = merging.upserted(stored, config, ["key"], ["name", "cadence"], {"degraded": F.lit("new")})
    twice = merging.upserted(once, config, ["key"], ["name", "cadence"], {"degraded": F.lit("new")})
    expected = {("a", "A2", 12, "down"), ("b", "B", 24, None), (None, "N", 1, "x"), ("c", "C", 6, "new")}
    assert set(map(tuple, once.collect())) == set(map(tuple, twice.collect())) == expected
    rows = spark.createDataFrame([("a", "Z", 1, None), ("d", "D2", 2, None), ("d", "D1", 1, None)], TABLE)
    assert {(r["key"], r["name"]) for r in merging.inserted(stored.where("key is not null"), rows, ["key"], "cadence").collect()} == {("a", "A"), ("b", "B"), ("d", "D1")}
    with pytest.raises(ValueError, match="there already"):
        merging.inserted_strictly(stored, rows.where("key = 'a'"), ["key"])
    with pytest.raises(ValueError, match="there already"):
        merging.inserted_strictly(stored, rows.where("key = 'd'"), ["key"])
    assert merging.inserted_strictly(stored, rows.where("name = 'D1'"), ["key"]).count() == 4
    cleared = merging.amended(stored, spark.createDataFrame([("a", None), ("zz", "y")], "key string, degraded string"), ["key"], ["degraded"])
    assert {(r["key"], r["degraded"]) for r in cleared.collect()} == {("a", None), ("b", None), (None, "x")}


def test_versions_are_swapped_by_the_manifest(spark):
    folder = new_folder(spark, "test-versions")
    assert merging.current(spark, folder) is None
    merging.published(spark.range(3), folder)
    reader = merging.current(spark, folder)
    merging.published(reader.withColumn("id", F.col("id") + 10), folder)  # reads the version that it replaces
    assert sorted(r["id"] for r in merging.current(spark, folder).collect()) == [10, 11, 12] and reader.count() == 3


@given(st.lists(st.tuples(st.booleans(), st.sampled_from(["$ 9", "no"])), max_size=6))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_replay_matches_a_loop(spark, tries):
    state, attempts = "pending", 0
    for fetched, body in tries:
        if state == "pending" and not fetched:
            attempts += 1
            state = "failed" if attempts >= 3 else "pending"
        elif state == "pending":
            state = "fetched" if "$" in body else "skipped"
    ledger = spark.createDataFrame([("i", n, f, b, "e") for n, (f, b) in enumerate(tries)], "item string, at long, fetched boolean, body string, error string")
    row = captures.replayed(spark.createDataFrame([("i", "20250101000000")], "item string, wayback_ts string"), ledger).first()
    assert (row["state"], row["attempts"]) == (state, attempts)
