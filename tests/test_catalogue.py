"""Every registered archive query against its SQL in DuckDB, and small cases of the operators."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tidemark.functions import expressions as X
from tidemark.operators import changes, match, observe
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.sql(f"create view {file.stem} as select * from '{file}'")
    return connection


def texts(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, tables, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    sql = catalogue.ORACLES[name]
    assert sorted(tables.sql(sql).columns) == columns
    assert texts(found.select(*columns).collect()) == texts(tables.sql(f"select {', '.join(columns)} from ({sql})").fetchall())


def test_entry_points(spark):
    assert catalogue.FLAGSHIP in entry_point.queries() and set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_a_b_a_is_three_runs_and_invalid_rows_are_transparent(spark):
    rows = [(1, i, f"2024-01-0{i + 1}", s, s, "live", "high") for i, s in enumerate("AABA")]
    valid = spark.createDataFrame(rows, "source_id long, id long, observed_at string, page_state string, normalized_hash string, provenance string, confidence string")
    runs = observe.observation_runs(valid).orderBy("run").collect()
    assert [(r["page_state"], r["first_id"], r["rows"]) for r in runs] == [("A", 0, 2), ("B", 2, 1), ("A", 3, 1)]
    assert [r["next_state"] for r in runs] == ["A", "A", None]


def test_scores(spark):
    rows = [(20.0, 21.0), (20.0, 40.0), (None, 20.0), (0.0, 5.0)]
    df = spark.createDataFrame(rows, "b double, a double")
    text = F.lit("1")
    found = df.select(X.materiality(F.lit("price_changed"), F.col("b"), F.col("a"), text, text).alias("m")).collect()
    assert [r["m"] for r in found] == [85, 100, 35, 80]


RATE = "pair_id int, ord int, metric string, unit_price double"


def rates(spark, before, after):
    sides = [spark.createDataFrame([(1, i, m, p) for i, (m, p) in enumerate(side)], RATE) for side in (before, after)]
    rows = match.match_rates(*sides).collect()
    return sorted((r["how"], r["before"]["metric"] if r["before"] else "", r["after"]["metric"] if r["after"] else "") for r in rows)


def test_reworded_rates_meet(spark):
    names = ["AI credits overage (Enterprise tier)", "Additional Mocks (per 1000 calls)", "Advanced MFA - Phone (Pro Plan)"]
    others = ["AI credits overages (Enterprise)", "Additional Mocks per 1000 calls", "Advanced MFA - Phone - Pro plan"]
    for a, b in zip(names, others, strict=True):
        assert rates(spark, [(a, 1.0)], [(b, 1.0)]) == [("normalized", a, b)]


def test_rates_that_stay_apart(spark):
    assert rates(spark, [("Storage (first project)", 1.0)], [("Storage (additional projects)", 2.0)])[0][0] == "added"
    assert rates(spark, [("Price for storage", 1.0)], [("Price storage", 1.0)])[0][0] == "added"  # for is no filler
    # A normalized metric that is there twice on one side is ambiguous.
    assert [h for h, _, _ in rates(spark, [("API calls", 1.0), ("API call (billed monthly)", 2.0)], [("API call", 1.0)])] == ["added", "removed", "removed"]


def test_equal_rates_are_consumed_once(spark):
    assert [h for h, _, _ in rates(spark, [("Egress", 1.0), ("Egress", 2.0)], [("Egress", 1.0)])] == ["exact", "removed"]
    assert [h for h, _, _ in rates(spark, [("Egress", 1.0)], [("Egress", 1.0), ("Egress", 2.0)])] == ["added", "exact"]


TIER = "pair_id int, ord int, name string, monthly double, annual double, billing_unit string, seats double, is_free boolean, is_enterprise boolean, features string"


def tier(name, monthly, annual=None, unit="flat", seats=None, free=False, enterprise=False, features="[]"):
    return name, monthly, annual, unit, seats, free, enterprise, features


def events(spark, before, after):
    sides = [spark.createDataFrame([(1, i, *t) for i, t in enumerate(side)], TIER) for side in (before, after)]
    found = changes.first_emissions(changes.tier_changes(match.match_tiers(*sides, changes.FIELDS)))
    return sorted(tuple(r) for r in changes.scored(found).select("change_type", "json_path", "before", "after", "materiality").collect())


def test_typed_changes(spark):
    assert events(spark, [tier("Pro", 20.0)], [tier("Pro", 24.0)]) == [("price_changed", "tiers.Pro.monthly_price_usd", "20", "24", 100)]
    assert events(spark, [tier("Pro", None)], [tier("Pro", 0.0)]) == [("price_changed", "tiers.Pro.monthly_price_usd", "null", "0", 35)]
    assert events(spark, [tier("Pro", 20.0, 192.0)], [tier("Pro", 20.0, 180.0)]) == [("price_changed", "tiers.Pro.annual_price_usd", "192", "180", 86)]
    assert events(spark, [tier("Pro", 1.0, unit="flat")], [tier("Pro", 1.0, unit="unknown")]) == [("billing_unit_changed", "tiers.Pro.billing_unit", '"flat"', '"unknown"', 35)]
    assert events(spark, [tier("Pro", 1.0)], [tier("Pro", 1.0, features='["x"]')]) == [("features_changed", "tiers.Pro.headline_features", "[]", '["x"]', 10)]
    flags = events(spark, [tier("Pro", 1.0)], [tier("Pro", 1.0, enterprise=True)])
    assert flags == [("flag_changed", "tiers.Pro.flags", '{"is_free":false,"is_enterprise":false}', '{"is_free":false,"is_enterprise":true}', 60)]


def test_only_positional_matches_are_renames(spark):
    assert events(spark, [tier("Pro", 20.0)], [tier("Pro Plan", 20.0)]) == []
    assert events(spark, [tier("Team", 20.0)], [tier("Business", 21.0)])[-1] == ("tier_renamed", "tiers.Business", '"Team"', '"Business"', 35)
    kinds = [e[0] for e in events(spark, [tier("Team", 20.0)], [tier("Business", 40.0)])]
    assert kinds == ["tier_added", "tier_removed"]
    added = events(spark, [], [tier("Solo", 9.5, seats=1.0)])
    assert added[0][3] == '{"name":"Solo","monthly_price_usd":9.5,"annual_price_usd":null,"billing_unit":"flat","included_seats":1,"is_free":false,"is_enterprise":false,"headline_features":[]}'


def test_first_emission_of_a_path_wins(spark):
    found = events(spark, [tier("Addon", 5.0), tier("Addon", 20.0)], [tier("Addon", 6.0), tier("Addon", 30.0)])
    assert found == [("price_changed", "tiers.Addon.monthly_price_usd", "5", "6", 100)]


def test_confirmation(spark):
    rows = [
        ("A, B, B", "price_changed", "1", "2", "2", True, False, 85), ("A, B, C", "price_changed", "1", "2", "3", True, False, 85), ("A, B, A", "price_changed", "1", "2", "1", True, False, 85),
        ("no next look", "price_changed", "1", "2", None, False, False, 85), ("low next", "price_changed", "1", "2", "2", True, True, 85), ("small", "notes_changed", "1", "2", "2", True, False, 5),
        ("came and stayed, other features", "tier_added", "null", '{"a":1}', '{"a":2}', True, False, 100), ("came and went", "tier_added", "null", '{"a":1}', None, True, False, 100),
        ("went and stays away", "tier_removed", '{"a":1}', "null", None, True, False, 100), ("went and came back", "tier_removed", '{"a":1}', "null", '{"a":1}', True, False, 100),
    ]
    df = spark.createDataFrame(rows, "case string, change_type string, before string, after string, next_value string, next_seen boolean, low boolean, materiality int")
    states = [r["state"] for r in changes.confirmed(df).collect()]
    assert states == ["confirmed", "disputed", "retracted", "candidate", "candidate", "candidate", "confirmed", "retracted", "confirmed", "retracted"]


@pytest.mark.parametrize(
    ("name", "column", "values"),
    [
        ("change_events_all", "change_type", set(X.POINTS)),
        ("confirm_states", "state", {"candidate", "confirmed", "disputed", "retracted"}),
        ("confirm_presence_tiers", "state", {"candidate", "confirmed", "retracted"}),
        ("rate_match_unambiguous", "how", {"exact", "normalized", "added", "removed"}),
        ("heartbeat_alerts", "absent", {True, False}),
        ("heartbeat_alerts", "failed", {True, False}),
    ],
)
def test_every_branch_occurs(spark, name, column, values):
    found = catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").select(column).distinct().collect()
    assert {r[0] for r in found} == values
