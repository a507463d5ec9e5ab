"""Digests, cadence, states and marks in small cases."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import digests

MONDAY = datetime(2024, 1, 29, 13)  # 07:00 in Chicago


def test_trigger_truth_table(spark):
    old, fresh = MONDAY - timedelta(days=30, seconds=1), MONDAY - timedelta(days=30)
    cases = [
        (0, MONDAY, old, True, "never"), (1, MONDAY, fresh, True, "fire"), (1, MONDAY, fresh, False, "hold"), (1, MONDAY, old, False, "fire"), (1, MONDAY, None, False, "fire"), (3, MONDAY, fresh, False, "fire"),
        (9, MONDAY + timedelta(days=1), None, False, "hold"), (9, datetime(2024, 1, 29, 5), None, False, "hold"), (9, datetime(2024, 1, 30, 5), fresh, False, "fire"),  # still Sunday, still Monday there
    ]
    df = spark.createDataFrame(cases, "pending int, now timestamp_ntz, last timestamp_ntz, force boolean, expected string")
    rows = df.select("expected", digests.trigger(F.col("pending"), F.col("now"), F.col("last"), F.col("force")).alias("d")).collect()
    assert [r["d"] for r in rows] == [r["expected"] for r in rows]


def test_request(spark):
    pending = spark.createDataFrame([(i, "Co", datetime(2024, 1, 1 + i % 3), "notes_changed", "notes", None, '"x"') for i in range(30)], "change_id long, competitor string, observed_at timestamp_ntz, change_type string, json_path string, before string, after string")
    bodies = spark.createDataFrame([(datetime(2024, 1, d), str(d) * 3000) for d in range(1, 7)], "created_at timestamp_ntz, body string")
    lines = digests.digest_request(pending, bodies).first()["prompt"].split("\n")
    assert lines[0] == "Confirmed changes (reference by index):" and lines[1] == '[0] Co 2024-01-01 notes_changed notes: none -> "x"' and lines[20].startswith("[19] Co 2024-01-02") and lines[21] == ""
    assert lines[22] == "Prior digests, newest first:" and lines[23::2] == [f"--- digest {n} ---" for n in (1, 2, 3, 4)] and [len(x) for x in lines[24::2]] == [2000] * 4 and lines[24][0] == "6"
    assert digests.digest_request(pending.limit(1), bodies.where("1 = 0")).first()["prompt"].endswith("\n\nNo prior digests.")


def test_due_sources_keep_their_own_cadence(spark):
    sources = spark.createDataFrame([(1, 1, True), (2, 2, True), (3, 1, False), (4, 1, True)], "source_id long, cadence_hours int, active boolean")
    fetches = spark.createDataFrame([(i, datetime(2024, 1, 1, 11, 0, 0, 900_000)) for i in (1, 2, 3)], "source_id long, fetched_at timestamp_ntz")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    assert sorted(r["source_id"] for r in digests.due(sources, fetches, now).collect()) == [1, 4]
    earlier = F.lit("2024-01-01 11:59:59").cast("timestamp_ntz")
    assert sorted(r["source_id"] for r in digests.due(sources, fetches, earlier).collect()) == [4]


def test_states_in_order(spark):
    rows = [(None, None, "x", "pending"), (1, False, "x", "failing"), (1, True, "x", "degraded"), (1, True, None, "ok")]
    df = spark.createDataFrame(rows, "checked int, ok boolean, reason string, expected string").select("expected", digests.state_of(F.col("checked"), F.col("ok"), F.col("reason")).alias("s"))
    assert all(r["s"] == r["expected"] for r in df.collect())


def test_marks(spark):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    marks = [(1, at(1), "Pro $9 → $10"), (1, at(2), "Pro $1,200 → $999.5"), (1, at(2, 5), "Solo $5 → $4"), (1, at(3), "Pro $1 → $2"), (1, at(3, 1), "Solo tier added"), (1, at(5), "Pro $1 → $2"), (2, at(2), "Pro $1 → $2"), (1, at(4), "Pro none to 299"), (1, at(4, 1), "Pro $3 → $3")]
    points = spark.createDataFrame([(1, at(1)), (1, at(4, 1))], "source_id long, at timestamp_ntz")
    found = digests.day_marks(digests.inside_plot(spark.createDataFrame(marks, "source_id long, at timestamp_ntz, label string"), points)).collect()
    assert sorted((r["day"], r["marks"], r["direction"]) for r in found) == [("2024-01-01", 1, "rise"), ("2024-01-02", 2, "fall"), ("2024-01-03", 2, "flat"), ("2024-01-04", 2, "flat")]


def test_cells_lines_and_backups(spark):
    cells = {"1.5": 1.5, "7": 7.0, '"7"': None, "null": None, "true": None, "[1]": None, "{": None, "": None}
    found = spark.createDataFrame([(c,) for c in cells], "c string").select("c", digests.number_of(F.col("c")).alias("n")).collect()
    assert {r["c"]: r["n"] for r in found} == cells
    assert spark.range(1).select(digests.first_line(F.lit("a" * 400 + "\nb")).alias("l")).first()["l"] == "a" * 300
    names = spark.createDataFrame([(f"b{i}",) for i in range(9)], "name string")
    assert sorted(r["name"] for r in digests.retired(names).collect()) == ["b0", "b1"]
