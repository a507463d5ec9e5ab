"""The paid extraction pass and the split scans, in small cases."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import observe, scans, spending, timeline

PENDING = "id long, observed_at string, normalized_hash string, provenance string"


def plain_pass(pending, known, readings, spent, budget, limit):
    """The loop that the operator replaces."""
    cached, calls, exhausted, ended, out = set(known), 0, False, False, {}
    for i, _, h, provenance in sorted(pending, key=lambda r: (r[1], r[0])):
        live = not provenance.startswith("wayback:")
        if ended:
            out[i] = ("not_reached", 0)
        elif h is None:
            out[i] = ("no_content", 0)
        elif h in cached:
            out[i] = ("cached", 0)
        else:
            if live:
                exhausted = exhausted or spent >= budget
                if exhausted:
                    out[i] = ("skipped", 0)
                    continue
            if limit is not None and calls >= limit:
                ended, out[i] = True, ("not_reached", 0)
                continue
            calls += 1
            ok, currency, price = readings[h]
            if not ok:
                out[i] = ("degraded" if live else "historical_failed", 0)
                continue
            cached.add(h)
            spent += price if live else 0
            out[i] = ("extracted" if currency == "USD" else "mismatched", price)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_outcomes_match_the_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(scans, "HOT_ROWS", 10 if seed % 2 else 10**9)
    monkeypatch.setattr(scans, "PART_ROWS", 9)
    rng = random.Random(seed)
    texts = [f"h{i}" for i in range(12)]
    readings = {h: (rng.random() > 0.3, rng.choice(["USD", "EUR"]), rng.randint(1, 40)) for h in texts}
    pending = [(i, f"2024-01-{rng.randint(1, 28):02d}", rng.choice([*texts, None]), rng.choice(["live", "live", "wayback:1"])) for i in range(70)]
    known, spent, budget, limit = texts[:2], rng.choice([0, 30]), rng.choice([0, 60, 10**6]), rng.choice([None, 0, 15])
    found = spending.extraction_outcomes(
        spark.createDataFrame(pending, PENDING).repartition(3), spark.createDataFrame([(h,) for h in known], "normalized_hash string"),
        spark.createDataFrame([(h, *r) for h, r in readings.items()], "normalized_hash string, ok boolean, currency string, cost_micros long"), spent, budget, limit,
    )
    assert {r["id"]: (r["outcome"], r["cost_micros"]) for r in found.collect()} == plain_pass(pending, known, readings, spent, budget, limit)


def test_failing_siblings_pay_again_and_history_goes_on(spark):
    rows = [(1, "1", "bad", "live"), (2, "2", "bad", "wayback:1"), (3, "3", "a", "live"), (4, "4", "a", "live"), (5, "5", "b", "live"), (6, "6", "b", "wayback:2"), (7, "7", "b", "live"), (8, "8", None, "live")]
    readings = [("bad", False, None, 0), ("a", True, "USD", 10), ("b", True, "EUR", 10)]
    pass_ = [spark.createDataFrame(rows, PENDING), spark.createDataFrame([], "normalized_hash string"), spark.createDataFrame(readings, "normalized_hash string, ok boolean, currency string, cost_micros long")]
    found = {r["id"]: r["outcome"] for r in spending.extraction_outcomes(*pass_, budget=10).collect()}
    assert found == {1: "degraded", 2: "historical_failed", 3: "extracted", 4: "cached", 5: "skipped", 6: "mismatched", 7: "cached", 8: "no_content"}
    assert {r["outcome"] for r in spending.extraction_outcomes(*pass_, enabled=False).collect()} == {"skipped", "no_content"}
    assert {r["outcome"] for r in spending.extraction_outcomes(*pass_, limit=0).where("id = 1").collect()} == {"not_reached"}


def test_costs_and_reasons(spark):
    row = spark.range(1).select(
        spending.token_cost(F.lit(1000), F.lit(200)).alias("e"), spending.token_cost(F.lit(1000), F.lit(200), spending.DIGEST_RATES).alias("d"), spending.failure_text(F.lit("invalid"), F.lit("x" * 400)).alias("t")
    ).first()
    assert (row["e"], row["d"], len(row["t"]), row["t"][:20]) == (2000, 6000, 300, "extraction invalid: ")


def test_split_scans_equal_plain_windows(spark, monkeypatch):
    """One source holds most rows: its runs, segments and sums come out the same when no task sorts all of it."""
    rng = random.Random(4)
    rows = [(7 if rng.random() < 0.8 else rng.randint(1, 5), i, f"2024-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", rng.choice("AB"), rng.choice("AB"), rng.choice(["live", "wayback:1"]), "high", rng.choice([None, "x"])) for i in range(400)]
    valid = spark.createDataFrame(rows, "source_id long, id long, observed_at string, page_state string, normalized_hash string, provenance string, confidence string, error string").withColumn("ok", F.lit(True))
    points = valid.selectExpr("source_id", "page_state as tier", "id as run", "observed_at as at")
    ask = lambda: [
        sorted(map(str, df.collect()))
        for df in (observe.observation_runs(valid), observe.with_runs(valid).select("id", "run", "next_state"), timeline.segments(points).select("run", "segment"), timeline.spent_before(valid, F.col("id"), "source_id", ["observed_at", "id"]).select("id", "spent"), timeline.degraded_lifecycle(valid))
    ]
    plain = ask()
    monkeypatch.setattr(scans, "HOT_ROWS", 20)
    monkeypatch.setattr(scans, "PART_ROWS", 30)
    assert ask() == plain
    parts = scans.Scan(valid, ["source_id"], ["observed_at", "id"]).rows
    assert parts.groupBy("_part").count().agg(F.max("count")).head()[0] < 120
