"""Two readings a candidate under a budget, against the loop that they replace."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scans, verifying

ATTEMPT = "struct<raised:boolean,ok:boolean,tiers:int,confidence:string,reason:string,cost:long>"


def plain(candidates, budget):
    spent, stopped, out = 0, False, {}
    for url, fetched, _, a, b in sorted(candidates):
        cost = 0
        if stopped:
            out[url] = ("skipped", 0)
            continue
        if not fetched:
            out[url] = ("rejected", 0)
            continue
        outcome = None
        for raised, ok, _, _, _, price in (a, b):
            if spent >= budget:
                stopped, outcome = True, "skipped"
                break
            if raised:
                outcome = "errored"
                break
            spent += price if ok else 0
            cost += price if ok else 0
        if outcome is None:
            same = a[1] and b[1] and a[3] != "low" and b[3] != "low" and a[2] == b[2]
            outcome = "admitted" if same and 2 <= a[2] <= 8 else "rejected"
        out[url] = (outcome, cost)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_outcomes_match_the_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(scans, "HOT_ROWS", 5 if seed % 2 else 10**9)
    monkeypatch.setattr(scans, "PART_ROWS", 7)
    rng = random.Random(seed)
    attempt = lambda: (rng.random() < 0.1, rng.random() < 0.8, rng.choice([1, 2, 2, 3, 9]), rng.choice(["high", "high", "low"]), "invalid: x", rng.randint(1, 9))
    rows = [(f"u{i:03d}", rng.random() < 0.8, "HTTP 500", attempt(), attempt()) for i in range(50)]
    budget = rng.choice([0, 40, 90, 10**6])
    df = spark.createDataFrame(rows, f"url string, fetched boolean, fetch_error string, first {ATTEMPT}, second {ATTEMPT}").repartition(3)
    assert {r["url"]: (r["outcome"], r["cost_micros"]) for r in verifying.verified(df, budget).collect()} == plain(rows, budget)


def test_reasons(spark):
    good, low, bad, many = (False, True, 3, "high", None, 1), (False, True, 1, "low", None, 1), (False, False, 0, "high", "ungrounded: tiers.Pro = 7", 1), (False, True, 27, "high", None, 1)
    rows = [("a", True, None, good, good), ("b", True, None, low, bad), ("c", True, None, many, many), ("d", False, "HTTP 404", good, good), ("e", True, None, good, (True, True, 3, "high", None, 1))]
    found = {r["url"]: (r["outcome"], r["reason"], r["priced_tiers"]) for r in verifying.verified(spark.createDataFrame(rows, f"url string, fetched boolean, fetch_error string, first {ATTEMPT}, second {ATTEMPT}"), 100).collect()}
    assert found == {
        "a": ("admitted", "both attempts agreed on 3 priced tiers", 3), "b": ("rejected", "attempt 1 extracted 1 priced tier (low confidence), attempt 2 failed: ungrounded: tiers.Pro = 7", None),
        "c": ("rejected", "prices per product or unit rather than per plan (27 priced entries)", None), "d": ("rejected", "re-fetch failed: HTTP 404", None), "e": ("errored", None, None),
    }


def test_estimates(spark):
    costs = spark.createDataFrame([(10,), (11,), (None,)], "cost_micros long")
    assert verifying.mean_cost(costs) == 11 and verifying.mean_cost(costs.where("1 = 0")) == 10_000
    row = spark.range(1).select(*verifying.verify_estimate(F.lit(3), F.lit(10), 60), verifying.overran(F.lit(121), F.lit(100)).alias("over"), verifying.overran(F.lit(1), F.lit(100)).alias("under"), verifying.overran(F.lit(1), F.lit(0)).alias("none")).first()
    assert row.asDict() == {"micros": 60, "within_budget": True, "over": True, "under": False, "none": True}


def test_a_candidate_without_a_canary_is_refused(spark):
    rows = [("https://A.example/p?q", "Ex & Am", "dev", "admit", "Team"), ("https://b.example", "B", "dev", "pass", None), ("https://c.example", "C", "dev", "pass", ""), ("https://d.example", "D", "dev", "reject", "Team")]
    found = {r["name"]: r["entry"] for r in verifying.config_entries(spark.createDataFrame(rows, "url string, name string, category string, verdict string, canary string")).collect()}
    assert set(found) == {"Ex & Am", "B", "C"} and found["B"] is None and found["C"] is None
    assert found["Ex & Am"].split("\n")[1:4] == ["    slug: 'ex-am',", "    name: 'Ex & Am',", "    homepage: 'https://a.example',"]
