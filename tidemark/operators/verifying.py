"""Verification of candidate pages by two readings each, under a budget whose use is known only afterwards.

Candidates are taken in order. A page that cannot be had is rejected and costs nothing. Before each of the two readings
what has been spent so far is held against the budget; the first reading that it forbids ends the pass, and the candidate with
all that follow stays as it is. A reading that raises leaves its candidate unverified, one that fails is an
observation. A page is admitted if both readings find the same number of priced tiers, in range, and neither is of low confidence.

What each candidate would cost does not depend on the others, so where the budget ends is the first row whose running sum says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import slug
from tidemark.operators.scans import Scan

# The range of priced tiers of a plan table, the cost of a reading before any is known, and how far spending may pass its estimate.
MIN_TIERS, MAX_TIERS = 2, 8
FALLBACK_MICROS = 10_000
OVERRUN = 0.2


def mean_cost(costs: DataFrame) -> int:
    """The mean of the known costs, rounded; a fixed one while there is none."""
    mean = costs.agg(F.avg("cost_micros")).head()[0]
    return int(mean + 0.5) if mean and mean > 0 else FALLBACK_MICROS


def verify_estimate(pending: Column, mean: Column, budget: int) -> list[Column]:
    """micros (each candidate is read twice) and within_budget."""
    micros = pending * mean * 2
    return [micros.alias("micros"), (micros <= budget).alias("within_budget")]


def overran(actual: Column, estimate: Column) -> Column:
    """Whether spending passed its estimate by more than a fifth; spending less is no sign of anything."""
    return F.when(estimate == 0, actual > 0).otherwise((actual - estimate) / estimate > OVERRUN)


def attempt_text(attempt: Column) -> Column:
    """What a reading found, or why it failed."""
    tiers = F.concat(F.lit("extracted "), attempt["tiers"].cast("string"), F.lit(" priced tier"), F.when(attempt["tiers"] == 1, "").otherwise("s"))
    low = F.when(attempt["confidence"] == "low", " (low confidence)").otherwise("")
    return F.when(attempt["ok"], F.concat(tiers, low)).otherwise(F.concat(F.lit("failed: "), attempt["reason"]))


def verified(candidates: DataFrame, budget: int) -> DataFrame:
    """url, outcome (admitted, rejected, skipped, errored), reason, priced_tiers and cost_micros of each candidate.

    ``candidates``: url, fetched, fetch_error, first and second: structs of raised, ok, tiers, confidence, reason, cost.
    """
    cost = lambda a: F.when(F.col(f"{a}.ok") & ~F.col(f"{a}.raised"), F.col(f"{a}.cost")).otherwise(0)
    c1, c2 = F.when(F.col("fetched"), cost("first")).otherwise(0), F.when(F.col("fetched") & ~F.col("first.raised"), cost("second")).otherwise(0)
    scan = Scan(candidates.withColumns({"_c1": c1, "_c2": c2}).withColumn("_cost", F.col("_c1") + F.col("_c2")), [], ["url"]).running({"_before": "_cost"})
    rows = scan.result()
    first_refused = F.col("fetched") & (F.col("_before") >= budget)
    second_refused = F.col("fetched") & ~first_refused & ~F.col("first.raised") & (F.col("_before") + F.col("_c1") >= budget)
    end = rows.where(first_refused | second_refused).agg(F.min("url")).head()[0]
    over = F.lit(False) if end is None else F.col("url") >= end
    read_once = F.lit(False) if end is None else (F.col("url") == end) & second_refused
    a, b = F.col("first"), F.col("second")
    agreed = a["ok"] & b["ok"] & (a["confidence"] != "low") & (b["confidence"] != "low") & (a["tiers"] == b["tiers"])
    admitted = agreed & a["tiers"].between(MIN_TIERS, MAX_TIERS)
    raised = a["raised"] | b["raised"]
    outcome = F.when(over, "skipped").when(~F.col("fetched"), "rejected").when(raised, "errored").when(admitted, "admitted").otherwise("rejected")
    found = F.concat(F.lit("both attempts agreed on "), a["tiers"].cast("string"), F.lit(" priced tiers"))
    units = F.concat(F.lit("prices per product or unit rather than per plan ("), a["tiers"].cast("string"), F.lit(" priced entries)"))
    differ = F.concat(F.lit("attempt 1 "), attempt_text(a), F.lit(", attempt 2 "), attempt_text(b))
    unread = F.concat(F.lit("re-fetch failed: "), F.col("fetch_error"))
    reason = F.when(over | (F.col("fetched") & raised), None).when(~F.col("fetched"), unread).when(admitted, found).when(agreed & (a["tiers"] > MAX_TIERS), units).otherwise(differ)
    spent = F.when(read_once, F.col("_c1")).when(over, 0).otherwise(F.col("_cost"))
    return rows.select("url", outcome.alias("outcome"), reason.alias("reason"), F.when(outcome == "admitted", a["tiers"]).alias("priced_tiers"), spent.cast("long").alias("cost_micros"))


def config_entries(candidates: DataFrame, cadence_hours: int = 24) -> DataFrame:
    """name, entry: the configuration of each passed or admitted candidate (url, name, category, verdict, canary) as text, in the form that
    the configuration file has. One without a canary of its own has no entry: it is refused, not given a guess."""
    rows = candidates.where(F.col("verdict").isin("pass", "admit"))
    origin = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0))
    lines = [
        F.lit("  {"), F.concat(F.lit("    slug: '"), slug(F.col("name")), F.lit("',")), F.concat(F.lit("    name: '"), "name", F.lit("',")), F.concat(F.lit("    homepage: '"), origin, F.lit("',")),
        F.concat(F.lit("    // category: "), "category"),
        F.concat(F.lit("    sources: [{ kind: 'pricing', url: '"), "url", F.lit("', canaryString: '"), "canary", F.lit(f"', cadenceHours: {cadence_hours} }}],")), F.lit("  },"),
    ]
    known = F.coalesce("canary", F.lit("")) != ""
    return rows.select("name", F.when(known, F.array_join(F.array(*lines), "\n")).alias("entry"))


def excluded(rejected: DataFrame, errored: DataFrame) -> DataFrame:
    """name and why of everything that is left out, rejected (name, reason) or not reached (name, error: its first line counts)."""
    failed = errored.select("name", F.substring(F.substring_index("error", "\n", 1), 1, 300).alias("why"))
    return rejected.select("name", F.col("reason").alias("why")).unionByName(failed)
