"""Which stored pages one pass of paid extraction reads, and what each row comes to.

The pass goes through the pending rows in order of time. A page text that was read once is found by its
hash, so the first row of a text pays and the others hit the cache; a text that fails caches nothing, and each of
its rows is paid for again. Live rows stop for good at the first one that must pay after the month's
budget is spent; historical rows go on, outside the budget. A limit ends the pass before the first call beyond it.

The state that a row sees (what is cached, what is spent, how many calls) follows from the rows before, but needs
no loop: up to the row where the budget ends, the payer of a text is its first row; from there on it is its first historical
row. So two running sums over all rows, split by ranges of time, and two minima by text give every outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scans import Scan
from tidemark.sources.storage import written

#: Micro-dollars of an input and of an output token: of the extraction, and of the digest.
EXTRACTION_RATES, DIGEST_RATES = (1, 5), (3, 15)
#: Longest reason that is kept.
REASON_CHARS = 300
IN_TIME = ["observed_at", "id"]


def token_cost(tokens_in: Column, tokens_out: Column, rates: tuple[int, int] = EXTRACTION_RATES) -> Column:
    return tokens_in * rates[0] + tokens_out * rates[1]


def failure_text(reason: Column, detail: Column) -> Column:
    """What a failed extraction leaves on its row or source."""
    return F.substring(F.concat(F.lit("extraction "), reason, F.lit(": "), detail), 1, REASON_CHARS)


def extraction_outcomes(
    pending: DataFrame, known: DataFrame, readings: DataFrame, spent: int = 0, budget: int = 25_000_000,
    limit: int | None = None, enabled: bool = True, dry_run: bool = False,
) -> DataFrame:
    """id, observed_at, normalized_hash, outcome, cost_micros of every pending row.

    ``pending``: id, observed_at, normalized_hash (null without stored content), provenance;
    ``known``: normalized_hash of the texts that are cached from earlier passes;
    ``readings``: normalized_hash, ok, currency, cost_micros: what the extractor gives for a text;
    ``spent``: micro-dollars of the month so far. Outcomes: no_content, cached, skipped, extracted, mismatched (another
    currency than USD), degraded (a live failure, charged to the source), historical_failed (recorded on the row), not_reached.
    """
    live = ~F.col("provenance").startswith("wayback:")
    rows = pending.select("id", "observed_at", "normalized_hash", live.alias("live")).join(
        known.select("normalized_hash").distinct().withColumn("was_known", F.lit(True)), "normalized_hash", "left"
    )
    rows = rows.join(readings.select("normalized_hash", "ok", "currency", F.col("cost_micros").alias("price")), "normalized_hash", "left")
    rows = rows.withColumns({"was_known": F.coalesce("was_known", F.lit(False)), "ok": F.coalesce("ok", F.lit(False)), "content": F.col("normalized_hash").isNotNull()})
    rows = written(rows.withColumn("open", F.col("content") & ~F.col("was_known")), "extraction-rows")
    at = F.struct(*IN_TIME)
    if not enabled or dry_run:
        outcome = F.when(~F.col("content"), "no_content").when(F.col("was_known"), "cached").otherwise("skipped")
        return rows.select(*IN_TIME, "normalized_hash", outcome.alias("outcome"), F.lit(0).cast("long").alias("cost_micros"))
    # Up to the end of the budget the first row of a text that can be read pays for it.
    first = rows.where("open").groupBy("normalized_hash").agg(F.min(at).alias("first"), F.min(F.when(~F.col("live"), at)).alias("first_old"))
    rows = rows.join(first, "normalized_hash", "left")
    is_first = F.col("open") & F.col("ok") & (at == F.col("first"))
    scan = Scan(rows.withColumn("live_price", F.when(is_first & F.col("live"), F.col("price")).otherwise(0)), [], IN_TIME).running({"spent": "live_price"})
    rows = scan.rows
    asks = F.col("open") & F.col("live") & (~F.col("ok") | is_first)  # live rows that are not cached, while there is budget
    end = rows.where(asks & (F.col("spent") + spent >= budget)).agg(F.min(at).alias("end")).head()["end"]
    if end is None:
        over, payer = F.lit(False), F.col("first")
    else:
        stop = F.struct(F.lit(end["observed_at"]).alias("observed_at"), F.lit(end["id"]).alias("id"))
        over, payer = at >= stop, F.when(F.col("first") < stop, F.col("first")).otherwise(F.col("first_old"))
    cached = F.col("was_known") | (F.col("ok") & (at > payer))
    refused = F.col("live") & over
    calls = F.col("open") & ~F.coalesce(cached, F.lit(False)) & ~refused
    scan.rows = rows.withColumns({"cached": F.coalesce(cached, F.lit(False)), "calls": calls.cast("int")})
    rows = scan.running({"calls_before": "calls"}).result()
    reached = F.lit(True)
    if limit is not None:
        cut = rows.where((F.col("calls") == 1) & (F.col("calls_before") >= limit)).agg(F.min(at).alias("cut")).head()["cut"]
        if cut is not None:
            reached = at < F.struct(F.lit(cut["observed_at"]).alias("observed_at"), F.lit(cut["id"]).alias("id"))
    good = F.when(F.col("currency") == "USD", "extracted").otherwise("mismatched")
    bad = F.when(F.col("live"), "degraded").otherwise("historical_failed")
    outcome = (
        F.when(~reached, "not_reached").when(~F.col("content"), "no_content").when(F.col("cached"), "cached")
        .when(F.col("calls") == 0, "skipped").when(F.col("ok"), good).otherwise(bad)
    )
    paid = F.when(reached & (F.col("calls") == 1) & F.col("ok"), F.col("price")).otherwise(0).cast("long")
    return rows.select(*IN_TIME, "normalized_hash", outcome.alias("outcome"), paid.alias("cost_micros"))


def pass_summary(outcomes: DataFrame) -> DataFrame:
    """One row: how many rows were considered, and how many came to each outcome; a mismatched one counts as extracted too."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.agg(
        F.count_if(F.col("outcome") != "not_reached").alias("considered"), n("cached").alias("cached"), n("skipped").alias("skipped"),
        n("extracted", "mismatched").alias("extracted"), n("mismatched").alias("mismatched"), n("degraded").alias("degraded"),
        n("historical_failed").alias("historical_failed"), F.coalesce(F.sum("cost_micros"), F.lit(0)).alias("cost_micros"),
    )
