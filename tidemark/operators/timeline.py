"""Price lines of tiers: points, gap segments, step points, rungs; and running sums over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.scans import Scan

#: A line is not drawn over a longer silence; exactly so many days still count as continuous.
GAP_DAYS = 75


def price_points(runs: DataFrame, tiers: DataFrame) -> DataFrame:
    """source_id, run, at, tier, price, ord: known monthly prices; of tiers that share a name the last one counts."""
    rows = runs.select("source_id", "run", F.col("first_at").alias("at"), "page_state").join(tiers, "page_state")
    priced = rows.where("monthly is not null").groupBy("source_id", "run", F.col("name").alias("tier"))
    return priced.agg(F.first("at").alias("at"), F.max_by("monthly", "ord").alias("price"), F.min("ord").alias("ord"))


def segments(points: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """Add ``segment``, from 1: a new one after an observation without the tier, or after a longer gap."""
    scan = Scan(points, ["source_id", "tier"], ["run"]).neighbours({"_at": "at", "_run": "run"}, {})
    silence = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("_at").cast("timestamp"))
    joined = (F.col("run") - F.col("_run") == 1) & (silence <= gap_days * 86_400_000_000)
    scan.rows = scan.rows.withColumn("opens", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    return scan.running({"segment": "opens"}, inclusive=True).result().drop("opens", "_at", "_run")


def step_points(lines: DataFrame) -> DataFrame:
    """The points, and before each next point of the segment one at its time with the price so far."""
    order = W.partitionBy("source_id", "tier", "segment").orderBy("run")
    own = F.struct(F.col("at"), F.col("price"), F.lit(False).alias("step"))
    step = F.struct(F.lead("at").over(order).alias("at"), F.col("price"), F.lit(True).alias("step"))
    rows = lines.withColumn("p", F.filter(F.array(own, step), lambda p: p["at"].isNotNull()))
    return rows.select("source_id", "tier", "segment", "run", F.explode("p").alias("p")).select("source_id", "tier", "segment", "run", "p.*")


def rungs(points: DataFrame) -> DataFrame:
    """source_id, tier, price, rung by each tier's latest price: free, then entry, mid and enterprise in order of price."""
    last = points.groupBy("source_id", "tier").agg(F.max_by("price", "run").alias("price"), F.min(F.struct("run", "ord")).alias("seen"))
    paid = F.col("price") != 0
    order = W.partitionBy("source_id", paid).orderBy("price", "seen", "tier")
    kth, n = F.row_number().over(order), F.count("*").over(W.partitionBy("source_id", paid))
    rung = F.when(~paid, "free").when(kth == 1, "entry").when(kth == n, "enterprise").otherwise("mid")
    return last.select("source_id", "tier", "price", rung.alias("rung"))


def spent_before(rows: DataFrame, cost: Column, key: str, order: list[str]) -> DataFrame:
    """Add ``spent``: the costs of the earlier rows of the same key."""
    return Scan(rows.withColumn("_cost", cost), [key], order).running({"spent": "_cost"}).result().drop("_cost")


def degraded_lifecycle(snapshots: DataFrame) -> DataFrame:
    """source_id, id, reason, cleared: good fetches set or clear the reason; failed ones leave it."""
    rows = Scan(snapshots.where("ok"), ["source_id"], ["observed_at", "id"]).neighbours({"before": "error"}, {}).result()
    return rows.select("source_id", "id", F.col("error").alias("reason"), (F.col("before").isNotNull() & F.col("error").isNull()).alias("cleared"))
