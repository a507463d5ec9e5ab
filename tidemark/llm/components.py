"""Connected components by alternating large-star and small-star rounds.

Each round is joins and minimum aggregations; no node's links meet in one task. Rounds are
written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_now, written


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def roots(edges: DataFrame) -> DataFrame:
    """(u, v): each node that is not the smallest of its component, and that smallest node.

    ``edges`` has long columns u and v; direction, repeats and loops do not matter.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _signature(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now, new_path = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop_now(spark, path)
        path, after = new_path, _signature(now)
        if after == before:
            break
        before = after
    return now
