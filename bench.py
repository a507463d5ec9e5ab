"""Seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark.plans import catalogue

HEADLINE = ["observation_runs", "price_changes_scored", "confirm_states", "tier_match_exact_norm_positional", "content_dedup", "source_health_state"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    # Code is compiled and Python workers start before anything is timed.
    catalogue.QUERIES["observation_runs"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
