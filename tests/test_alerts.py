"""Silences are raised once, by a timer or by the row that ends them."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.sources.storage import new_folder
from tidemark.streaming import alerts
from tidemark.streaming.runs import drained

START = datetime(2024, 1, 1)


def raised(spark, batches):
    """(source, hour of its last row) of the alerts, after each of several starts over growing input."""
    folder = new_folder(spark, "test-alerts")
    for rows in batches:
        df = spark.createDataFrame([(s, START + timedelta(hours=h)) for s, h in rows], "source_id long, at timestamp")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/input")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/input")
        found = drained(alerts.absences(stream, "1 hour", hours=5), folder)
    start = int(spark.range(1).select(F.unix_micros(F.lit(START))).head()[0])
    assert found.where(f"raised_us <> last_us + {5 * 3_600_000_000}").count() == 0
    return sorted(((r["source_id"], (r["last_us"] - start) // 3_600_000_000) for r in found.collect()))


def test_a_timer_raises_without_a_row(spark):
    assert raised(spark, [[(1, 0), (2, 0)], [(2, 4)], [(2, 8)], [(2, 9), (1, 9)], [(2, 12), (1, 12)]]) == [(1, 0)]


def test_a_gap_inside_a_batch_is_raised_by_its_end_and_order_does_not_count(spark):
    assert raised(spark, [[(1, 20), (1, 0), (1, 4), (1, 9), (1, 20)], [(1, 21)]]) == [(1, 9)]


def test_exactly_the_limit_is_no_silence_and_the_end_counts_up_to_the_watermark(spark):
    assert raised(spark, [[(1, 0), (1, 5), (3, 0)], [(2, 12)]]) == [(1, 5), (3, 0)]
    assert raised(spark, [[(1, 0)], [(2, 6)]]) == []  # the watermark stands at hour 5
