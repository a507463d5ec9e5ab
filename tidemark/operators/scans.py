"""Neighbours and running sums in the order of a key, where one key may hold a third of all rows.

While no key has more than ``HOT_ROWS`` rows, a window over the key does. Beyond that the rows are
ranged by key and order into parts of about ``PART_ROWS`` and written once. A window then covers a key's rows of
one part; the first and last rows and the sums of the parts, one row each, carry the rest over. No task sorts a whole key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.storage import written

HOT_ROWS = 2_000_000
PART_ROWS = 500_000


def hottest(rows: DataFrame, key: list[str]) -> int:
    """How many rows the key with the most of them has."""
    return (rows.groupBy(*key).agg(F.count("*").alias("n")) if key else rows.agg(F.count("*").alias("n"))).agg(F.max("n")).head()[0] or 0


class Scan:
    """Rows in the order of ``order`` (which tells the rows of a key apart) within ``key``; without a key, all of them."""

    def __init__(self, rows: DataFrame, key: list[str], order: list[str]):
        self.key, self.order = key, order
        self.split = hottest(rows, key) > HOT_ROWS
        if self.split:
            parts = max(1, -(-rows.count() // PART_ROWS))
            rows = written(rows.repartitionByRange(parts, *key, *order).withColumn("_part", F.spark_partition_id()), "scan")
        self.rows = rows

    def _window(self):
        return W.partitionBy(*self.key, *(["_part"] if self.split else [])).orderBy(*self.order)

    def _over_parts(self):
        """A part of a key is one row."""
        return W.partitionBy(*self.key).orderBy("_part")

    def neighbours(self, before: dict[str, str], after: dict[str, str]) -> Scan:
        """Add columns (name: column) of the row before and of the row after."""
        w = self._window()
        columns = {n: F.lag(c).over(w) for n, c in before.items()} | {n: F.lead(c).over(w) for n, c in after.items()}
        if not self.split:
            self.rows = self.rows.withColumns(columns)
            return self
        at = F.struct(*self.order)
        ends = self.rows.groupBy(*self.key, "_part").agg(
            F.min(at).alias("_first"), F.max(at).alias("_last"), *[F.max_by(c, at).alias(f"_b_{n}") for n, c in before.items()], *[F.min_by(c, at).alias(f"_a_{n}") for n, c in after.items()]
        )
        over = self._over_parts()
        ends = ends.select(*self.key, "_part", "_first", "_last", *[F.lag(f"_b_{n}").over(over).alias(f"_b_{n}") for n in before], *[F.lead(f"_a_{n}").over(over).alias(f"_a_{n}") for n in after])
        rows = self.rows.withColumns(columns).join(ends, [*self.key, "_part"])
        edge = {n: F.when(at == F.col("_first"), F.col(f"_b_{n}")).otherwise(F.col(n)) for n in before}
        edge |= {n: F.when(at == F.col("_last"), F.col(f"_a_{n}")).otherwise(F.col(n)) for n in after}
        self.rows = rows.withColumns(edge).drop("_first", "_last", *[f"_b_{n}" for n in before], *[f"_a_{n}" for n in after])
        return self

    def running(self, sums: dict[str, str], inclusive: bool = False) -> Scan:
        """Add sums (name: column) over the rows before, or up to the row itself."""
        w = self._window().rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        self.rows = self.rows.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})
        if self.split:
            whole = self.rows.groupBy(*self.key, "_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
            over = self._over_parts().rowsBetween(W.unboundedPreceding, -1)
            whole = whole.select(*self.key, "_part", *[F.coalesce(F.sum(f"_s_{n}").over(over), F.lit(0)).alias(f"_s_{n}") for n in sums])
            self.rows = self.rows.join(whole, [*self.key, "_part"]).withColumns({n: F.col(n) + F.col(f"_s_{n}") for n in sums}).drop(*[f"_s_{n}" for n in sums])
        return self

    def result(self) -> DataFrame:
        return self.rows.drop("_part") if self.split else self.rows
