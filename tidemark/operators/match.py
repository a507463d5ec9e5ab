"""Identity of tiers and rates across two states, in stages.

Both sides of a pair lie in one table, dealt by pair once; every stage is a window inside the pair,
so no stage shuffles again. Greedy first-fit on an equality key pairs the k-th with the k-th.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.expressions import normal_metric, normal_name, prices_close


def _both(before: DataFrame, after: DataFrame, fields: list[str], tasks: int | None = None) -> DataFrame:
    side = lambda rows, s: rows.select("pair_id", "ord", F.lit(s).alias("side"), F.struct("ord", *fields).alias("row"))
    both = side(before, 0).unionByName(side(after, 1))
    return both.repartition(*([tasks] if tasks else []), "pair_id").withColumns({"how": F.lit(None).cast("string"), "other": F.lit(None).cast(_type(before, ["ord", *fields]))})


def _type(rows: DataFrame, fields: list[str]):
    return rows.select(F.struct(*fields).alias("row")).schema["row"].dataType


def _met(rows: DataFrame, group: list, how: str, when: Column | None = None) -> DataFrame:
    """Rows that are still open take the row of the other side in their group as ``other``."""
    of = W.partitionBy("pair_id", F.col("how").isNull(), *group)
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("row"))).over(of)
    rows = rows.withColumns({"_b": side(0), "_a": side(1)})
    found = F.col("how").isNull() & F.col("_b").isNotNull() & F.col("_a").isNotNull()
    if when is not None:
        found = found & F.coalesce(when, F.lit(False))
    other = F.when(found, F.when(F.col("side") == 0, F.col("_a")).otherwise(F.col("_b"))).otherwise(F.col("other"))
    return rows.withColumns({"other": other, "how": F.when(found, how).otherwise(F.col("how"))}).drop("_b", "_a")


def _stage(rows: DataFrame, key: Column, how: str) -> DataFrame:
    """The k-th open row of a key on one side meets the k-th on the other."""
    order = W.partitionBy("pair_id", F.col("how").isNull(), "key", "side").orderBy("ord")
    rows = rows.withColumn("key", key).withColumn("kth", F.row_number().over(order))
    return _met(rows, ["key", "kth"], how).drop("key", "kth")


def _matches(rows: DataFrame) -> DataFrame:
    """One row per match, or per row that has none: pair_id, how, before and after (structs)."""
    first = F.col("side") == 0
    alone = F.when(first, "removed").otherwise("added")
    return rows.where(F.col("how").isNull() | first).select(
        "pair_id", F.coalesce("how", alone).alias("how"), F.when(first, F.col("row")).alias("before"), F.when(first, F.col("other")).otherwise(F.col("row")).alias("after")
    )


def match_tiers(before: DataFrame, after: DataFrame, fields: tuple[str, ...] = ("name", "monthly"), tasks: int | None = None) -> DataFrame:
    """pair_id, how (exact, normalized, positional, removed or added), before and after: structs of ord and ``fields``.

    Both sides have pair_id, ord and ``fields``, with name and monthly among them. Each stage sorts a task's rows and holds them:
    of large tables ``tasks`` says to how many the pairs are dealt; else the session's shuffle partitions do."""
    rows = _both(before, after, list(fields), tasks)
    rows = _stage(rows, F.col("row.name"), "exact")
    rows = _stage(rows, normal_name(F.col("row.name")), "normalized")
    near = prices_close(F.col("_b.monthly"), F.col("_a.monthly"))
    return _matches(_met(rows, ["ord"], "positional", near))


def match_rates(before: DataFrame, after: DataFrame) -> DataFrame:
    """pair_id, how, before and after: structs of ord, metric and unit_price.

    The k-th of a metric meets the k-th; what is left meets by normalized metric where that is the only
    one of its kind on both sides."""
    rows = _stage(_both(before, after, ["metric", "unit_price"]), F.col("row.metric"), "exact")
    rows = rows.withColumn("key", normal_metric(F.col("row.metric")))
    of = W.partitionBy("pair_id", F.col("how").isNull(), "key")
    rows = rows.withColumn("sole", F.count("*").over(of) == 2)  # with a row on each side: one and one
    return _matches(_met(rows, ["key"], "normalized", F.col("sole")).drop("key", "sole"))
