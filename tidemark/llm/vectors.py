"""What the vector searches share: usable rows, bounded query blocks, top-k merging.

Usable vectors are not null, hold no null or non-finite component, and have as many components
as most of the others. Rows that repeat an id are one vector: the smallest in array order.
Queries are read in blocks of a bounded number of rows; each block is one broadcast and one
pass over all candidates, so no join pairs vectors and no vector is shuffled for a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES_PER_BLOCK = 8192


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", zero: bool = True) -> DataFrame:
    """vec_id, vec (array<double>) of the rows that take part; ``zero``: whether null vectors do."""
    rows = df.select(df[vec_id].cast("long").alias("vec_id"), df[embedding].cast("array<double>").alias("vec")).where("vec_id is not null and size(vec) > 0")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists("vec", odd))
    if not zero:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    # Only ids are shuffled, and the vectors of those ids alone that repeat.
    repeated = rows.groupBy("vec_id").count().where("count > 1").select("vec_id")
    again = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return rows.join(repeated, "vec_id", "left_anti").unionByName(again) if repeated.head(1) else rows


def width(rows: DataFrame) -> int:
    """The commonest number of components (0: no rows)."""
    found = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    return found[0]["n"] if found else 0


def matrix(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and the rows of ``vec`` as a matrix."""
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    return ids, batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims)


def gathered(rows: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of collected rows, by id."""
    rows = sorted(rows, key=lambda r: r["vec_id"])
    return np.array([r["vec_id"] for r in rows], np.int64), np.array([r["vec"] for r in rows], np.float64).reshape(len(rows), dims)


def query_blocks(queries: DataFrame, per_block: int = QUERIES_PER_BLOCK) -> Iterator[DataFrame]:
    """The query rows in disjoint blocks of about ``per_block`` rows."""
    count = queries.count()
    blocks = -(-count // per_block)
    for k in range(blocks):
        yield queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller vec_id, as query_id, rank, vec_id, score."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def cut(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(ids) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]
