"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are dealt to buckets by length, longest first, so that a bucket holds vectors of
nearly one length. The longest vectors give every query a first lower bound of its k-th score.
A bucket with longest length l can only matter to query q if cos = bound / (|q| l) is at most 1:
that is the bucket's local cosine threshold. Where the threshold is high, the query's largest
coordinates narrow the candidates (a unit vector within an angle of q has each coordinate in an
interval); otherwise the lengths do (only |p| >= bound / |q|). What is left is verified
by exact products, which raise the bound for the rest of the bucket.

Products are exact integers: float64 products where they stay below 2**53, Python integers beyond.

Defined results: see ``vectors``; also, a query without other candidates returns none,
and scores beyond 64 bits raise. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import best, cut, gathered, matrix, query_blocks, usable, width

K = 10
BUCKET_ROWS = 4096
SEEDS = 2048
#: At a local cosine threshold over this, coordinates prune; below, lengths do.
COORDINATE_FROM = 0.7
FOCUS = 4
EXACT = 2.0**53
FOUND = "query_id long, vec_id long, score long"


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, one line per query."""
    if not len(queries) or not len(rows):
        return np.zeros((len(queries), len(rows)), np.int64)
    if np.abs(queries).max() * np.abs(rows).max() * rows.shape[1] < EXACT:
        return (queries @ rows.T).astype(np.int64)
    big = np.array([[int(x) for x in q] for q in queries], object) @ np.array([[int(x) for x in p] for p in rows], object).T
    return big.astype(np.int64)


def survivors(q: np.ndarray, q_norm: float, bound: float, unit: np.ndarray, norms: np.ndarray) -> np.ndarray | None:
    """Candidates of one bucket that may score ``bound`` or more; None: the bucket is pruned."""
    if not len(norms) or bound <= 0 or q_norm == 0:
        return np.arange(len(norms))
    cos = bound / (q_norm * norms[0])
    slack = 1e-9
    if cos > 1 + slack:
        return None
    keep = norms >= bound / q_norm * (1 - slack)  # norms fall, so this is a prefix
    if cos > COORDINATE_FROM:
        heads = q / q_norm
        for f in np.argsort(-np.abs(heads))[:FOCUS]:
            reach = np.sqrt(max(0.0, 1 - cos * cos) * max(0.0, 1 - heads[f] ** 2)) + slack
            keep &= (unit[:, f] >= heads[f] * cos - reach) if heads[f] > 0 else (unit[:, f] <= heads[f] * cos + reach)
    return np.flatnonzero(keep)


def topk(df: DataFrame, is_query: Column, scale: int | None = None, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with all other rows.

    Components become floor(scale * x); without a scale they must be integers already.
    """
    rows = usable(df, vec_id, embedding)
    if scale is not None:
        rows = rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))
    dims = width(rows)
    rows = rows.where(F.size("vec") == dims)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    rows, _ = written(rows.withColumn("norm", norm), "topk-rows")
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    seeds = gathered(rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).collect(), dims)  # SEEDS rows at most
    dealt = rows.repartitionByRange(buckets, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    spark, parts = df.sparkSession, []
    for block in query_blocks(rows.where(is_query)):
        ids, queries = gathered(block.collect(), dims)  # a bounded block
        bounds = np.full(len(ids), -np.inf)
        for i, line in enumerate(products(queries, seeds[1])):
            others = line[seeds[0] != ids[i]]
            if len(others) >= k:
                bounds[i] = np.partition(others, len(others) - k)[len(others) - k]
        shared = spark.sparkContext.broadcast((ids, queries, np.sqrt((queries * queries).sum(1)), bounds))
        parts.append(dealt.select("vec_id", "vec", "norm").mapInArrow(_searcher(shared, dims, k), FOUND))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best(reduce(DataFrame.unionByName, parts), k)


def _searcher(shared, dims: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, q_norms, bounds = shared.value
        bounds = bounds.copy()
        for batch in batches:  # at most one bucket; a batch of it is as good a bucket
            if not batch.num_rows:
                continue
            own, rows = matrix(batch, dims)
            norms = batch.column("norm").to_numpy()
            unit = rows / np.where(norms > 0, norms, 1)[:, None]
            left = [(i, s) for i in range(len(ids)) if (s := survivors(queries[i], q_norms[i], bounds[i], unit, norms)) is not None and len(s)]
            whole = [i for i, s in left if 4 * len(s) > len(own)]
            scored = dict(zip(whole, products(queries[whole], rows), strict=True))  # many left: one matrix product
            out = ([], [], [])
            for i, s in left:
                scores = scored[i][s] if i in scored else products(queries[i : i + 1], rows[s])[0]
                s, scores = s[own[s] != ids[i]], scores[own[s] != ids[i]]
                s, scores = s[scores >= bounds[i]], scores[scores >= bounds[i]]
                top = cut(own[s], scores, k)
                if len(top) == k:
                    bounds[i] = max(bounds[i], scores[top[-1]])
                out[0].append(np.full(len(top), ids[i]))
                out[1].append(own[s[top]])
                out[2].append(scores[top])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["query_id", "vec_id", "score"])

    return run


def op1_topk(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, scale=1024)


ORACLE_OP1 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as vec from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.vec, v.vec) as bigint) as score
      from v q join v on q.vec_id % 100 = 0 and q.vec_id <> v.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 10
"""
