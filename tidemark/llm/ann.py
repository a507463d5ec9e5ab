"""Approximate nearest neighbours: inverted lists scanned by an adaptive dimension test.

Vectors are turned by one random rotation, so that any block of columns is a fair sample of all.
A bounded sample of rows fits the list centres; every row is indexed in its nearest list. A query
probes the lists with the best centres: so many that, over sampled queries, they hold RECALL of
the true neighbours. Data that fall into clusters need few lists, and fewer of them as rows grow;
data without clusters need many. Inside a list its columns are read in blocks, for all queries
that probe it at a time: after d of D columns the squared distance so far, scaled by D/d,
estimates the whole, and a candidate is abandoned when the estimate exceeds what the query's
current k-th best allows by the factor (1 + EPSILON / sqrt(d))**2, a hypothesis test with a small
false-rejection rate. The survivors of all columns are scored on the original vectors in double
precision, all by the same sum.

For inner products the allowed squared distance of a candidate p is |q|^2 + |p|^2 - 2 bound.

Lists over LIST_ROWS rows are cut into parts, so that a vector that fills a third of the table
does not fill one task; each part is scanned alike. Queries come in bounded blocks.

Defined results: see ``vectors``; zero vectors take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import best, gathered, matrix, query_blocks, usable, width

K = 20
#: The fit reads at most so many rows, picked by a hash of their ids.
FIT_ROWS = 16_384
SEED_ROWS = 4_096
LIST_ROWS = 4_096
#: Lists: this times the square root of the rows, up to MOST_LISTS.
LISTS_PER_ROOT = 0.5
MOST_LISTS = 8_192
#: The share of true neighbours that the probed lists are to hold, measured with so many queries
#: of the sample.
RECALL = 0.96
TRIALS = 512
BLOCK = 16
EPSILON = 2.1
#: Queries that are scanned at a time.
SCANNED = 512
SEED = 20_240_601
FOUND = "query_id long, vec_id long, score double"


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm on the bounded sample; an empty list keeps its centre."""
    found = np.unique(sample, axis=0)
    found = found[np.random.default_rng(SEED).permutation(len(found))[:lists]]
    for _ in range(rounds):
        at = nearest(sample, found)
        sums, counts = np.zeros_like(found), np.bincount(at, minlength=len(found))
        np.add.at(sums, at, sample)
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return found


def nearest(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    return ((to * to).sum(1) - 2 * rows @ to.T).argmin(1)


def probes(sample: np.ndarray, middle: np.ndarray, count: int, k: int, recall: float = RECALL) -> int:
    """How many lists hold ``recall`` of the nearest rows, measured in the sample.

    The k nearest of all ``count`` rows are about as near as the first k * len(sample) / count of the sample.
    """
    near = max(1, min(len(sample) - 1, round(k * len(sample) / count)))
    if len(sample) < 2:
        return len(middle)
    at = nearest(sample, middle)
    pick = np.random.default_rng(SEED).permutation(len(sample))[:TRIALS]
    scores = sample[pick] @ sample.T
    scores[np.arange(len(pick)), pick] = -np.inf
    found = np.argpartition(-scores, near - 1, axis=1)[:, :near]
    place = np.argsort(np.argsort(-(sample[pick] @ middle.T), axis=1), axis=1)  # of each list in the order of the query
    needed = np.sort(np.take_along_axis(place, at[found], axis=1), axis=None)
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def exact(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products row by row, each summed in the same order wherever it stands."""
    return np.add.reduce(np.ascontiguousarray(rows * queries), axis=1)


def scan(queries: np.ndarray, bounds: np.ndarray, rows: np.ndarray, squares: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) positions, rotated vectors, of the pairs that survive the dimension tests."""
    dims = rows.shape[1]
    lenient = lambda seen: (1 + EPSILON / np.sqrt(seen)) ** 2 if seen < dims else 1 + 1e-9
    mine = np.einsum("ij,ij->i", queries, queries)
    # The first block for all pairs: a product of matrices.
    seen = min(dims, block)
    q, r = queries[:, :seen], rows[:, :seen]
    so_far = np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", r, r) - 2 * (q @ r.T)
    allowed = mine[:, None] + squares - 2 * bounds[:, None]
    a, b = np.nonzero(so_far * (dims / seen) <= allowed * lenient(seen) + 1e-9)
    so_far, allowed = so_far[a, b], allowed[a, b]
    for d in range(block, dims, block):
        seen = min(dims, d + block)
        part = rows[b, d:seen] - queries[a, d:seen]
        so_far = so_far + np.einsum("ij,ij->i", part, part)
        keep = so_far * (dims / seen) <= allowed * lenient(seen) + 1e-9
        a, b, so_far, allowed = a[keep], b[keep], so_far[keep], allowed[keep]
    return a, b


def neighbours(df: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products that the probed lists hold."""
    spark = df.sparkSession
    rows = usable(df, vec_id, embedding, zero=False)
    dims = width(rows)
    rows, _ = written(rows.where(F.size("vec") == dims), "ann-rows")
    count = rows.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = max(1, -(-count // FIT_ROWS))
    fit_ids, fit = gathered(rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).orderBy(F.xxhash64("vec_id")).limit(FIT_ROWS).collect(), dims)
    if not len(fit):
        fit_ids, fit = gathered(rows.orderBy("vec_id").limit(FIT_ROWS).collect(), dims)
    turn = rotation(dims)
    lists = int(min(MOST_LISTS, max(1, LISTS_PER_ROOT * count**0.5)))
    middle = centres(fit @ turn, lists)
    model = spark.sparkContext.broadcast((turn, middle))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, middle = model.value
        for batch in batches:
            if batch.num_rows:
                _, own = matrix(batch, dims)
                yield batch.append_column("list", pa.array(nearest(own @ turn, middle), pa.int32()))

    indexed, _ = written(rows.mapInArrow(index, "vec_id long, vec array<double>, list int"), "ann-index")
    # Parts of a list: so many that each has about LIST_ROWS rows. One row per list: bounded by MOST_LISTS.
    sizes = {r["list"]: r["count"] for r in indexed.groupBy("list").count().collect()}
    parts = np.ones(len(middle), np.int64)
    for at, n in sizes.items():
        parts[at] = -(-n // LIST_ROWS)
    of_list = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("list") + 1) if len(set(parts)) > 1 else F.lit(int(parts[0]))
    buckets = max(1, int(parts.sum()))
    tasks = min(buckets, max(1, -(-count // LIST_ROWS)))
    dealt = indexed.withColumn("part", F.pmod(F.xxhash64("vec_id"), of_list)).repartition(tasks, "list", "part").sortWithinPartitions("list", "part")
    seeds, seed_ids = fit[:SEED_ROWS], fit_ids[:SEED_ROWS]
    seed_lists = nearest(seeds @ turn, middle)
    probed = probes(fit @ turn, middle, count, k, recall)
    found = []
    for block in query_blocks(rows.where(is_query)):
        ids, queries = gathered(block.collect(), dims)  # a bounded block
        turned = queries @ turn
        wanted = np.zeros((len(middle), len(ids)), bool)
        order = np.argpartition(-(turned @ middle.T), probed - 1, axis=1)[:, :probed]
        wanted[order.ravel(), np.repeat(np.arange(len(ids)), probed)] = True
        bounds = np.full(len(ids), -np.inf)
        for i, q in enumerate(queries):
            others = (seeds @ q)[(seed_ids != ids[i]) & wanted[seed_lists, i]]  # the scan will meet all of these
            if len(others) >= k:
                bounds[i] = np.partition(others, len(others) - k)[len(others) - k]
        shared = spark.sparkContext.broadcast((turn, ids, queries, turned, bounds, np.packbits(wanted, axis=1)))
        found.append(dealt.select("vec_id", "vec", "list").mapInArrow(_prober(shared, dims, k), FOUND))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return best(reduce(DataFrame.unionByName, found), k)


def _prober(shared, dims: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, ids, queries, turned, bounds, wanted = shared.value
        bounds = bounds.copy()
        for batch in batches:
            if not batch.num_rows:
                continue
            own, rows = matrix(batch, dims)
            lists = batch.column("list").to_numpy()
            spun = rows @ turn
            squares = np.einsum("ij,ij->i", spun, spun)
            out = ([], [], [])
            edges = np.flatnonzero(np.diff(lists, prepend=-1, append=-1))
            for begin, end in zip(edges, edges[1:], strict=False):
                asked = np.flatnonzero(np.unpackbits(wanted[lists[begin]], count=len(ids)))
                for at in range(0, len(asked), SCANNED):
                    some = asked[at : at + SCANNED]
                    a, b = scan(turned[some], bounds[some], spun[begin:end], squares[begin:end])
                    a, b = some[a], begin + b
                    other = own[b] != ids[a]
                    a, b = a[other], b[other]
                    scores = np.concatenate([np.empty(0), *(exact(rows[b[i : i + 65536]], queries[a[i : i + 65536]]) for i in range(0, len(a), 65536))])
                    order = np.lexsort((own[b], -scores, a))
                    a, b, scores = a[order], b[order], scores[order]
                    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])[: len(a)])
                    place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
                    last = place == k - 1
                    bounds[a[last]] = np.maximum(bounds[a[last]], scores[last])
                    top = place < k
                    out[0].append(ids[a[top]])
                    out[1].append(own[b[top]])
                    out[2].append(scores[top])
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out[0]).astype(np.int64)), pa.array(np.concatenate(out[1]).astype(np.int64)), pa.array(np.concatenate(out[2]).astype(np.float64))],
                    ["query_id", "vec_id", "score"],
                )

    return run


def op6_ann(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
