"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Documents with equal texts form one group and go to one shard. A partial partition of k
subsets starts as one group beside k-1 empty subsets; the two with the largest spread are
combined in opposite order (largest subset with smallest), until one is left.

Every group is an item. The groups are dealt over tasks of about ITEMS of them; each task
differences its own to one partial partition of k subsets, and these are combined by the same
rule, FAN at a time, until one is left. Only the k sums of a partial partition travel; a group keeps
the number of its subset, and the last combination says which shard that is.

Groups of at least an even share of what is left (fewer than k) have a shard alone, and the other
shards share the rest evenly.

Defined results: a null text counts as empty, and both are one group; repeated rows and
null ids are placed like any row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

SHARDS = 16
#: Groups that a task differences, and partial partitions that one combines.
ITEMS = 50_000
FAN = 4096


def combine(partials: np.ndarray, ways: int) -> np.ndarray:
    """Karmarkar-Karp of partial partitions (rows of at most ``ways`` sums, the rest empty): for each row
    and subset the subset of the whole, 0 to ways-1."""
    n = len(partials)
    if not n:
        return np.zeros((0, ways), np.int32)
    # Node i < n is a row; a later node joins two others. order[j]: which subsets of its children make its subset j.
    full = lambda x: tuple(x) + (0,) * (ways - len(x))
    starts, heap = [], []
    for i, row in enumerate(partials):
        order = sorted(range(len(row)), key=lambda j, row=row: -int(row[j])) + list(range(len(row), ways))
        sums = tuple(sorted(map(int, row), reverse=True))
        starts.append(order)
        heap.append((full(sums)[-1] - sums[0], i, sums))
    heapq.heapify(heap)
    children: list[tuple] = []
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        x, y = full(x), full(y)
        joined = sorted(((x[j] + y[ways - 1 - j], j) for j in range(ways)), reverse=True)
        sums = tuple(v for v, _ in joined)
        children.append((a, b, [j for _, j in joined]))
        heapq.heappush(heap, (sums[-1] - sums[0], n + len(children) - 1, sums))
    # The final labels travel down from the last node to the rows.
    labels: dict[int, list[int]] = {n + len(children) - 1: list(range(ways))}
    for node in range(n + len(children) - 1, n - 1, -1):
        a, b, order = children[node - n]
        first, second = [0] * ways, [0] * ways
        for label, j in zip(labels.pop(node), order, strict=True):
            first[j], second[ways - 1 - j] = label, label
        labels[a], labels[b] = first, second
    out = np.zeros((n, ways), np.int32)
    for i, order in enumerate(starts):
        out[i, order] = labels[i]
    return out


def difference(sizes: np.ndarray, ways: int) -> np.ndarray:
    """Karmarkar-Karp: the subset, 0 to ways-1, of each item."""
    return combine(np.asarray(sizes, np.int64).reshape(-1, 1), ways)[:, 0]


def alone(large: list[int], total: int, shards: int) -> int:
    """How many of the largest groups have a shard to themselves."""
    n, rest = 0, total
    while n < min(shards - 1, len(large)) and large[n] * (shards - n) >= rest:
        rest -= large[n]
        n += 1
    return n


def _differenced(ways: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # about ITEMS rows of a digest and a size
        if held:
            items = pa.Table.from_batches(held).sort_by([("bytes", "descending"), ("key", "ascending")]).combine_chunks()
            subset = difference(items["bytes"].to_numpy(), ways)
            part = pa.array(np.full(len(items), TaskContext.get().partitionId()), pa.int64())
            yield pa.RecordBatch.from_arrays([items["key"].chunk(0), items["bytes"].chunk(0), part, pa.array(subset, pa.int32())], ["key", "bytes", "part", "subset"])

    return run


def _combined(ways: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("subset", "ascending")])
        parts, at = np.unique(rows["part"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(parts), ways), np.int64)
        sums[at, rows["subset"].to_numpy()] = rows["bytes"].to_numpy()
        labels = combine(sums, ways)
        return pa.table({"part": np.repeat(parts, ways), "subset": np.tile(np.arange(ways, dtype=np.int32), len(parts)), "shard": labels.ravel()})

    return run


def sharded(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    body = F.coalesce(df[text], F.lit(""))
    rows = df.select(
        df[doc_id].cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.unhex(F.md5(body)).alias("key"),
    )
    rows, _ = written(rows, "shard-rows")  # the texts are read once
    groups, _ = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    largest = groups.orderBy(F.desc("bytes"), "key").limit(shards).collect()
    n = alone([r["bytes"] for r in largest], total, shards)
    ways = shards - n
    shared = groups.where(~F.col("key").isin([bytes(r["key"]) for r in largest[:n]])) if n else groups
    parts = max(1, -(-count // ITEMS))
    placed, _ = written(shared.repartition(parts, "key").mapInArrow(_differenced(ways), "key binary, bytes long, part long, subset int"), "shard-partials")
    while True:  # one round unless there are over FAN partial partitions
        sums, _ = written(placed.groupBy("part", "subset").agg(F.sum("bytes").alias("bytes")), "shard-sums")
        block = F.floor(F.col("part") / FAN)
        at = sums.groupBy(block.alias("block")).applyInArrow(_combined(ways), "part long, subset int, shard int")
        few = parts <= FAN  # at most FAN * shards rows then
        placed = placed.join(F.broadcast(at) if few else at, ["part", "subset"]).select("key", "bytes", block.cast("long").alias("part"), F.col("shard").alias("subset"))
        parts = -(-parts // FAN)
        if parts == 1 and few:
            break
        placed, _ = written(placed, "shard-partials")
    at = placed.select("key", (F.col("subset") + n).cast("int").alias("shard"))
    if n:
        own = [F.struct(F.lit(bytes(r["key"])).alias("key"), F.lit(i).alias("shard")) for i, r in enumerate(largest[:n])]
        at = at.unionByName(groups.sparkSession.range(1).select(F.inline(F.array(*own))))
    rows = rows.join(at, "key").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard")
    return numbered(rows, "shard", ["doc_id", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return sharded(table(spark, sf_dir, "documents"))
