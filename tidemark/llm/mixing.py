"""Mixing sources to target weights, in fixed-length blocks of words.

The words of each source are laid end to end and cut into blocks of equal length. A source's target
says how many blocks it gives. These are dealt to the output shards by a multinomial draw; so, given the
targets, the source counts of a shard are multinomial and no source strays from its target by chance.
The slots of a source run through a pseudorandom permutation of its block numbers, another one for each
epoch; blocks are joined to slots by number.

Targets: sources in the order of their names (nulls last) have the weights 5, 2, 1, repeating, and share
``share`` times all words; a target stops at ``most`` times its source, and what it leaves is shared out among
the others by weight until no target is above. So target = min(most * size, level * weight).

Documents lie in a source in the order of a hash and then of their id and text: a source of any size is spread over
tasks. Rows with equal id and text are interchangeable; they are counted first, so that not even their
number in one place matters. Nothing depends on how the rows are dealt, and reruns agree.

Defined results: a null or empty text has no words, nothing of it is taken; null ids and repeated rows
each give a row; a null source is one of its own; an empty table gives none; only the named
columns are read. A source's taken words differ from its target by at most a block, a document is taken at
most ``most`` times.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_batches, written

#: Weights of the sources in order, repeating; the words to take, and the most of one source, as parts of what there is.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
#: Words of a block, and blocks of an output shard on average.
BLOCK = 64
SHARD_BLOCKS = 16_384
SEED = 20_250
#: Rows of one place that prefix sums are taken over, and equal rows that are laid out at once.
PLACE_ROWS = 100_000
COPIES = 10_000
#: Slots that a task lays out.
TASK_SLOTS = 1_000_000
#: Targets are broadcast for up to this many sources, and joined by a shuffle beyond it.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def count_words(texts: pa.Array) -> pa.Array:
    return pc.fill_null(pc.count_substring_regex(texts, WORD), 0).cast(pa.int64())


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where the permutation of 0 to n-1 that ``key`` names sends each number: a Feistel network over the
    next power of two, run again on what falls outside."""
    bits = max(2, int(n - 1).bit_length())
    low = np.uint64(bits // 2)
    masks = np.uint64((1 << (bits - bits // 2)) - 1), np.uint64((1 << (bits // 2)) - 1)
    keys = _mixed(np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key ^ key >> 64) & (2**64 - 1)))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> low, out[todo] & masks[1]
        for turn, k in enumerate(keys):
            if turn % 2:
                right ^= _mixed(left + k) & masks[1]
            else:
                left ^= _mixed(right + k) & masks[0]
        out[todo] = left << low | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def source_key(source: str | None, seed: int) -> int:
    """Seeds a source's draws and permutations."""
    name = b"\0" if source is None else b"\1" + source.encode()
    return seed << 64 | zlib.crc32(name) << 32 | zlib.adler32(name)


def ranked(rows: DataFrame) -> DataFrame:
    """Add ``rank``, from 0, in the order of ``source``, nulls last: sorted ranges, and the sizes of those before."""
    rows, _ = written(rows.orderBy(F.col("source").isNull(), "source").withColumn("_range", F.spark_partition_id()), "mixing-sources")
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))  # one row per range
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(F.col("source").isNull(), "source"))
    return rows.join(shift, "_range").withColumn("rank", own - 1 + F.col("_shift")).drop("_range", "_shift")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size and ``target`` of each source (rows of source and source_size)."""
    of = F.array(*map(F.lit, weights))
    rows = ranked(sources).withColumn("weight", F.get(of, (F.col("rank") % len(weights)).cast("int")))
    rows, _ = written(rows.select("source", "source_size", "weight", (F.col("source_size") * most).cast("double").alias("cap")), "mixing-weights")
    level = 0.0
    while True:  # each round puts more sources at their cap, or is the last
        full = F.col("cap") <= level * F.col("weight")
        whole, used, open_ = rows.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).head()
        now = (share * (whole or 0) - (used or 0.0)) / open_ if open_ else level
        if now <= level:
            break
        level = now
    return rows.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def laid_out(rows: DataFrame) -> DataFrame:
    """Add ``at``: the words of the source before the document. ``rows``: source, doc_id, digest, size."""
    same = rows.groupBy("source", "doc_id", "digest", "size").agg(F.count("*").alias("copies"))
    some = same.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))).alias("lot"))
    copy = F.explode(F.sequence(F.col("lot") * COPIES, F.least("copies", (F.col("lot") + 1) * COPIES) - 1)).alias("copy")
    rows, _ = written(some.repartition("source", "doc_id", "digest", "lot").select("source", "doc_id", "digest", "size", copy), "mixing-rows")
    places = max(64, -(-rows.count() // PLACE_ROWS))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("doc_id", "digest", "copy"), F.lit(places)))
    order = W.partitionBy("source", "place").orderBy("doc_id", "digest", "copy")
    inside = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    sums = rows.groupBy("source", "place").agg(F.sum("size").alias("n"))
    before = W.partitionBy("source").orderBy("place").rowsBetween(W.unboundedPreceding, -1)  # a row per place
    shift = sums.select(F.col("source").alias("_source"), F.col("place").alias("_place"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    placed = rows.withColumn("inside", inside).join(shift, (F.col("place") == F.col("_place")) & F.col("source").eqNullSafe(F.col("_source")))
    return placed.select("source", "doc_id", "digest", "size", (F.col("shift") + F.col("inside")).alias("at"))


def _drawn(shards: int, seed: int):
    """Sources' block counts of each shard, and the slots that come before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, blocks, quota in zip(*(batch[c].to_pylist() for c in ("source", "blocks", "quota")), strict=True):
                counts = np.random.default_rng(source_key(source, seed)).multinomial(quota, np.full(shards, 1 / shards))
                shard = np.flatnonzero(counts)
                n = len(shard)
                columns = {"source": pa.array([source] * n, pa.string()), "blocks": np.full(n, blocks), "shard": shard, "first": (np.cumsum(counts) - counts)[shard], "count": counts[shard]}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _slots(seed: int):
    """The block at each slot of a source in a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, blocks, shard, first, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slot = np.arange(first, first + count)
                index, key = np.empty(count, np.int64), source_key(source, seed)
                for epoch in range(first // blocks, (first + count - 1) // blocks + 1):
                    own = slot // blocks == epoch
                    index[own] = permuted(slot[own] % blocks, blocks, key + 7919 * (epoch + 1))
                yield pa.RecordBatch.from_pydict({"source": pa.array([source] * count, pa.string()), "index": index, "shard": np.full(count, shard), "slot": slot})

    return run


def mixture(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents).

    ``pieces``: what fills each slot, in order of ``start``: shard, slot (of the source), source, index (of the block), doc_id,
    digest (MD5 of the text), at (of the document in its source), start and length (words of the document).
    ``documents``: source, doc_id, digest, size, at, source_size, target of every row.
    """
    spark = df.sparkSession
    text_batches(spark)
    size = F.arrow_udf(count_words, "long")(df[text])
    rows = df.select(df[source].cast("string").alias("source"), df[doc_id].cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(df[text], F.lit("")))).alias("digest"), size.alias("size"))
    docs, _ = written(laid_out(rows), "mixing-documents")
    goal, _ = written(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mixing-targets")
    blocks = F.ceil(F.col("source_size") / block)
    quota = F.least(most * blocks, F.round(F.col("target") * blocks / F.col("source_size")).cast("long"))
    quotas = goal.where("source_size > 0").select("source", blocks.alias("blocks"), quota.alias("quota"))
    slots = quotas.agg(F.sum("quota")).head()[0] or 0
    shards = max(1, -(-slots // SHARD_BLOCKS))
    # Few small rows become many slots: the number of tasks is that of the slots, and no plan may take their size from the rows.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slots // TASK_SLOTS))
    drawn = quotas.repartition("source").mapInArrow(_drawn(shards, seed), "source string, blocks long, shard long, first long, count long")
    dealt = drawn.repartition(tasks, "source", "shard").mapInArrow(_slots(seed), "source string, index long, shard long, slot long")
    last = F.floor((F.col("at") + F.col("size") - 1) / block)
    spans = docs.where("size > 0").select("source", "doc_id", "digest", "size", "at", F.explode(F.sequence(F.floor(F.col("at") / block), last)).alias("index"))
    begin = F.greatest(F.col("index") * block, F.col("at"))
    spans = spans.select("source", "index", "doc_id", "digest", "at", (begin - F.col("at")).alias("start"), (F.least((F.col("index") + 1) * block, F.col("at") + F.col("size")) - begin).alias("length"))
    dealt = dealt.withColumnsRenamed({"source": "_source", "index": "_index"})
    pieces = spans.hint("merge").join(dealt.hint("merge"), (F.col("index") == F.col("_index")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_index")
    goal = goal.withColumnRenamed("source", "_source")
    goal = F.broadcast(goal) if goal.count() <= BROADCAST_SOURCES else goal
    whole = docs.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return pieces, whole


def op11_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    pieces, whole = mixture(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy(F.col("source").alias("_source"), F.col("at").alias("_at")).agg(F.sum("length").alias("taken"))
    same = (F.col("size") > 0) & (F.col("at") == F.col("_at")) & F.col("source").eqNullSafe(F.col("_source"))
    found = whole.join(taken, same, "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
