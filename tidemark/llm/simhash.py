"""SimHash near-duplicates, linked through vantage-point trees.

Two ways to use it:

* ``linked``: 64-bit fingerprints of 3-word shingles; fingerprints link at 2 or fewer differing
  bits, and the connected components are the groups. Exact.
* ``similar``: groups of documents whose sets of 5-word shingles have a Jaccard similarity of
  0.8 or more. Exact. Wider SimHash fingerprints propose most pairs, a join on the rarest
  shingles of each text proposes all that the fingerprints leave out, and exact similarities
  confirm them.

A tree works on a sub-metric, the Hamming distance on some of the bits. Its levels are vantage
points: every fingerprint goes down the branch of its ring, its distance from the vantage point.
By the triangle bound, rings of two fingerprints differ by no more than their distance in the
sub-metric. Of two 32-bit halves, two fingerprints at 2 or fewer bits differ in at most 1 bit of
one half. So there are two trees, one on each half with radius 1: a fingerprint is stored in the
shard of its rings, and asks the shards across a boundary that a point at distance 1 can lie in,
32 at most whatever the size of the corpus; every other shard is pruned. As two halves at distance
1 have bit counts of different parity, only those of even parity ask. (A median split on all 64
bits would overlap the boundary with about half of the fingerprints at each level.)

The leaves are the shards. Within a leaf the full metric is searched by a local tree with
boundary overlap; a leaf so dense that no vantage point splits it is linked exactly
through the points within one bit of each fingerprint, in linear space. Leaves pass on
spanning links, never all their pairs.

Defined results: a null or empty text, or one of white space only, has the fingerprint 0 and is
linked like any other; equal texts, repeated rows included, share a group; a null id keeps its
row and its group is named by the smallest id that is not null; an empty table gives no rows;
texts are read whole; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, frugal_column, text_batches, written
from .components import roots

SEED = 42
SHINGLE = 3
RADIUS = 2
HALF_BITS = 32
LEVELS = 12
PAIRWISE = 256


def _words(text: str | None) -> list[bytes]:
    """Lower-cased in ASCII and split at ASCII white space, as bytes methods do."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; fewer words are one run."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: -width + 1 or None].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of a text."""
    return majority(shingle_hashes(_words(text), SHINGLE))


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t) for t in texts.to_pylist()], pa.int64())


# ---------------------------------------------------------------- trees


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def vantage(tree: int, level: int) -> int:
    return signed(xxhash.xxh64_intdigest(f"{tree}:{level}", SEED))


def leaf(fp: Column, mask: int, tree: int, levels: int = LEVELS) -> Column:
    """The shard of a fingerprint in a tree on the bits of ``mask``: a hash of its rings."""
    rings = [F.bit_count(fp.bitwiseXOR(F.lit(vantage(tree, i)).cast("long")).bitwiseAND(F.lit(signed(mask)).cast("long"))) for i in range(levels)]
    return F.xxhash64(F.lit(tree), *rings)


def masks() -> list[int]:
    """The two halves; each has a tree."""
    half = (1 << HALF_BITS) - 1
    return [half, half << HALF_BITS]


def visits(fp: Column, mask: int) -> Column:
    """Points whose shards a fingerprint goes to: its own half first, then, if that is of even parity, all at distance 1."""
    own = fp.bitwiseAND(F.lit(signed(mask)).cast("long"))
    near = [own.bitwiseXOR(F.lit(signed(1 << bit)).cast("long")) for bit in range(64) if mask >> bit & 1]
    return F.when(F.bit_count(own) % 2 == 0, F.array(own, *near)).otherwise(F.array(own))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each position's component, given linked positions."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def near_pairs(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links, enough to connect all positions whose distinct fingerprints are within ``radius``."""

    def between(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [np.empty((0, 2), np.int64)]
        for at in range(0, len(i), 512):
            close = np.bitwise_count(fps[i[at : at + 512], None] ^ fps[None, j]) <= radius
            x, y = np.nonzero(close)
            found.append(np.stack([i[at + x], j[y]], axis=1))
        whole = np.concatenate(found)
        return whole[:, 0], whole[:, 1]

    def hubs(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two fingerprints are within 2 bits if and only if they share a point within 1 bit of both."""
        points = np.concatenate([fps[i], *(fps[i] ^ np.uint64(1 << bit) for bit in range(64))])
        owner = np.tile(i, 65)
        order = np.argsort(points, kind="stable")
        points, owner = points[order], owner[order]
        same = points[1:] == points[:-1]
        return owner[:-1][same], owner[1:][same]

    a, b, todo = [], [], [np.arange(len(fps))]
    while todo:
        own = todo.pop()
        if len(own) <= PAIRWISE:
            x, y = between(own, own)
        else:
            d = np.bitwise_count(fps[own] ^ fps[own[0]]).astype(np.int64)
            middle = int(np.median(d))
            inner, outer = own[d <= middle], own[d > middle]
            x = own[(d <= middle) & (d > middle - radius)]  # the triangle bound: only these can link across
            y = own[(d > middle) & (d <= middle + radius)]
            if min(len(inner), len(outer)) * 8 < len(own) or len(x) * len(y) > 64 * len(own) + (1 << 22):
                x, y = hubs(own)
            else:
                todo += [inner, outer]
                x, y = between(x, y)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys with two rows or more, from batches sorted by key."""
    held: list[pa.Table] = []
    for batch in batches:
        whole = pa.Table.from_batches([batch])
        if held:
            whole = pa.concat_tables([*held, whole])
        if not whole.num_rows:
            continue
        keys = whole[key].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        for i in np.flatnonzero(np.diff(edges) > 1):
            yield whole.slice(edges[i], edges[i + 1] - edges[i])
        held = [whole.slice(edges[-1])]
    if held and held[0].num_rows > 1:
        yield held[0]


def _leaf_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in grouped(batches, "leaf"):
        if not pc.any(shard["stored"]).as_py():  # nobody lives here whom the askers could meet
            continue
        own = np.unique(shard["fp"].to_numpy())
        fps = own.view(np.uint64)
        root = local_roots(len(fps), *near_pairs(fps))
        apart = root != np.arange(len(fps))
        if apart.any():
            yield pa.RecordBatch.from_arrays([pa.array(own[apart]), pa.array(own[root[apart]])], ["u", "v"])


def shards(fps: DataFrame) -> DataFrame:
    """fp, leaf and whether the fingerprint is stored there or only asks."""
    trees = []
    for t, mask in enumerate(masks()):
        points = fps.select("fp", F.posexplode(visits(F.col("fp"), mask)).alias("at", "point"))
        trees.append(points.select("fp", leaf(F.col("point"), mask, t).alias("leaf"), (F.col("at") == 0).alias("stored")))
    return trees[0].unionByName(trees[1])


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that connect distinct fingerprints (column fp) within RADIUS bits."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards(fps).repartition(parts, "leaf").sortWithinPartitions("leaf").mapInArrow(_leaf_links, "u long, v long")


def linked(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (signed long) and component_id of every document."""
    text_batches(df.sparkSession)
    docs = df.select(df[doc_id].cast("long").alias("doc_id"), F.arrow_udf(_fingerprints, "long")(df[text]).alias("fp"))
    docs, _ = written(docs, "simhash")
    distinct, _ = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    root = roots(links(distinct.select("fp")))
    labelled = distinct.join(root.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    groups = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.join(labelled.join(groups, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = linked(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- similar documents

SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
#: Words of 64 bits in a wide fingerprint; each has three 21-bit blocks with a tree each.
WIDE = 4
WIDE_BLOCK = 21
#: Of the first 128 bits of two documents at 0.8, about a fifteenth differs.
COARSE_BITS = 26
#: Leaves of so many rows propose all their close pairs, larger ones those with their middle row.
ALL_PAIRS = 8
#: A leaf of more rows is dealt out over parts of about so many.
LEAF_ROWS = 4096
BROADCAST_LEAVES = 100_000
#: Ids are broadcast up to this number (about 40 bytes each), and joined by a shuffle beyond it.
BROADCAST_IDS = 1_000_000
#: A text that is compared with many is sent once for so many of them.
MEMBERS = 256
#: Words of 64 bits in an odd sketch, and in a second one of texts of more than so many shingles.
ODD = 8
LONG_ODD = 128
LONG = 400
#: One document in so many is read for the common shingles, which are those in COMMON of them or
#: more, at most MOST_COMMON. They only order the shingles: the links are the same for any.
SAMPLE = 16
COMMON = 4
MOST_COMMON = 100_000
COMMON_BITS = 22

# Odd multipliers that mix 64 bits.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_FINAL = np.uint64(0xBF58476D1CE4E5B9)
#: Words that a worker remembers, and the bytes of the longest: a worker lives as long as its session.
KNOWN_WORDS = 1 << 16
KNOWN_BYTES = 64
_known: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word; words met before are looked up."""
    try:
        return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        own = {w: _known[w] if w in _known else xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
        if len(_known) + len(own) > KNOWN_WORDS:
            _known.clear()
        if len(own) <= KNOWN_WORDS:
            _known.update((w, h) for w, h in own.items() if len(w) <= KNOWN_BYTES)
        return np.fromiter(map(own.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _FINAL
    return x ^ (x >> np.uint64(32))


def shingle_set(own: np.ndarray, width: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The set of shingles of a text, in order, from the hashes of its words; fewer words are one shingle."""
    if not len(own):
        return own
    runs = max(1, len(own) - width + 1)
    total = np.zeros(runs, np.uint64)
    for i in range(min(width, len(own))):
        total += own[i : i + runs] * _MIX[i]
    return np.unique(_mixed(total + np.uint64(min(width, len(own)))))


def shingles(text: str | None) -> np.ndarray:
    return shingle_set(word_hashes(_words(text)))


def wide_fingerprint(own: np.ndarray) -> list[int]:
    """WIDE independent SimHashes of the set of words."""
    once = np.unique(own)
    return [majority(_mixed(once * _MIX[i])) for i in range(WIDE)]


def odd_sketch(own: np.ndarray, words: int = ODD) -> list[int]:
    """Bits that are set if an odd number of the shingles falls on them.

    Shingles of both sets fall out: two sketches differ in no more bits than their sets in shingles.
    """
    odd = np.bincount((own & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def rarest(own: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set, common ones last: two sets that similar share one.

    They share ``similarity`` of the larger one at least, so not all that they share can come later.
    ``common`` ranks a shingle by its last COMMON_BITS bits.
    """
    if not len(own):
        return own
    kept = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
    rank = common[(own & np.uint64((1 << COMMON_BITS) - 1)).astype(np.int64)]
    return np.concatenate([own[rank == r] for r in range(3)])[:kept] if rank.any() else own[:kept]


def common_shingles(docs: DataFrame) -> np.ndarray:
    """0, 1 or 2 for each value of the last COMMON_BITS bits of a shingle: in few, many and very
    many texts of a sample."""
    sets = lambda texts: pa.array([shingles(t).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    found = sample.select(F.explode(F.arrow_udf(frugal_column(sets), "array<bigint>")("text")).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    top = found.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).collect()
    rank = np.zeros(1 << COMMON_BITS, np.int8)
    at = np.array([r["shingle"] for r in top], np.int64) & ((1 << COMMON_BITS) - 1)
    np.maximum.at(rank, at, np.where(np.array([r["n"] for r in top], np.int64) >= SAMPLE * COMMON, 2, 1).astype(np.int8))
    return rank


PROFILE = "struct<wide:array<bigint>,n:bigint,odd:array<bigint>,long:array<bigint>,rarest:array<bigint>>"


def _keys(texts: pa.Array) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(b" ".join(_words(t))) for t in texts.to_pylist()], pa.binary())


def _profiles(texts: pa.Array, similarity: float, common: np.ndarray) -> pa.Array:
    rows = []
    for text in texts.to_pylist():
        own = word_hashes(_words(text))
        found = shingle_set(own)
        rows.append({"wide": wide_fingerprint(own), "n": len(found), "odd": odd_sketch(found), "long": odd_sketch(found, LONG_ODD) if len(found) > LONG else None, "rarest": rarest(found, similarity, common).view(np.int64)})
    longs = pa.list_(pa.int64())
    return pa.array(rows, pa.struct([("wide", longs), ("n", pa.int64()), ("odd", longs), ("long", longs), ("rarest", longs)]))


def middle(x: np.ndarray, y: np.ndarray) -> int:
    """The position that is nearest to the majority of all, bit by bit: the vantage point of a leaf."""
    far = np.zeros(len(x), np.int64)
    for words in (x, y):
        bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        usual = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(words), bitorder="little").view(np.uint64)[0]
        far += np.bitwise_count(words ^ usual)
    return int(far.argmin())


def _proposals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a leaf that are close in the first 128 bits: all of a small leaf; of a larger one,
    which is a cluster of copies, those with its middle row (``open_pairs`` takes the rest)."""
    us, vs, held = [], [], 0
    for shard in grouped(batches, "leaf"):
        ids = shard["least"].to_numpy()
        x, y = shard["w0"].to_numpy().view(np.uint64), shard["w1"].to_numpy().view(np.uint64)
        if len(ids) <= ALL_PAIRS:
            a, b = np.triu_indices(len(ids), 1)
        else:
            b = np.arange(len(ids))
            a = np.full(len(ids), middle(x, y))
            a, b = a[a != b], b[a != b]
        close = np.bitwise_count(x[a] ^ x[b]).astype(np.int64) + np.bitwise_count(y[a] ^ y[b]) <= COARSE_BITS
        u, v = ids[a[close]], ids[b[close]]
        us.append(np.minimum(u, v))
        vs.append(np.maximum(u, v))
        held += len(u)
        if held > 50_000:
            yield _pairs(us, vs)
            us, vs, held = [], [], 0
    if us:
        yield _pairs(us, vs)


def _pairs(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def _small(df: DataFrame, most: int) -> DataFrame:
    """``df``, a written table, to be broadcast if it has ``most`` rows at most."""
    return F.broadcast(df) if df.count() <= most else df


def spread(shards: DataFrame, use: Scratch) -> tuple[DataFrame, DataFrame]:
    """Crowded leaves in parts, and the pairs of their rows with the leaf's first row.

    A crowded leaf is a cluster of copies: most of its rows are near its first one.
    ``open_pairs`` finds the links that this leaves out.
    """
    first = F.min(F.struct("least", "w0", "w1"))
    crowded = use.written(shards.groupBy("leaf").agg(F.count("*").alias("n"), first.alias("first")).where(F.col("n") > LEAF_ROWS), "similar-crowded")
    rows = shards.join(_small(crowded, BROADCAST_LEAVES), "leaf", "left")
    apart = F.bit_count(F.col("w0").bitwiseXOR(F.col("first.w0"))) + F.bit_count(F.col("w1").bitwiseXOR(F.col("first.w1")))
    pairs = rows.where((F.col("least") > F.col("first.least")) & (apart <= COARSE_BITS)).select(F.col("first.least").alias("u"), F.col("least").alias("v"))
    part = F.pmod(F.xxhash64("least"), F.ceil(F.coalesce("n", F.lit(1)) / LEAF_ROWS))
    return rows.select("least", "w0", "w1", F.when(F.col("n").isNull(), F.col("leaf")).otherwise(F.xxhash64("leaf", part)).alias("leaf")), pairs


def likely(pairs: DataFrame, sketches: DataFrame, apart: float) -> DataFrame:
    """The pairs (u, v) that sizes and sketches do not rule out: their sets may differ in no more
    than ``apart`` of the sum of their sizes."""
    of = lambda side: sketches.select(F.col("least").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in sketches.columns if c != "least"))
    both = pairs.join(of("u"), "u").join(of("v"), "v")
    bits = sum((F.bit_count(F.col(f"u_o{w}").bitwiseXOR(F.col(f"v_o{w}"))) for w in range(ODD)), F.lit(0))
    differ = F.greatest(bits.cast("long"), F.abs(F.col("u_n") - F.col("v_n")))
    most = apart * (F.col("u_n") + F.col("v_n")) + 1e-6
    longer = F.aggregate(F.zip_with("u_long", "v_long", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return both.where(differ <= most).where(F.coalesce(longer <= most, F.lit(True))).select("u", "v")


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by key, cut where the key changes."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        last = batch[key].to_numpy()
        if last[0] == last[-1] and held[0][key][0].as_py() == last[0]:
            continue  # one key so far
        whole = pa.concat_tables(held)
        cut = len(whole) - int((last == last[-1]).sum())
        yield whole.slice(0, cut)
        held = [whole.slice(cut)]
    if held:
        yield pa.concat_tables(held)


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the runs of equal shingles that have two groups or more, from rows sorted by shingle."""

    def of(run: pa.Table) -> pa.RecordBatch:
        keys, root = run["leaf"].to_numpy(), run["root"].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        differ = np.minimum.reduceat(root, edges) != np.maximum.reduceat(root, edges)
        kept = np.flatnonzero(np.repeat(differ, np.diff(np.append(edges, len(keys)))))
        return pa.RecordBatch.from_arrays([pa.array(keys[kept]), pa.array(run["least"].to_numpy()[kept])], ["leaf", "least"])

    for run in whole_runs(batches, "leaf"):
        yield of(run)


#: Pairs that a step of ``_possible`` compares.
STEP = 1 << 18


def _asked(keys: np.ndarray, asks: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (asking, answering) of the rows of one key and different roots, about STEP at a time.

    Rows are in order of their keys and, within one, those that ask come first."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(edges[1:], len(keys))
    run = np.repeat(np.arange(len(edges)), ends - edges)
    asking = np.flatnonzero(asks)
    begin = edges[run[asking]] + np.bincount(run[asking], minlength=len(edges))[run[asking]]  # the first that answers
    sizes = ends[run[asking]] - begin
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(asking):
        to = max(at + 1, int(np.searchsorted(total, total[at] + STEP, "right")) - 1)
        n = sizes[at:to]
        i = np.repeat(asking[at:to], n)
        j = np.arange(int(n.sum())) - np.repeat(total[at:to] - total[at], n) + np.repeat(begin[at:to], n)
        keep = root[i] != root[j]
        yield i[keep], j[keep]
        at = to


def _possible(batches: Iterator[pa.RecordBatch], apart: float, best: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a block, an asking row and another of a different group, whose sets may differ in
    no more than ``apart`` of the sum of their sizes: by sizes and sketches they cannot be ruled out.

    ``best``: of each asking row and other group only the pair that seems nearest; ``more`` tells
    that there are others.
    """

    def of(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, ids, root, asks, n = (whole[c].to_numpy() for c in ("block", "least", "root", "asks", "n"))
        odd = [whole[f"o{w}"].to_numpy().view(np.uint64) for w in range(ODD)]
        for a, b in _asked(keys, asks, root):
            sizes = n[a] + n[b]
            near = np.abs(n[a] - n[b]) <= apart * sizes + 1e-6
            a, b, sizes = a[near], b[near], sizes[near]
            d = sum(np.bitwise_count(o[a] ^ o[b]).astype(np.int64) for o in odd)
            near = d <= apart * sizes + 1e-6
            a, b, d = a[near], b[near], d[near] / sizes[near]
            more = np.zeros(len(a), bool)
            if best and len(a):
                order = np.lexsort((ids[b], d, root[b], a))
                a, b = a[order], b[order]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (root[b[1:]] != root[b[:-1]])]))
                more = np.diff(np.append(first, len(a))) > 1
                a, b = a[first], b[first]
            if len(a):  # the same pair under several shingles is passed on once
                u, v = ids[a], ids[b]
                order = np.lexsort((more, v, u))
                u, v, more = u[order], v[order], more[order]
                last = np.concatenate([(u[1:] != u[:-1]) | (v[1:] != v[:-1]), [True]])
                u, v, more = u[last], v[last], more[last]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(u), pa.array(more)], ["u", "v", "asker", "more"])

    for whole in whole_runs(batches, "block"):
        yield from of(whole)


def open_pairs(shared: DataFrame, root: DataFrame, sketches: DataFrame, apart: float, askers: DataFrame | None, use: Scratch) -> DataFrame:
    """The likely pairs that share a shingle of ``shared`` (leaf, least) and are in different groups so far.

    Without ``askers`` (column asker) of each row and other group only the pair that seems nearest, else
    all pairs of those rows.

    Rows outside a shingle's largest group ask, all of its rows answer, in blocks of bounded size:
    a shingle of one group costs nothing, and one with few strays costs a pass for these.
    """
    if askers is not None:
        askers = _small(askers.select(F.col("asker").alias("least")), BROADCAST_IDS)
        shared = shared.join(shared.join(askers, "least", "left_semi").select("leaf").distinct(), "leaf", "left_semi")
    rows = shared.join(root.select(F.col("u").alias("least"), F.col("v").alias("root")), "least", "left").withColumn("root", F.coalesce("root", "least"))
    groups = rows.groupBy("leaf", "root").agg(F.count("*").alias("n"))
    leaves = groups.groupBy("leaf").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("groups"))
    parts = lambda n: F.ceil(n / LEAF_ROWS).cast("long")
    leaves = leaves.where("groups > 1").select("leaf", "main", parts(F.col("n") - F.col("most")).alias("askers"), parts(F.col("n")).alias("holders"))
    leaves = use.written(leaves, "similar-leaves")
    rows = rows.join(_small(leaves, BROADCAST_LEAVES), "leaf").join(sketches.drop("long"), "least")
    shown = [c for c in sketches.columns if c not in ("least", "long")]
    of = lambda n, salt: F.pmod(F.xxhash64("least", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = ["leaf", "least", *shown, "root"]
    asking = rows.where("root <> main").select(*kept, F.lit(True).alias("asks"), of("askers", 1).alias("i"), every("holders").alias("j"))
    held = rows.select(*kept, F.lit(False).alias("asks"), every("askers").alias("i"), of("holders", 2).alias("j"))
    blocks = asking.unionByName(held).select("least", *shown, "root", "asks", F.xxhash64("leaf", "i", "j").alias("block"))
    count = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ask = partial(_possible, apart=apart, best=askers is None)
    return blocks.repartition(count, "block").sortWithinPartitions("block", F.desc("asks")).mapInArrow(frugal(ask), "u long, v long, asker long, more boolean")


def _compared(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Members of a part that are as similar as that to its centre, which comes first."""
    part, centre, own = None, None, None
    for batch in batches:
        us, vs = [], []
        for at, first, key, text in zip(*(batch[c].to_pylist() for c in ("part", "first", "doc_id", "text")), strict=True):
            if at != part or first:
                part, centre, own = at, key, shingles(text)
                continue
            other = shingles(text)
            both = len(np.intersect1d(own, other, assume_unique=True))
            if both >= similarity * (len(own) + len(other) - both) - 1e-9:
                us.append(min(centre, key))
                vs.append(max(centre, key))
        if us:
            yield _pairs([np.array(us, np.int64)], [np.array(vs, np.int64)])


def confirmed(pairs: DataFrame, docs: DataFrame, similarity: float, use: Scratch) -> DataFrame:
    """The pairs (u, v) whose texts are as similar as that; ``docs`` has one row for each id.

    The one of a pair that is in more pairs is a centre. The texts of its partners are sent to it
    once, its own once for every MEMBERS of them.
    """
    pairs = use.written(pairs, "similar-proposed")
    degree = pairs.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").agg(F.count("*").alias("n"))
    rows = pairs.join(degree.withColumnRenamed("n", "nu"), "u").join(degree.select(F.col("u").alias("v"), F.col("n").alias("nv")), "v")
    left = F.col("nu") >= F.col("nv")
    rows = rows.select(F.when(left, F.col("u")).otherwise(F.col("v")).alias("centre"), F.when(left, F.col("v")).otherwise(F.col("u")).alias("member"), F.greatest("nu", "nv").alias("n"))
    salt = F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / MEMBERS).cast("long"))
    rows = rows.select("member", "centre", F.xxhash64("centre", salt).alias("part"), F.struct("centre", salt.alias("salt")).alias("key"))
    sent = rows.select(F.col("member").alias("doc_id"), "key", F.lit(False).alias("first"))
    sent = use.written(sent.unionByName(rows.select(F.col("centre").alias("doc_id"), "key", F.lit(True).alias("first")).distinct()), "similar-sent")
    texts = docs.join(_small(sent, BROADCAST_IDS), "doc_id").select(F.xxhash64("key").alias("part"), "key", "first", "doc_id", "text")
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts.repartition(count, "part").sortWithinPartitions("part", "key", F.desc("first")).select("part", "first", "doc_id", "text")
    return use.written(ordered.mapInArrow(frugal(partial(_compared, similarity=similarity)), "u long, v long").distinct(), "similar-close")


def similar(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id of every document, by shingle similarity; rows of one id are one document."""
    text_batches(df.sparkSession)
    spark, apart = df.sparkSession, (1 - similarity) / (1 + similarity)
    with Scratch(spark) as use:
        docs = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
        keys = use.written(docs.select("doc_id", F.arrow_udf(frugal_column(_keys), "binary")("text").alias("key")), "similar-keys")
        least = use.written(keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "similar-least").where("least is not null")
        # Copies of a text that comes earlier are profiled no more.
        copies = use.written(keys.join(least.where("n > 1"), "key").where("doc_id <> least").select("doc_id").distinct(), "similar-copies")
        few = copies.count() <= BROADCAST_IDS
        docs = docs.where("doc_id is not null")  # the others take the group of their text
        once = docs.join(F.broadcast(copies) if few else copies, "doc_id", "left_anti")
        common = common_shingles(once)
        profile = F.arrow_udf(frugal_column(lambda texts: _profiles(texts, similarity, common)), PROFILE).asNondeterministic()
        # Repeated rows of one id are read once; those whose texts differ keep the profile of one of them.
        profiles = use.written(once.select(F.col("doc_id").alias("least"), profile(F.col("text")).alias("p")).select("least", "p.*"), "similar-profiles")
        repeated = keys.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("least"))
        if repeated.head(1):
            again = profiles.join(repeated, "least", "left_semi").dropDuplicates(["least"])
            profiles = use.written(profiles.join(repeated, "least", "left_anti").unionByName(again), "similar-profiles-once")
            once = once.dropDuplicates(["doc_id"])
        block = (1 << WIDE_BLOCK) - 1
        leaves = [leaf(F.col("wide")[w], block << (WIDE_BLOCK * i), 100 + 3 * w + i, 10) for w in range(WIDE) for i in range(3)]
        shards = profiles.select("least", F.col("wide")[0].alias("w0"), F.col("wide")[1].alias("w1"), F.explode(F.array(*leaves)).alias("leaf"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt, to_first = spread(shards, use)
        proposed = dealt.repartition(parts, "leaf").sortWithinPartitions("leaf").mapInArrow(frugal(_proposals), "u long, v long").unionByName(to_first).distinct()
        sketches = profiles.select("least", "n", *(F.col("odd")[w].alias(f"o{w}") for w in range(ODD)), "long")
        close = confirmed(likely(proposed, sketches, apart), once, similarity, use)
        root = roots(close)
        labelled = profiles.join(root.select(F.col("u").alias("least"), F.col("v").alias("root")), "least", "left").select("least", F.explode("rarest").alias("leaf"), F.coalesce("root", "least").alias("root"))
        shared = use.written(labelled.repartition(parts, "leaf").sortWithinPartitions("leaf").mapInArrow(frugal(_open_rows), "leaf long, least long"), "similar-shared")
        # The nearest of each other group first; then, for rows with others that are in another group still, all.
        near = use.written(open_pairs(shared, root, sketches, apart, None, use), "similar-near")
        tested = use.written(likely(near.select("u", "v").distinct(), sketches, apart), "similar-open")
        close = use.written(close.unionByName(confirmed(tested, once, similarity, use)), "similar-links")
        root = roots(close)
        askers = use.written(near.where("more").select("asker").distinct(), "similar-askers")
        if askers.head(1):
            rest = open_pairs(shared, root, sketches, apart, askers, use).select("u", "v").distinct().join(tested, ["u", "v"], "left_anti")
            rest = use.written(likely(rest, sketches, apart), "similar-rest")
            root = roots(close.unionByName(confirmed(rest, once, similarity, use)))
        at = least.join(root.select(F.col("u").alias("least"), "v"), "least", "left").select("key", F.coalesce("v", "least").alias("component_id"))
        return written(keys.join(at, "key", "left").select("doc_id", "component_id"), "similar-groups")[0]
