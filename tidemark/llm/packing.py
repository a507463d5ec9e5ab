"""Hierarchical multi-length packing of tokenized documents into training windows.

Documents are routed to context-size tiers, each tier is packed best-fit, the gaps of
long windows are filled from the shorter tiers (cutting the last piece to fit), and the
windows of one tier are dealt to step groups that hold equally many tokens.

Packing happens inside one pass over each input partition: no text or id is shuffled, and the
memory of a task is one Arrow batch plus less than one window carried over per tier. What is left
at the end of a partition is cut at powers of two, so that no window needs padding. Step groups
span partitions: the windows of a tier are numbered by prefix sums over the partitions' counts,
and only the last group of a tier is not full; the small windows that end partitions share groups.

Defined results: a null text counts as empty; an empty text is the terminator alone;
repeated rows are packed as often as they appear; null ids are kept; an empty table gives
no rows; only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_batches, written
from .tokenizers import PACKING_VOCABULARY, encoding, vocabulary_path

WINDOW = 1024
TIERS = (1024, 512, 256)
TERMINATOR = 0
#: Tokens in one step group: so many windows of 1024, twice as many of 512, ...
STEP_TOKENS = 64 * 1024

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: As packed: ``ahead`` counts the tokens of earlier windows of the partition's stream, a tier's or that of the ends.
_PACKED = SCHEMA.replace("step_group long", "part long, stream long, ahead long")
_ARROW = pa.schema([(n, pa.int32() if n == "tier" else pa.int64()) for n in (c.split()[0] for c in _PACKED.split(", "))])
#: Rows of counts, one for each partition and tier, are broadcast up to this number (about 40 bytes each).
BROADCAST_COUNTS = 1_000_000


class Packer:
    """Packs the documents of one partition. ``items`` keeps, by length, what waits for a window."""

    def __init__(self, number: int, window: int = WINDOW, tiers: tuple[int, ...] = TIERS):
        self.number, self.window, self.tiers = number, window, tiers
        self.items: dict[int, list] = {}
        self.lengths = 0  # bit n is set if a piece of n tokens waits
        self.sequences = 0
        self.tokens = [0] * (len(tiers) + 1)  # in windows of each tier, and in those that end the partition
        self.rows: list[tuple] = []

    # A piece is (doc_id, doc_tokens, start, ids).
    def put(self, piece: tuple) -> None:
        n = len(piece[3])
        if n >= self.window:
            cut = self.window
            while n - cut >= 0:
                self.emit([self.part(piece, cut - self.window, cut)], self.window)
                cut += self.window
            piece = self.part(piece, cut - self.window, n)
            n = len(piece[3])
        if n:
            self.items.setdefault(n, []).append(piece)
            self.lengths |= 1 << n

    @staticmethod
    def part(piece: tuple, start: int, end: int) -> tuple:
        return piece[0], piece[1], piece[2] + start, piece[3][start:end]

    def take(self, n: int) -> tuple:
        waiting = self.items[n]
        piece = waiting.pop()
        if not waiting:
            self.lengths &= ~(1 << n)
        return piece

    def largest(self, limit: int) -> int:
        return (self.lengths & ((1 << (limit + 1)) - 1)).bit_length() - 1 if self.lengths & ((1 << (limit + 1)) - 1) else 0

    def smallest_above(self, limit: int) -> int:
        above = self.lengths >> (limit + 1)
        return (above & -above).bit_length() + limit if above else 0

    def fill(self, tier: int, longer_than: int) -> None:
        """Windows of ``tier`` opened by pieces of longer_than < n <= tier tokens, all filled exactly."""
        while (n := self.largest(tier)) > longer_than:
            window, gap = [self.take(n)], tier - n
            while gap:
                if n := self.largest(gap):
                    window.append(self.take(n))
                elif n := self.smallest_above(gap):
                    piece = self.take(n)
                    window.append(self.part(piece, 0, gap))
                    self.put(self.part(piece, gap, n))
                    n = gap
                else:  # nothing is left: these wait for the next batch
                    self.rest = window
                    return
                gap -= n
            self.emit(window, tier)

    def pack(self) -> None:
        """Pack all that waits; less than one window of each tier stays."""
        held = []
        for tier, below in zip(self.tiers, [*self.tiers[1:], 0], strict=True):
            self.rest = []
            self.fill(tier, below)
            held += self.rest
        for piece in held:
            self.put(piece)

    def finish(self) -> None:
        """The last pieces of a partition: windows at falling powers of two."""
        self.pack()
        left = [p for n in sorted(self.items, reverse=True) for p in self.items[n]]
        self.items, self.lengths = {}, 0
        total = sum(len(p[3]) for p in left)
        for bit in range(total.bit_length() - 1, -1, -1):
            tier = 1 << bit
            while total >= tier and total:
                size = min(tier, self.window)
                window, gap = [], size
                while gap:
                    piece = left.pop(0)
                    n = len(piece[3])
                    if n > gap:
                        left.insert(0, self.part(piece, gap, n))
                        piece, n = self.part(piece, 0, gap), gap
                    window.append(piece)
                    gap -= n
                self.emit(window, size)
                total -= size

    def emit(self, window: list[tuple], tier: int) -> None:
        stream = self.tiers.index(tier) if tier in self.tiers else len(self.tiers)
        ahead, sequence, offset = self.tokens[stream], (self.number << 33) + self.sequences, 0
        self.tokens[stream] += tier
        self.sequences += 1
        for doc_id, doc_tokens, start, ids in window:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, sequence, offset, tier, self.number, stream, ahead))
            offset += len(ids)

    def drained(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        columns = list(zip(*self.rows, strict=True))
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def packed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, window: int = WINDOW, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: which ids of which document lie where in which window."""
    path = vocabulary or vocabulary_path(PACKING_VOCABULARY)
    text_batches(df.sparkSession)
    if window & (window - 1) or any(t & (t - 1) for t in tiers) or tiers[0] != window:
        raise ValueError("tiers are powers of two, and the first is the window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_to_numpy
        packer = Packer(TaskContext.get().partitionId(), window, tiers)
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(body, allowed_special="all") if body else np.empty(0, "<u4"), TERMINATOR).astype("<u4", copy=False)
                packer.put((key, len(ids), 0, ids))
            packer.pack()
            if (out := packer.drained()) is not None:
                yield out
        packer.finish()
        if (out := packer.drained()) is not None:
            yield out

    pieces = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")).mapInArrow(run, _PACKED)
    pieces, _ = written(pieces, "packing-pieces")
    counts = pieces.groupBy("part", "stream").agg(F.max(F.col("ahead") + F.col("tier")).alias("tokens"))
    before = W.partitionBy("stream").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts, _ = written(counts.select("part", "stream", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before")), "packing-counts")
    few = counts.count() <= BROADCAST_COUNTS
    step = F.floor((F.col("before") + F.col("ahead")) / step_tokens) * (len(tiers) + 1) + F.col("stream")
    rows = pieces.join(F.broadcast(counts) if few else counts, ["part", "stream"]).withColumn("step_group", step.cast("long"))
    return rows.select(*(c.split()[0] for c in SCHEMA.split(", ")))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return packed(table(spark, sf_dir, "documents"))
