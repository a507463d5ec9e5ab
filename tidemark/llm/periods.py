"""Runs: stretches of a text's words that repeat with a period, by Crochemore's partition refinement.

At level q the positions of a text fall into classes of equal factors of q words. Level q+1 splits
each class by the classes of the next positions, and for that only the smaller children of the classes split
last are looked at (the largest child keeps what it had, Hopcroft's rule), so each position is touched
O(log n) times. Neighbouring members of a class at distance q are squares of period q; as the
members between them would be squares of a shorter period, q is the smallest. Squares at consecutive
positions are one run.

Classes are held as in Hopcroft's algorithm: a class is a stretch of one array, its members in order of
position form a linked list. A batch of texts is refined at once, their positions apart. Positions whose neighbours on
both sides are further away than the longest period asked for, or whose class has fewer members than a run asked for
gives it (its exponent less one), can be in no run and leave their class, and so do, level by level, the
positions before them.

Defined results: a null or empty text has no words and no runs; texts are taken whole, whatever their length; repeated
rows and null ids each give a row; an empty table gives none; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches

MIN_LENGTH, MIN_EXPONENT = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are refined together (at least one text).
BATCH_BYTES = 8 << 20
#: Up to this level all gaps are read again; from here on only those that change.
SCANNED = 8
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


class Refinement:
    """Classes of equal factors of the positions of several sequences, level by level.

    ``word``: numbers of the words, the sequences one after the other with one empty place before each;
    ``most``: at each place the longest period that is asked for in its sequence;
    ``fewest``: the least members of a class that can belong to a run.
    """

    def __init__(self, word: np.ndarray, sequence: np.ndarray, most: np.ndarray, fewest: int):
        n = len(word)
        self.most, self.fewest = most, fewest
        self.level = 1
        self.next, self.back = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        self.cls, self.place = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        self.size = np.zeros(n + 1, np.int64)
        self.touched = np.zeros(n + 1, bool)
        used = np.flatnonzero(most > 0)
        order = used[np.lexsort((used, word[used], sequence[used]))]
        new = firsts(sequence[order], word[order])
        self.members = np.concatenate([order, np.zeros(n - len(order), np.int64)])
        self.place[order] = np.arange(len(order))
        begin = np.flatnonzero(new)
        self.size[begin] = np.diff(np.append(begin, len(order)))
        self.cls[order] = np.repeat(begin, self.size[begin])
        self._link(order, new)
        # All classes split those of the next level; and a place after each sequence has left.
        self.small = order
        self.left = np.flatnonzero((most > 0) & np.append(most[1:] == 0, True)) + 1
        self.lone = self._far(order)
        self.due: dict[int, list[np.ndarray]] | None = None

    def _link(self, rows: np.ndarray, new: np.ndarray) -> None:
        """Members of classes, in order, as lists."""
        joined = np.flatnonzero(~new[1:])
        self.next[rows], self.back[rows] = -1, -1
        self.next[rows[joined]], self.back[rows[joined + 1]] = rows[joined + 1], rows[joined]

    def _far(self, rows: np.ndarray) -> np.ndarray:
        """Those without a neighbour within the longest period, or in a class that is too small."""
        ahead, behind, most = self.next[rows], self.back[rows], self.most[rows]
        alone = ((ahead < 0) | (ahead - rows > most)) & ((behind < 0) | (rows - behind > most))
        return rows[alone | (self.size[self.cls[rows]] < self.fewest)]

    def _watch(self, rows: np.ndarray) -> None:
        """Remember gaps that may turn out to be squares of a later level."""
        gap = self.next[rows] - rows
        ok = (self.next[rows] >= 0) & (gap >= self.level) & (gap <= self.most[rows])
        rows, gap = rows[ok], gap[ok]
        if len(rows):
            order = np.argsort(gap, kind="stable")
            rows, gap = rows[order], gap[order]
            cuts = np.flatnonzero(firsts(gap))
            for g, some in zip(gap[cuts].tolist(), np.split(rows, cuts[1:]), strict=True):
                self.due.setdefault(g, []).append(some)

    def squares(self) -> np.ndarray:
        """Positions of squares whose period is the level, sorted."""
        if self.level < SCANNED:
            rows = np.flatnonzero(self.next >= 0)
            return rows[self.next[rows] - rows == self.level]
        if self.due is None:
            self.due = {}
            self._watch(np.flatnonzero(self.next >= 0))
        some = self.due.pop(self.level, None)
        if some is None:
            return np.empty(0, np.int64)
        rows = np.unique(np.concatenate(some))
        return rows[self.next[rows] - rows == self.level]

    def active(self) -> bool:
        return len(self.small) + len(self.left) + len(self.lone) > 0 or bool(self.due)

    def refine(self) -> None:
        """From factors of ``level`` words to one word more."""
        self.level += 1
        # Leaving: those before places that have left, and those found too far from others.
        gone = self.left - 1
        gone = np.concatenate([gone[self.cls[gone] >= 0], self.lone[self.cls[self.lone] >= 0]])
        if len(self.lone) and len(gone):
            gone = np.unique(gone)
        moved = self.small - 1
        kind = self.cls[self.small]
        self.touched[gone] = True
        ok = (kind >= 0) & (self.cls[moved] >= 0) & ~self.touched[moved]
        moved, kind = moved[ok], kind[ok]
        n, k = len(moved), len(gone)
        if not n + k:
            self.small, self.left, self.lone = moved, gone, gone
            return
        rows = np.concatenate([moved, gone])
        part = np.concatenate([kind, np.full(k, len(self.cls))])  # the leaving ones come last
        order = np.lexsort((rows, part, self.cls[rows]))
        rows, part = rows[order], part[order]
        own = self.cls[rows]
        self.touched[moved] = True
        # Lists: what stays closes ranks over each chain of touched members.
        ahead, behind = self.next[rows], self.back[rows]
        heads, tails = rows[~self.touched[behind] | (behind < 0)], rows[~self.touched[ahead] | (ahead < 0)]
        if len(heads) > 1:
            heads, tails = heads[np.lexsort((heads, self.cls[heads]))], tails[np.lexsort((tails, self.cls[tails]))]
        a, b = self.back[heads], self.next[tails]
        self.next[a[a >= 0]], self.back[b[b >= 0]] = b[a >= 0], a[b >= 0]
        # Stretches: touched members move to the end of theirs, in the order of their new classes.
        parents = np.flatnonzero(firsts(own))
        parent, counts = own[parents], np.diff(np.append(parents, len(own)))
        rest = self.size[parent] - counts
        slots = ranges(parent + rest, counts)
        there = self.members[slots]
        stay = there[~self.touched[there]]
        holes = self.place[rows]
        holes = holes[holes < np.repeat(parent + rest, counts)]
        self.members[holes], self.place[stay] = stay, holes
        self.members[slots], self.place[rows] = rows, slots
        # New classes are named by the slot that they begin at.
        new = firsts(own, part)
        begin = np.flatnonzero(new)
        sizes, leaving = np.diff(np.append(begin, len(rows))), part[begin] == len(self.cls)
        names = slots[begin]
        self.size[parent] = rest
        self.size[names[~leaving]] = sizes[~leaving]
        self.cls[rows] = np.repeat(np.where(leaving, -1, names), sizes)
        self._link(rows, new)
        if k:
            off = rows[part == len(self.cls)]
            self.next[off], self.back[off] = -1, -1
        self.touched[rows] = False
        # The next level looks at all children but the largest of each parent.
        child = names[~leaving]
        of = np.repeat(np.arange(len(parent)), np.add.reduceat(new, parents) if len(parents) else 0)[~leaving]
        child_size = sizes[~leaving]
        remains = np.flatnonzero(rest > 0)
        child, of, child_size = np.concatenate([child, parent[remains]]), np.concatenate([of, remains]), np.concatenate([child_size, rest[remains]])
        by_size = np.lexsort((-child_size, of))
        child, of, child_size = child[by_size], of[by_size], child_size[by_size]
        smaller = ~firsts(of)
        self.small = self.members[ranges(child[smaller], child_size[smaller])] if smaller.any() else np.empty(0, np.int64)
        self.left = gone
        stayed = rows[part < len(self.cls)] if k else rows
        changed = np.concatenate([stayed, a[a >= 0], b[b >= 0]])
        changed = changed[self.cls[changed] >= 0]
        self.lone = self._far(changed)
        if len(self.lone):
            self.lone = np.unique(self.lone)
        if self.due is not None:
            self._watch(changed)


def runs_of(words: list[np.ndarray], min_length: int, min_exponent: int) -> np.ndarray:
    """(sequence, start, length, period) of the runs of each sequence of word numbers, sorted."""
    sizes = np.array([len(w) for w in words], np.int64)
    begins = np.cumsum(sizes + 1) - sizes  # an empty place before each
    n = int(sizes.sum() + len(sizes)) + 1
    word, sequence, most = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    at = ranges(begins, sizes)
    word[at] = np.concatenate([np.empty(0, np.int64), *words])
    sequence[at] = np.repeat(np.arange(len(sizes)), sizes)
    most[at] = np.repeat(np.where(sizes >= min_length, sizes // min_exponent, 0), sizes)
    classes, found, longest = Refinement(word, sequence, most, min_exponent - 1), [], int(most.max())
    while classes.level <= longest:
        q, rows = classes.level, classes.squares()
        if len(rows) and len(rows) + 2 * q > max(min_length, min_exponent * q) - 1:
            cuts = np.flatnonzero(np.diff(rows) != 1) + 1
            starts, ends = rows[np.concatenate([[0], cuts])], rows[np.concatenate([cuts - 1, [len(rows) - 1]])]
            lengths = ends - starts + 2 * q
            ok = lengths >= max(min_length, min_exponent * q)
            found.append(np.stack([sequence[starts[ok]], starts[ok], lengths[ok], np.full(ok.sum(), q)], axis=1))
        if not classes.active():
            break
        classes.refine()
    out = np.concatenate([np.empty((0, 4), np.int64), *found])
    out[:, 1] -= begins[out[:, 0]]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def numbered_words(texts: list[str | None]) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """The words of each text, and their numbers."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]  # of bytes: at the six white-space characters alone
    numbers = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    return words, np.split(numbers, np.cumsum([len(w) for w in words])[:-1])


def _found(min_length: int, min_exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            begin, held = 0, 0
            for end, text in enumerate(texts, 1):
                held += len(text or "")
                if held >= BATCH_BYTES or end == len(texts):
                    yield one(keys.slice(begin, end - begin), texts[begin:end])
                    begin, held = end, 0

    def one(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        words, numbers = numbered_words(texts)
        found = runs_of(numbers, min_length, min_exponent)
        edges = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
        kept = []
        for own, a, b in zip(words, edges[:-1], edges[1:], strict=True):
            if a < b:
                drop = np.zeros(len(own) + 1, np.int64)
                np.add.at(drop, found[a:b, 1] + found[a:b, 3], 1)
                np.add.at(drop, found[a:b, 1] + found[a:b, 2], -1)
                own = [own[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
            kept.append(b" ".join(own))
        runs = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), runs)
        return pa.RecordBatch.from_arrays([keys, pa.array([len(w) for w in words], pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length and period, by start and then period) and collapsed (the text without what a run repeats)
    of every document. A run has at least ``min_length`` words and ``min_exponent`` periods."""
    text_batches(df.sparkSession)
    rows = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    return rows.mapInArrow(_found(min_length, min_exponent), f"doc_id long, n_words long, runs {RUN}, collapsed string")


def longest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equals."""
    more = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    return F.when(F.size(runs) > 0, F.reduce(runs, F.get(runs, F.lit(0)), more))


def with_repeats(text: Column, doc_id: Column) -> Column:
    """The text; or, for one id in ten, with its tail made periodic: the cases that the query plants."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    g = F.floor(h / 10)

    def tiled(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i).cast("int"))), " ")).otherwise("")

    # The words are the variable of an outer function, as an inner one would find them again at each step.
    own = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"))), tiled), F.lit(0))
    return F.when(h % 10 == 0, own).otherwise(text)


def op12_periods(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic(docs.withColumn("text", with_repeats(F.col("text"), F.col("doc_id")))).withColumn("best", longest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
