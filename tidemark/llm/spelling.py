"""Spelling variants: words at one edit, found through bands of their letter-parity masks.

A mask has a bit for each letter (letters beyond a-z share 32), set if the letter occurs an odd
number of times. An inserted or deleted letter flips one bit, a replaced one at most two; so of three bands
of the bits one at least stays equal.

Bands of whole words would be too coarse: the words of a corpus outgrow the values of nine letters. So the
masks are those of halves. Of two words at one edit, the shorter one of L letters, either the first L // 2 letters
are the same or the last L - L // 2; the mask of that half is equal as a whole, that of the rest in one band.
Words meet under (L, half, its mask, band of the rest, its value): twelve keys a word, as it may be the shorter
one or the longer. That is the length filter too. Words that meet are compared letter by letter. Two words are
counted under the first of the keys that they share only.

Counts and the best neighbour of a word are aggregated where its pairs are found: no row per pair is written.
A group of over ``CELL_ROWS`` words is dealt to cells, each a pair of its parts.

Defined results: words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z alone; a null
text has none; a null id counts as an empty one; rows that repeat id and text count again; an empty table gives
no words; only the named columns are read; texts are read whole, and words may have any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_now, text_batches, written

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: One word of so many loses a letter: the slips that the query plants.
SLIPS = 31
#: Bytes of a run of A-Z, a-z and U+00C0 to U+00FF after lower-casing A-Z.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Words that a task counts before it passes them on, and pairs in one array.
HELD_WORDS = 500_000
PAIRS = 1 << 20
#: Rows under keys for each task, and words of a group that one cell compares at once, at most twice.
TASK_ROWS = 1_000_000
CELL_ROWS = 20_000
#: Large groups are broadcast up to this number, and joined by a shuffle beyond it.
BROADCAST_GROUPS = 100_000

BIT = np.array([1 << (b - 97 if 97 <= b <= 122 else 26 + b % 32) for b in range(256)], np.uint64)
BANDS = [np.uint64(sum(1 << b for b in range(band, 58, 3))) for band in range(3)]


def slipped(doc: bytes, run: bytes) -> bytes:
    """The run, without a letter if the checksum of ``doc:run`` says so."""
    h = zlib.crc32(doc + b":" + run)
    if h % SLIPS:
        return run
    letters = run.decode()
    cut = h % len(letters)
    return (letters[:cut] + letters[cut + 1 :]).encode()


def _counts(least: int, slips: bool):
    """(word, n) of batches of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc = b"" if key is None else b"%d" % key
                # A run of fewer bytes has fewer letters.
                own = Counter(w for w in RUN.findall((text or "").encode().lower()) if len(w) >= least)
                for word, n in own.items():
                    word = slipped(doc, word) if slips else word
                    if len(word) - word.count(b"\xc3") >= least:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield passed_on()
                    held.clear()
        if held:
            yield passed_on()

    return run


class Words:
    """Words as one array of letters (all letters are of Latin-1), and the masks of their parts."""

    def __init__(self, words: list[str]):
        self.coded = [w.encode("latin-1") for w in words]
        self.lengths = np.array([len(w) for w in self.coded], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(self.coded) + b"\0", np.uint8)
        self.upto = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(BIT[self.letters])])

    def order(self) -> np.ndarray:
        """The place of each word in the order of their letters."""
        out = np.empty(len(self.coded), np.int64)
        out[np.array(sorted(range(len(out)), key=self.coded.__getitem__), np.int64)] = np.arange(len(out))
        return out

    def masks(self, at: np.ndarray, extra: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The masks of the half that stays equal (the first one, or with ``tail`` the last) and of the rest, as a word
        with ``extra`` letters more than the shorter one of a pair."""
        begin, end = self.starts[at], self.starts[at] + self.lengths[at]
        short = self.lengths[at] - extra
        cut = np.where(tail, end - (short - short // 2), begin + short // 2)
        first, last = self.upto[begin] ^ self.upto[cut], self.upto[cut] ^ self.upto[end]
        return np.where(tail, last, first), np.where(tail, first, last)


def same_letters(words: Words, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many first (or last) letters two words share, up to ``most``."""
    at_a, at_b, step = words.starts[a], words.starts[b], 1
    if back:
        at_a, at_b, step = at_a + words.lengths[a] - 1, at_b + words.lengths[b] - 1, -1
    shared, todo, k = np.zeros(len(a), np.int64), np.flatnonzero(most > 0), 0
    while len(todo):
        equal = words.letters[at_a[todo] + step * k] == words.letters[at_b[todo] + step * k]
        todo = todo[equal]
        shared[todo] += 1
        k += 1
        todo = todo[most[todo] > k]
    return shared


def near(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two different words are one edit apart; their lengths differ by one at most."""
    short = np.minimum(words.lengths[a], words.lengths[b])
    first = same_letters(words, a, b, short, False)
    last = same_letters(words, a, b, short - first, True)
    return first + last >= np.where(words.lengths[a] == words.lengths[b], short - 1, short)


def pairs_of(groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions within groups (numbers, sorted), in bounded arrays."""
    ends = np.searchsorted(groups, groups, side="right")
    counts = ends - np.arange(len(groups)) - 1
    upto = np.cumsum(counts)
    begin = 0
    while begin < len(groups):
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + PAIRS, side="right")))
        rows, n = np.arange(begin, end), counts[begin:end]
        first = np.repeat(rows, n)
        yield first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        begin = end


def near_pairs(words: Words, at: np.ndarray, groups: np.ndarray, tags: np.ndarray, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near words within groups. ``at``: words, sorted by group; ``tags``: extra + 2 * tail + 4 * band of their keys.
    Words of one cell meet across its sides (-1: all meet)."""
    extra, tail, band = tags & 1, (tags >> 1 & 1).astype(bool), tags >> 2
    half, rest = words.masks(at, extra, tail)
    other, _ = words.masks(at, extra, ~tail)
    for i, j in pairs_of(groups):
        ok = (words.lengths[at[i]] - extra[i] == words.lengths[at[j]] - extra[j]) & (tags[i] >> 1 == tags[j] >> 1) & (extra[i] + extra[j] < 2)
        ok &= ((sides[i] < 0) | (sides[i] != sides[j])) & (half[i] == half[j])
        apart = rest[i] ^ rest[j]
        ok &= np.bitwise_count(apart) <= 2
        # The pair belongs to its first key: the first halves differ if this is a last one, and so do the bands before.
        ok &= ~tail[i] | (other[i] != other[j])
        for n, bits in enumerate(BANDS):
            ok &= np.where(n < band[i], (apart & bits) != 0, (n > band[i]) | ((apart & bits) == 0))
        a, b = at[i[ok]], at[j[ok]]
        found = near(words, a, b)
        yield a[found], b[found]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best_n, best) of the words that meet in a task. Rows: key, tag, cell, side, word, n."""
    held = [b for b in batches if b.num_rows]  # about TASK_ROWS
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    coded = rows["word"].chunk(0).dictionary_encode()
    texts = coded.dictionary
    words, at = Words(texts.to_pylist()), coded.indices.to_numpy().astype(np.int64)
    n = np.zeros(len(texts), np.int64)
    n[at] = rows["n"].to_numpy()
    key, cell = rows["key"].to_numpy(), rows["cell"].to_numpy()
    order = np.lexsort((cell, key))
    key, cell = key[order], cell[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
    found = list(near_pairs(words, at[order], np.cumsum(new), rows["tag"].to_numpy()[order], rows["side"].to_numpy()[order]))
    a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in ([y for p in found for y in p], [y for p in found for y in p[::-1]]))
    order = np.lexsort((words.order()[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
    counts = np.diff(np.append(first, len(a)))
    yield pa.RecordBatch.from_arrays(
        [texts.take(pa.array(a[first])), pa.array(counts), pa.array(n[b[first]]), texts.take(pa.array(b[first]))], ["word", "n_near", "best_n", "best"]
    )


def hashed(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of numbers."""
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out = (out ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word under its twelve keys."""
    for batch in batches:
        words, at = Words(batch["word"].to_pylist()), np.arange(batch.num_rows)
        for extra in range(2):
            for tail in range(2):
                half, rest = words.masks(at, np.int64(extra), np.bool_(tail))
                for band, bits in enumerate(BANDS):
                    key = hashed(words.lengths - extra, half, rest & bits, np.full(len(at), 2 * band + tail))
                    tag = np.full(len(at), extra + 2 * tail + 4 * band, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(tag), batch["word"], batch["n"]], ["key", "tag", "word", "n"])


def word_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_LENGTH, slips: bool = False) -> DataFrame:
    """word and n: how often each word of at least ``least`` letters occurs. With ``slips`` one run in SLIPS, by the checksum of id and
    run, has lost a letter first."""
    text_batches(df.sparkSession)
    rows = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    return rows.mapInArrow(_counts(least, slips), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def linked(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best of every word with a near one. ``words``: distinct words and n."""
    keyed = words.select("word", "n").mapInArrow(_keyed, "key long, tag int, word string, n long")
    sizes, _ = written(keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > CELL_ROWS), "spelling-large")
    count = sizes.count()
    rows = keyed.withColumns({"cell": F.lit(0), "side": F.lit(-1)})
    if count:
        rows = keyed.join(F.broadcast(sizes) if count <= BROADCAST_GROUPS else sizes, "key", "left").withColumn("_parts", F.ceil(F.coalesce("size", F.lit(1)) / CELL_ROWS).cast("int"))
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("word"), "_parts").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        low, high = F.least("_part", "_other"), F.greatest("_part", "_other")
        side = F.when(F.col("_part") == F.col("_other"), -1).otherwise((F.col("_part") > F.col("_other")).cast("int"))
        rows = rows.select("key", "tag", "word", "n", (low * F.col("_parts") + high).alias("cell"), side.alias("side"))
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-12 * words.count() // TASK_ROWS))
    found = rows.repartition(tasks, "key", "cell").mapInArrow(_links, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """word and root: where the forms (word, form) of a word end. Counts grow along them, so there are no circles."""
    now, path = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:  # each round doubles the steps
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        far = now.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        far, far_path = written(far, "spelling-roots")
        moved = far.where("moved").head(1)
        drop_now(forms.sparkSession, path)
        now, path = far.select("word", "root"), far_path
        if not moved:
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of distinct ``words`` (word, n): its form is its most frequent near word, if ``ratio`` times
    as frequent as itself."""
    words, _ = written(words, "spelling-words")
    links, _ = written(linked(words), "spelling-links")
    is_form = F.col("best_n") >= F.col("n") * ratio
    rows = words.join(links, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    rows, _ = written(rows, "spelling-forms")
    root = followed(rows.where("form is not null"))
    return rows.join(root, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    from .common import table

    counts = word_counts(table(spark, sf_dir, "documents"), slips=True)
    return variants(counts.where(F.col("n") >= MIN_COUNT)).select("word", "form", "root", "n", "n_near", "form_n")
