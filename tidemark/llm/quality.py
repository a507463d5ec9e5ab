"""Quality by an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is one of characters, four at a time, for each language. Trusted documents are those
labelled good and not toxic; all of them are counted. The four orders' counts, continuation
counts and discounts are aggregations of one count table. Every distinct four-gram of the corpus is
scored once by joins with those tables, sharded by n-gram; the scores go back to the chunks
of documents that hold them, and give each document's perplexity. A document is
rejected if its perplexity lies outside the quantiles of its language over trusted documents of
its band of lengths (means over few characters vary more), widened by a margin so that documents
like the trusted ones stay.

Verdicts come from two models a language: documents fall into two folds by a hash of their id, and
each one, trusted or not, is scored by the counts of the fold that it is not in. So no document
is measured by its own text, and the quantiles of trusted documents hold for unseen ones too.
A band with fewer than ``BAND_ROWS`` trusted documents takes, as distances from the median of its language,
the quantiles of that band over all languages; with too few there as well, the wider of these and
those of all bands.

Log-probabilities are rounded to whole steps of 2^-32, so that sums are the same however the rows are dealt;
a text's sum fits 64 bits up to some 80 million characters of the least likely kind.

Chunks of documents are bounded by their text and written once, compressed; no text is
shuffled uncompressed, and no model is broadcast or held by the driver.

Defined results: a null or empty text has no perplexity and is kept, as is any text in a
language whose other fold has no trusted text (a null language is one of its own); repeated rows are scored
alike; a null id is never trusted; with no labels nothing is rejected; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import pack, unpack
from .common import Scratch, bucketed, frugal, text_batches, written

ORDER = 4
CHUNK_CHARS = 8 << 20
#: Trusted ids are broadcast up to this number (16 bytes each), and joined by a shuffle beyond it.
BROADCAST_IDS = 2_000_000
LOW, HIGH = 0.002, 0.996
#: Log-probabilities are whole numbers of this step, so that sums and quantiles are the same
#: however the rows are dealt.
STEP = 2.0**-32
#: Folds by a hash of the id; a document is scored by the counts of the other folds.
FOLDS = 2
#: Fewer trusted documents than this give a band no quantiles of its own.
BAND_ROWS = 1000
#: Tables of the lower orders, which the alphabet bounds, are broadcast up to this number of rows.
BROADCAST_ROWS = 100_000
#: Bands of lengths start at so many characters.
BANDS = (64, 256)
#: Logarithms of perplexity may pass the quantiles by this much.
MARGIN = 0.02


def codes(text: str) -> np.ndarray:
    """16 bits for each character; 0 is left for the start of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = points > 0xFFFF
    if wide.any():
        points = np.where(wide, 0xD800 + (points & 0x7FF), points)
    return np.where(points == 0, 0xFFFF, points).astype(np.uint64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The four-grams that end at each character, and the number of characters of each text."""
    parts, sizes = [], []
    for text in texts:
        c = np.concatenate([np.zeros(ORDER - 1, np.uint64), codes(text)])
        key = c[ORDER - 1 :].copy()
        for back in range(1, ORDER):
            key |= c[ORDER - 1 - back : len(c) - back] << np.uint64(16 * back)
        parts.append(key)
        sizes.append(len(key))
    return np.concatenate([np.empty(0, np.uint64), *parts]), np.array(sizes, np.int64)


def slices(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts, cut wherever ``chars`` characters are reached."""
    begin, held = 0, 0
    for end, text in enumerate(texts, 1):
        held += len(text)
        if held >= chars or end == len(texts):
            yield texts[begin:end]
            begin, held = end, 0


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct four-grams and how often each occurs."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for some in slices(texts):
        own, n = np.unique(grams(some)[0], return_counts=True)
        keys, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
    return keys, counts


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one language and fold each, packed in bounded chunks."""
    number = TaskContext.get().partitionId() << 24
    open_: dict[tuple[str, int], list] = {}
    held = 0

    def close(of: tuple[str, int]) -> pa.RecordBatch:
        nonlocal number
        keys, texts, trusted, _ = open_.pop(of)
        blob = pack(doc_id=pa.array(keys, pa.int64()), text=pa.array(texts, pa.string()), trusted=pa.array(trusted, pa.bool_()), level=6)
        number += 1
        columns = {"chunk": pa.array([number - 1], pa.int64()), "lang": pa.array([of[0]], pa.string()), "fold": pa.array([of[1]], pa.int32()), "docs": pa.array([blob], pa.binary())}
        return pa.RecordBatch.from_pydict(columns)

    for batch in batches:
        for key, text, lang, fold, trusted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            of = (lang or "", fold)
            at = open_.setdefault(of, [[], [], [], 0])
            at[0].append(key)
            at[1].append(text or "")
            at[2].append(bool(trusted))
            at[3] += len(text or "")
            held += len(text or "")
            if at[3] >= CHUNK_CHARS:
                held -= at[3]
                yield close(of)
            elif held >= 2 * CHUNK_CHARS:  # many languages: the one with most text goes
                most = max(open_, key=lambda x: open_[x][3])
                held -= open_[most][3]
                yield close(most)
    for of in list(open_):
        yield close(of)


def _chunk_counts(trusted_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, fold, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs = unpack(blob)
                if trusted_only:
                    docs = docs.filter(docs.column(2))
                keys, counts = counted(docs.column(1).to_pylist())
                n = len(keys)
                one = {"chunk": np.full(n, chunk), "lang": pa.array([lang]).take(pa.array(np.zeros(n, np.int8))), "fold": np.full(n, fold, np.int32)}
                yield pa.RecordBatch.from_pydict(one | {"gram": keys.view(np.int64), "n": counts.astype(np.int64)})

    return run


def _scored(docs: pa.Table, scores: pa.Table) -> pa.Table:
    order = np.argsort(scores["gram"].to_numpy().view(np.uint64))
    keys, logs = scores["gram"].to_numpy().view(np.uint64)[order], scores["logp"].to_numpy()[order]
    out = []
    for blob in docs["docs"].to_pylist():
        rows = unpack(blob)
        texts, sums, sizes = rows.column(1).to_pylist(), [], []
        for some in slices(texts):
            found, size = grams(some)
            p = logs[np.searchsorted(keys, found)] if len(keys) else np.zeros(len(found), np.int64)
            ends = np.concatenate([[0], np.cumsum(p)])[np.concatenate([[0], np.cumsum(size)])]
            sums.append(np.diff(ends))
            sizes.append(size)
        sums, sizes = np.concatenate([np.empty(0, np.int64), *sums]), np.concatenate([np.empty(0, np.int64), *sizes])
        mean = -sums / np.maximum(sizes, 1) * STEP
        unknown = (sizes == 0) | (len(keys) == 0)
        out.append(pa.table({"doc_id": rows.column(0), "lang": pa.array([docs["lang"][0].as_py()] * len(texts)), "trusted": rows.column(2), "n": pa.array(sizes), "surprisal": pa.array(mean, mask=unknown)}))
    pa.default_memory_pool().release_unused()
    return pa.concat_tables(out)


def _discounts(counts: DataFrame) -> DataFrame:
    """The three modified Kneser-Ney discounts of each language, from counts of counts."""
    n = counts.groupBy("lang").agg(*[F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    d = [F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5)))) for i in (1, 2, 3)]
    return n.select("lang", *[x.alias(f"d{i}") for i, x in zip((1, 2, 3), d, strict=True)])


def _order(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, own) and (lang, hist, gamma): the discounted share of a gram in its history,
    and the mass that the history leaves to the lower order."""
    found = counts.join(F.broadcast(_discounts(counts)), "lang").withColumn("hist", F.shiftrightunsigned("gram", 16))  # one row per language
    cuts = [F.least(F.col(f"d{i}"), F.lit(float(i))) for i in (1, 2, 3)]
    cut = F.when(F.col("c") >= 3, cuts[2]).when(F.col("c") == 2, cuts[1]).otherwise(cuts[0])
    # Whole numbers are summed: the result does not depend on the order of the rows.
    of = [F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.count_if(F.col("c") >= 3)]
    hist = found.groupBy("lang", "hist", "d1", "d2", "d3").agg(F.sum("c").cast("double").alias("total"), *(n.alias(f"k{i}") for i, n in zip((1, 2, 3), of, strict=True)))
    left = sum((F.col(f"k{i}") * c for i, c in zip((1, 2, 3), cuts, strict=True)), F.lit(0.0))
    total = F.sum("c").over(W.partitionBy("lang", "hist"))  # a history has at most one row for each character
    own = found.select("lang", "gram", ((F.col("c") - cut) / total).alias("own"))
    return own, hist.select("lang", "hist", (left / F.col("total")).alias("gamma"))


def scored_grams(counts: DataFrame, asked: DataFrame, use: Scratch) -> DataFrame:
    """lang, gram, logp (in steps) of every asked four-gram whose language has counts.

    ``lang`` names a model. The history of the first order is one key, that of the second a character: their
    tables, bounded by the alphabet, are broadcast while they are small, so that no key gathers the grams of a language.
    """
    mask = lambda order: F.col("gram").bitwiseAND(F.lit((1 << (16 * order)) - 1).cast("long"))
    orders = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: in how many contexts a gram is seen
        lower = orders[order + 1].select("lang", mask(order).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("c"))
        orders[order] = use.written(lower, "quality-counts")
    words = orders[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p"))  # one row per language
    rows = asked.join(F.broadcast(words), "lang")
    for order in range(1, ORDER + 1):
        own, hist = _order(orders[order])
        if order <= 2 and orders[order].count() <= BROADCAST_ROWS:
            own, hist = F.broadcast(own), F.broadcast(hist)  # a history for each row at most
        rows = rows.withColumn("_g", mask(order) if order < ORDER else F.col("gram")).withColumn("_h", F.shiftrightunsigned("_g", 16))
        rows = rows.join(own.select("lang", F.col("gram").alias("_g"), "own"), ["lang", "_g"], "left")
        rows = rows.join(hist.select("lang", F.col("hist").alias("_h"), "gamma"), ["lang", "_h"], "left")
        # An unseen history leaves all its mass to the lower order.
        rows = rows.select("lang", "gram", (F.coalesce("own", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("p")).alias("p"))
    return rows.select("lang", "gram", F.round(F.log("p") / STEP).cast("long").alias("logp"))


def perplexities(docs: DataFrame, labels: DataFrame, folds: int = 1, row: str = "doc_id") -> DataFrame:
    """doc_id, lang, trusted, n (characters), surprisal (mean negative log probability of a character) of each document.

    With more than one fold, a document is scored by the counts of the other folds. ``row`` names the
    long column whose values the result has as doc_id.
    """
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    with Scratch(spark) as use:
        good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(labels["doc_id"].cast("long").alias("doc_id"))
        good = good.join(labels.where("quality = 0 or toxic = 1").select("doc_id"), "doc_id", "left_anti").distinct().withColumn("trusted", F.lit(True))
        good = use.written(good, "quality-trusted")
        few = good.count() <= BROADCAST_IDS
        key = docs["doc_id"].cast("long")
        rows = docs.select(key.alias("doc_id"), docs[row].cast("long").alias("row"), docs["text"].alias("text"), docs["lang"].alias("lang"), F.pmod(F.xxhash64(key), F.lit(folds)).cast("int").alias("fold"))
        rows = rows.join(F.broadcast(good) if few else good, "doc_id", "left").select("row", "text", "lang", "fold", "trusted")
        # Many small partitions would make many small chunks, which repeat each other's grams; a task
        # with text for several chunks fills those of each language.
        chars = docs.agg(F.sum(F.char_length("text"))).head()[0] or 0
        rows = rows.coalesce(max(spark.sparkContext.defaultParallelism, -(-chars // (4 * folds * CHUNK_CHARS))))
        # Buckets by chunk: the texts lie where their scores will come, and are never shuffled.
        with bucketed(rows.mapInArrow(frugal(_chunked), "chunk long, lang string, fold int, docs binary"), "chunk", "quality_chunks") as chunks:
            chunk_schema = "chunk long, lang string, fold int, gram long, n long"
            model = lambda fold: F.concat("lang", F.lit("/"), fold.cast("string")).alias("lang")
            counts = chunks.mapInArrow(frugal(_chunk_counts(True)), chunk_schema).groupBy("lang", "fold", "gram").agg(F.sum("n").alias("c"))
            others = F.array(*map(F.lit, range(folds)))
            if folds > 1:
                others = F.array_remove(others, F.col("fold"))
            counts = counts.select("lang", "gram", "c", F.explode(others).alias("of")).groupBy(model(F.col("of")), "gram").agg(F.sum("c").alias("c"))
            counts = use.written(counts, "quality-counts")
            held = use.written(chunks.mapInArrow(frugal(_chunk_counts(False)), chunk_schema).select("chunk", model(F.col("fold")), "gram"), "quality-grams")
            scores = use.written(scored_grams(counts, held.select("lang", "gram").distinct(), use), "quality-scores")
            back = held.join(scores, ["lang", "gram"]).select("chunk", "gram", "logp")
            found = chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_scored, "doc_id long, lang string, trusted boolean, n long, surprisal double")
            return written(found, "quality-surprisal")[0]


def quantiles(rows: DataFrame, low: float, high: float) -> DataFrame:
    """lang, band, low, mid, high: exact quantiles and the median of the surprisals of trusted rows, in steps
    of a ten-thousandth; and the number of those rows."""
    step = F.floor(F.col("surprisal") * 10_000).cast("long")
    counts = rows.where("trusted and surprisal is not null").groupBy("lang", "band", step.alias("step")).agg(F.count("*").alias("n"))
    order = W.partitionBy("lang", "band").orderBy("step")  # surprisals of a character are under 50: at most so many thousand steps
    counts = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(W.partitionBy("lang", "band")))
    return counts.groupBy("lang", "band").agg(
        *[F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(q * F.col("all"))), F.col("step"))).cast("double").__truediv__(10_000).alias(n) for n, q in (("low", low), ("mid", 0.5), ("high", high))],
        F.max("all").alias("rows"),
    )


def judged(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, margin: float = MARGIN, row: str = "doc_id") -> DataFrame:
    """doc_id, lang, perplexity and keep of every document."""
    band = sum((F.when(F.col("n") >= b, 1).otherwise(0) for b in BANDS), F.lit(0))
    rows = perplexities(docs, labels, FOLDS, row).withColumn("band", band)
    # Tables of one row per language, or per language and band, written: the plans that use them stay small.
    of_band, _ = written(quantiles(rows, low, high).select("lang", "band", F.struct("low", "high", "rows").alias("own")), "quality-bands")
    of_lang, _ = written(quantiles(rows.withColumn("band", F.lit(0)), low, high).select("lang", "mid"), "quality-languages")
    rows = rows.join(F.broadcast(of_lang), "lang", "left")
    whole = -1  # all bands together
    apart = rows.select(F.lit("").alias("lang"), F.explode(F.array("band", F.lit(whole))).alias("band"), "trusted", (F.col("surprisal") - F.col("mid")).alias("surprisal"))
    pooled = {r["band"]: r for r in quantiles(apart, low, high).collect()}  # one row per band
    rows = rows.join(F.broadcast(of_band), ["lang", "band"], "left")

    def bound(name: str, wider: Callable) -> Column:
        near = F.lit(pooled[whole][name] if whole in pooled else None).cast("double")
        for b in set(pooled) - {whole}:
            enough = pooled[b]["rows"] >= BAND_ROWS
            near = F.when(F.col("band") == b, pooled[b][name] if enough else wider(pooled[b][name], pooled[whole][name])).otherwise(near)
        return F.when(F.col("own.rows") >= BAND_ROWS, F.col(f"own.{name}")).otherwise(F.col("mid") + near)

    inside = F.col("surprisal").between(bound("low", min) - margin, bound("high", max) + margin)
    return rows.select("doc_id", "lang", F.exp("surprisal").alias("perplexity"), F.coalesce(inside, F.lit(True)).alias("keep"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
