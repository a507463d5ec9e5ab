"""Stages of the corpus pipeline: quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the
columns of ``docs`` (the last one returns packed pieces). Stages that drop rows tell them apart by id and
text: rows with another text under the same id, or without an id, are documents of their own.

Defined results: a null text counts as empty; rows that repeat id and text are one document of
near_dedup, of which one row stays; of a group the smallest id that only one text has stays, else the row
of one of the others; an empty table gives no rows; columns may have any other names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing, pii, quality, simhash
from .common import drop_now, recorded, table, written

#: Ids to drop are broadcast up to this number (16 bytes each), and joined by a shuffle beyond it.
BROADCAST_IDS = 2_000_000


def small(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it is small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    while name in docs.columns:
        name += "_"
    return name


def named(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the long column ``name``, equal in two rows only if id and text are: the id, where it is
    one text's, and else a number beyond all ids (below them, should they reach the end of the range)."""
    own = docs["doc_id"].cast("long")
    ids = docs.select(own.alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    many, _ = written(ids.where("n > 1 and doc_id is not null").select("doc_id"), "rows-repeated")
    rows = docs.withColumn(name, own)
    without_id = docs.where("doc_id is null").head(1)
    if not without_id and not many.head(1):
        return rows
    mark, count = free_name(rows, "_digest"), free_name(rows, "_number")
    digest = F.unhex(F.md5(F.concat(F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit(":"), F.coalesce(docs["text"], F.lit("")))))
    rows = rows.withColumn(mark, digest)
    odd = rows.join(small(many).withColumnRenamed("doc_id", name), name, "left_semi").unionByName(rows.where(F.col(name).isNull()))
    lowest, highest = docs.agg(F.min(own), F.max(own)).head()
    number = F.monotonically_increasing_id()
    number = number + ((highest or 0) + 1) if (highest or 0) < (1 << 63) - (1 << 56) else (lowest - 1) - number
    numbers, _ = written(odd.select(mark).distinct().withColumn(count, number), "rows-numbered")
    return rows.join(small(numbers), mark, "left").withColumn(name, F.coalesce(count, name)).select(*docs.columns, name)


def without(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` without those whose ``name`` is among the doc_id of ``ids``."""
    ids, _ = written(ids.select(F.col("doc_id").alias(name)).distinct(), "dropped-ids")
    return rows.join(small(ids), name, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is like that of trusted ones in their language."""
    name = free_name(docs, "_row")
    rows = named(docs, name)
    verdicts = quality.judged(rows, table(spark, sf_dir, "labels"), row=name)
    return without(rows, verdicts.where(~F.col("keep")), name).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    name = free_name(docs, "_row")
    rows = named(docs, name)
    groups = simhash.similar(rows, doc_id=name)
    kept = without(rows, groups.where("doc_id <> component_id"), name)
    repeated, _ = written(groups.groupBy("doc_id").count().where(F.col("count") > 1).select(F.col("doc_id").alias(name)), "repeated-rows")
    if not repeated.head(1):
        return kept.select(*docs.columns)
    once = kept.join(small(repeated), name, "left_semi").dropDuplicates([name])
    return kept.join(small(repeated), name, "left_anti").unionByName(once).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in training windows, one row per piece."""
    return packing.packed(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage has written goes as soon as its own result is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with recorded() as paths:
            docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        for old in {*paths, last} - {path, None}:
            drop_now(spark, old)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
