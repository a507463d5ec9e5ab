"""Work that is heavy for each row is dealt to tasks by rows: a small file is not one task."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import documents
from tidemark.plans import lenses, streams
from tidemark.sources import storage

SF = "/root/testdata/sf0.001"


@pytest.fixture
def few_rows(monkeypatch):
    """Fifty rows a task."""
    monkeypatch.setattr(storage, "TASK_ROWS", 50)


def tasks_of(spark, name):
    return entry.queries()[name](spark, SF).rdd.getNumPartitions()


def test_rows_make_the_number_of_tasks(spark):
    assert [storage.tasks_for(n, 10) for n in (0, 1, 10, 11, 1000)] == [1, 1, 1, 2, 100]


@pytest.mark.parametrize("name", ["html_normalize_closed_form", "densest_window", "candidate_score", "canary_pick"])
def test_pages_of_a_small_file_are_dealt_by_rows(spark, few_rows, name):
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    assert tasks_of(spark, name) == storage.tasks_for(n, 50) > 1


def test_documents_of_a_small_file_are_dealt_by_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(storage, "tasks_for", lambda rows, each=None: seen.append((rows, each)) or 3)
    assert tasks_of(spark, "schema_valid_rows") == 3
    assert seen == [(spark.read.parquet(f"{SF}/events.parquet").count(), 100_000)]


def test_a_document_is_parsed_once(spark):
    found = spark.range(1).select(documents.schema_violations(F.col("id").cast("string")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1, plan.count("parseJson")


def test_pairs_of_orders_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(lenses, "SORTED_ROWS", 1000)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert tasks_of(spark, "tier_match_exact_norm_positional") == storage.tasks_for(2 * n, 1000) > 4


def test_a_batch_of_an_archive_has_many_files(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 50, raising=False)
    folder = streams._maintained(spark, SF)
    batches = spark.read.schema("batch long").parquet(f"{folder}/observations").select("batch").distinct().count()
    assert len(spark.read.parquet(f"{folder}/input").inputFiles()) > 2 * batches == 2 * streams.BATCHES


def test_a_slice_of_time_has_many_files(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 5, raising=False)
    folders = []
    monkeypatch.setattr(streams, "new_folder", lambda *a: folders.append(storage.new_folder(*a)) or folders[-1])
    entry.queries()["absence_alerts"](spark, SF)
    assert len(spark.read.parquet(f"{folders[0]}/input").inputFiles()) > 2 * streams.SLICES
