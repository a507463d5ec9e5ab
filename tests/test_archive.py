"""An archive kept up to date by batches in any order, restarts, natural keys and notes after a rebuild."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.sources.storage import new_folder
from tidemark.streaming import archive

NAMES = ["source_id", "from_id", "to_id", "from_at", "observed_at", "before_state", "after_state", "next_state", "next_confidence"]


def observations(spark, rows):
    full = [(s, i, datetime(2024, 1, 1) + timedelta(hours=h), state, state, "live", "high" if i % 3 else "low") for s, i, h, state in rows]
    return spark.createDataFrame(full, archive.OBSERVATION)


def scratch(spark, rows):
    return sorted(map(tuple, archive.with_times(observations(spark, rows)).select(*NAMES).collect()), key=str)


def kept(spark, folder):
    return sorted(map(tuple, archive.current_pairs(spark, folder).select(*NAMES).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_out_of_order_equal_scratch(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 3), i, rng.randint(0, 40), rng.choice("ABC")) for i in range(60)]
    folder = new_folder(spark, "test-archive")
    for batch in range(4):
        archive.apply_batch(observations(spark, rows[15 * batch : 15 * batch + 15] + rows[:2]), batch, folder)  # two rows come again
        assert kept(spark, folder) == scratch(spark, rows[: 15 * batch + 15])
    archive.apply_batch(observations(spark, rows[45:]), 3, folder)  # the last batch is run again
    assert kept(spark, folder) == scratch(spark, rows)


def test_late_rows_split_and_extend_runs(spark):
    folder = new_folder(spark, "test-archive")
    seen = []
    for batch, rows in enumerate([[(1, 1, 0, "A"), (1, 2, 10, "A"), (1, 3, 20, "B")], [(1, 4, 5, "C")], [(1, 5, 21, "B")], [(1, 6, 1, "C")], [(1, 7, -5, "B")], [(2, 8, 0, "A")], []]):
        archive.apply_batch(observations(spark, rows), batch, folder)
        seen += rows
        assert kept(spark, folder) == scratch(spark, seen)
    # In-order rows reach no further back than the last run.
    cuts = spark.read.schema(f"{archive.CUT}, batch long").parquet(f"{folder}/cuts").where("batch = 2").collect()
    assert [c["cut_id"] for c in cuts] == [3]


def test_a_stream_goes_on_from_its_checkpoint(spark):
    rows = [(1, i, (7 * i) % 24, "AB"[i % 5 > 2]) for i in range(24)]
    folder = new_folder(spark, "test-archive")
    for part in range(3):
        observations(spark, rows[8 * part : 8 * part + 8]).coalesce(1).write.mode("append").parquet(f"{folder}/input")
        if part != 1:  # the second and third part are read after a restart
            stream = spark.readStream.schema(archive.OBSERVATION).option("maxFilesPerTrigger", 1).parquet(f"{folder}/input")
            archive.maintained(stream, folder)
    assert kept(spark, folder) == scratch(spark, rows)
    assert spark.read.schema("batch long").parquet(f"{folder}/observations").select("batch").distinct().count() == 3
    archive.maintained(stream, folder)  # nothing new: nothing changes
    assert kept(spark, folder) == scratch(spark, rows)


def test_first_emission_wins(spark):
    stored = spark.createDataFrame([(1, "a", 5)], "source long, path string, value int")
    found = spark.createDataFrame([(1, "a", 9), (1, "b", 7), (1, "b", 3)], "source long, path string, value int")
    assert [tuple(r) for r in archive.first_emissions(stored, found, ["source", "path"]).collect()] == [(1, "b", 3)]


def test_notes_after_a_rebuild(spark):
    changes = spark.createDataFrame([(10, 1, "p", "t"), (11, 1, "p", "t"), (12, 1, "q", "t")], "change_id long, source_id long, json_path string, observed_at string")
    notes = [("a", 1, "p", "t", 1), ("b", 1, "p", "t", 1), ("c", 1, "p", "t", 2), ("d", 1, "q", "t", 1), ("e", 1, "gone", "t", 1), ("f", 2, "p", "t", 1)]
    found = archive.relinked(spark.createDataFrame(notes, "note_id string, source_id long, json_path string, observed_at string, version int"), changes)
    assert {r["note_id"]: (r["change_id"], r["fate"]) for r in found.collect()} == {
        "a": (10, "relinked"), "b": (None, "redundant"), "c": (10, "relinked"), "d": (12, "relinked"), "e": (None, "orphaned"), "f": (None, "orphaned"),
    }
