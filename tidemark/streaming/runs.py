"""Runs of equal page states over a stream of observations, one state per source.

The state of a source is its last observation and the number of its run. A micro-batch is put in
event order; a row before the last observation that a source has seen is late: it is reported, and
leaves the state alone (a batch rebuild places it). The sink commits each batch once, so a restart
from the checkpoint repeats nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPENED = "source_id long, run long, first_id long, page_state string, late boolean"
STATE = "micros long, id long, page_state string, run long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["micros", "id"])
    micros, last_id, last, run = state.get if state.exists else (-1, -1, None, 0)
    late = (rows["micros"] < micros) | ((rows["micros"] == micros) & (rows["id"] <= last_id))
    again, rows = rows[late], rows[~late]
    out = [pd.DataFrame({"source_id": key[0], "run": run, "first_id": again["id"], "page_state": again["page_state"], "late": True})] if len(again) else []
    if len(rows):
        opens = rows["page_state"] != rows["page_state"].shift(fill_value=last)
        numbers = run + opens.cumsum()
        found = rows[opens]
        out.append(pd.DataFrame({"source_id": key[0], "run": numbers[opens], "first_id": found["id"], "page_state": found["page_state"], "late": False}))
        end = rows.iloc[-1]
        state.update((int(end["micros"]), int(end["id"]), str(end["page_state"]), int(numbers.iloc[-1])))
    if out:
        yield pd.concat(out)


def opened_runs(observations: DataFrame) -> DataFrame:
    """The first row of each run, and late rows, of a stream of source_id, id, micros and page_state."""
    return observations.groupBy("source_id").applyInPandasWithState(_advance, OPENED, STATE, "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives until its input ends, written once per batch into ``folder``."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
