"""Rows of the published dataset: how long a tier held one state.

A tier is compared with the state that opened its run, not with the last one, and the comparison
forgives an unknown billing unit and a free tier whose annual price is 0 or unknown. So it is not
transitive, and the run of a row depends on the one before: a fold in order of time. Each task
streams rows in the order of their keys and holds one open run, however long a key is.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["source_id", "tier", "occurrence"]
ROWS = "source_id long, tier string, occurrence int, first_us long, last_us long, monthly double, annual double, billing_unit string, seats double, is_free boolean, is_enterprise boolean, provenance string"
_COLUMNS = [c.split()[0] for c in ROWS.split(", ")]
_READ = [*_COLUMNS, "run"]


#: A row of a tier, and the open run that it may belong to.
Tier = namedtuple("Tier", _READ)


def same_state(a: Tier, b: Tier) -> bool:
    """Whether a tier still holds the state that opened its run."""
    if (a.monthly, a.seats, a.is_free, a.is_enterprise) != (b.monthly, b.seats, b.is_free, b.is_enterprise):
        return False
    if a.billing_unit != b.billing_unit and "unknown" not in (a.billing_unit, b.billing_unit):
        return False
    free = a.monthly == 0 and a.annual in (None, 0) and b.annual in (None, 0)
    return a.annual == b.annual or free


def _rows(batch: pd.DataFrame) -> Iterator[Tier]:
    """The rows, read column by column; what is missing is None."""
    columns = [batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in _READ]
    return map(Tier._make, zip(*columns, strict=True))


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = opened = None  # the open run, and the row that opened it
    last = 0
    for batch in batches:
        done = []
        for row in _rows(batch):
            goes_on = held is not None and row[: len(KEY)] == held[: len(KEY)] and row.run == last + 1 and same_state(opened, row)
            if goes_on:
                annual = 0.0 if held.annual is None and row.annual == 0 else held.annual
                held = held._replace(last_us=row.last_us, annual=annual, provenance=held.provenance if row.provenance == held.provenance else "mixed")
            else:
                if held is not None:
                    done.append(held)
                held = opened = row
            last = row.run
        if done:
            yield pd.DataFrame(done)[_COLUMNS]
    if held is not None:
        yield pd.DataFrame([held])[_COLUMNS]


def dataset_runs(rows: DataFrame) -> DataFrame:
    """One row per run of a tier in one state. ``rows``: KEY, run, first_at, last_at, provenance and the state of each observation's tiers."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = rows.withColumns({"first_us": us("first_at"), "last_us": us("last_at")}).select(*_READ)
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "run").mapInPandas(_folded, ROWS)
