"""Sources that fall silent, raised by event-time timers.

The state of a source is its last observation and whether its silence has been raised. A timer stands at the
last observation plus the longest silence; the watermark passing it raises the alert, with no row of the source
needed. A gap that opens and ends inside one micro-batch is raised by the row that ends it. So each silence is raised
once, whatever the batches were, as long as rows come within the watermark's delay of their time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Hours after which a source is absent.
ABSENT_HOURS = 26
ALERT = "source_id long, last_us long, raised_us long"
STATE = "last_us long, raised boolean"


def _watch(silence_us: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, raised = state.get if state.exists else (None, False)
        alerts = []
        if state.hasTimedOut:
            alerts, raised = [last], True
        else:
            times = np.sort(np.concatenate([batch["at_us"].to_numpy() for batch in batches]))  # eight bytes a row
            for at in times.tolist():
                if last is not None and at <= last:
                    continue  # it moves nothing
                if last is not None and at - last > silence_us and not raised:
                    alerts.append(last)
                last, raised = at, False
        state.update((last, raised))
        if not raised:
            state.setTimeoutTimestamp(max((last + silence_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if alerts:
            yield pd.DataFrame({"source_id": key[0], "last_us": alerts, "raised_us": [a + silence_us for a in alerts]})

    return run


def absences(observations: DataFrame, delay: str, hours: int = ABSENT_HOURS) -> DataFrame:
    """An alert for each silence of over ``hours`` of a stream of source_id and at (a timestamp)."""
    rows = observations.withWatermark("at", delay).select("source_id", "at", F.unix_micros("at").alias("at_us"))
    return rows.groupBy("source_id").applyInPandasWithState(_watch(hours * 3_600_000_000), ALERT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
