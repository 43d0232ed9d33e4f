"""Alarms on readings in a row, while they stream in.

The batch form is ``operators.runs.violation_runs``; both agree on the runs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labmesh.operators.violations import THRESHOLD
from labmesh.streaming.freezers import LATE
from labmesh.streaming.ordered import InOrder, codes, column, in_order, unpacked

RAISED, ENDED = "raised", "ended"


def _moments(rows: pa.Table) -> pa.Table:
    """One row per key and moment (a moment may have come in several batches)."""
    found = rows.group_by(["key", "time"]).aggregate([("readings", "sum"), ("lowest", "min"), ("highest", "max")])
    return found.select(["key", "time", "readings_sum", "lowest_min", "highest_max"]).rename_columns(
        ["key", "time", "readings", "lowest", "highest"]
    )


class ReadingRuns(InOrder):
    """Runs of violating readings of freezers.

    Waiting are the moments that have not passed, with their lowest and highest
    reading. Remembered is the open run of a freezer that has one.
    """

    waiting = pa.schema(
        {"key": pa.string(), "time": pa.int64(), "readings": pa.int64(), "lowest": pa.float64(), "highest": pa.float64()}
    )
    memory = pa.schema(
        {"key": pa.string(), "readings": pa.int64(), "first": pa.int64(), "last": pa.int64(), "peak": pa.float64()}
    )
    results = "key string, state string, first long, last long, readings long, peak double"

    def __init__(self, length: int, threshold: float, quiet: int | None):
        self.length, self.threshold, self.quiet = length, threshold, quiet

    def arrive(self, rows):
        known = rows.select(["key", "time", "value"]).drop_null()
        value = known.column("value")
        one = pa.array(np.ones(len(known), np.int64))
        return _moments(
            pa.table(
                {"key": known.column("key"), "time": known.column("time"), "readings": one, "lowest": value, "highest": value}
            )
        )

    def step(self, memory, ready, until):
        ready = _moments(ready)
        old = np.repeat([True, False], [len(memory), len(ready)])
        names = pa.concat_arrays([*memory.column("key").chunks, *ready.column("key").chunks, pa.array([], pa.string())])
        code = np.concatenate(codes(memory.column("key"), ready.column("key")))
        time = np.concatenate([column(memory, "last"), column(ready, "time")])
        first = np.concatenate([column(memory, "first"), column(ready, "time")])
        count = np.concatenate([column(memory, "readings"), column(ready, "readings")])
        # An open run goes before the readings of its freezer, like a moment that violates.
        low = np.concatenate([np.full(len(memory), np.inf), column(ready, "lowest")])
        high = np.concatenate([column(memory, "peak"), column(ready, "highest")])
        order = np.lexsort((time, ~old, code))
        code, time, first, count, low, high, old = (x[order] for x in (code, time, first, count, low, high, old))
        breaks = low < self.threshold
        other = np.append(True, code[1:] != code[:-1])[: len(code)]
        # A breaking moment is a stretch of its own.
        begins = other | breaks | np.append(True, breaks[:-1])[: len(code)]
        if self.quiet is not None:
            begins[1:] |= time[1:] - time[:-1] >= self.quiet
        starts = np.flatnonzero(begins)
        if not len(starts):
            return memory, self.memory.empty_table()
        ends = np.append(starts[1:], len(code)) - 1
        stretch = np.cumsum(begins) - 1
        total = np.add.reduceat(count, starts)
        peak = np.maximum.reduceat(high, starts)
        run = ~breaks[starts]
        long = run & (total >= self.length)

        upto = np.cumsum(count)
        so_far = upto - (upto - count)[starts][stretch]
        raised = np.flatnonzero(run[stretch] & ~old & (so_far >= self.length) & (so_far - count < self.length))
        spans = np.column_stack([starts[stretch[raised]], raised + 1]).ravel()
        peak_then = np.maximum.reduceat(np.append(high, -np.inf), spans)[::2] if len(raised) else high[:0]

        over = np.append(~other[starts[1:]], False)
        if self.quiet is not None:
            over |= until - time[ends] >= self.quiet
        ended, still = np.flatnonzero(long & over), np.flatnonzero(run & ~over)
        found = pa.table(
            {
                "key": names.take(pa.array(order[np.concatenate([raised, starts[ended]])])),
                "state": pa.array([RAISED] * len(raised) + [ENDED] * len(ended), pa.string()),
                "first": np.concatenate([first[starts[stretch[raised]]], first[starts[ended]]]),
                "last": np.concatenate([time[raised], time[ends[ended]]]),
                "readings": np.concatenate([so_far[raised], total[ended]]),
                "peak": np.concatenate([peak_then, peak[ended]]),
            }
        )
        held = pa.table(
            {
                "key": names.take(pa.array(order[starts[still]])),
                "readings": total[still],
                "first": first[starts[still]],
                "last": time[ends[still]],
                "peak": peak[still],
            }
        )
        return held.cast(self.memory), found

    def wake(self, memory):
        if self.quiet is None or not len(memory):
            return None
        return pc.min(memory.column("last")).as_py() + self.quiet


def reading_alarms(
    readings: DataFrame,
    length: int,
    threshold: float = THRESHOLD,
    late: str = LATE,
    quiet: str | None = None,
) -> DataFrame:
    """One row when ``length`` violating readings in a row are there, one when the run ends.

    A run ends at the first moment with a reading below the threshold, or when the
    freezer has been silent for ``quiet``; its row then has the whole run. Readings of
    one moment belong together. Those without a value are left out.

    Readings of a freezer pass through one task in order, so that a batch should hold
    no more of one freezer than a task can take; waiting are only those of the last
    ``late``, one row per moment.
    """
    span = None if quiet is None else int(pd.Timedelta(quiet) / pd.Timedelta(microseconds=1))
    stream = readings.withWatermark("ReadingTime", late).select(
        "FreezerID", "ReadingTime", F.col("ReadingValue").cast("double").alias("value")
    )
    found = in_order(stream, "FreezerID", "ReadingTime", ReadingRuns(length, float(threshold), span))
    return found.select(
        unpacked("key", readings, ["FreezerID"])["FreezerID"].alias("FreezerID"),
        F.col("state").alias("State"),
        F.timestamp_micros("first").alias("RunStart"),
        F.timestamp_micros("last").alias("RunEnd"),
        F.col("readings").alias("Readings"),
        F.col("peak").alias("PeakValue"),
    )
