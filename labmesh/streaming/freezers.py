"""Freezer monitors. Input columns: LogID, FreezerID, ReadingTime, ReadingValue.

``ReadingTime`` must be a TIMESTAMP. All results are emitted once, after the
watermark has passed their window. Readings later than ``late`` are dropped.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labmesh.operators.runs import window_states
from labmesh.operators.violations import THRESHOLD, is_violation
from labmesh.streaming.run import read_folder

LATE = "10 minutes"


def violation_windows(
    readings: DataFrame, window: str = "1 hour", threshold: float = THRESHOLD, late: str = LATE
) -> DataFrame:
    """Per freezer and tumbling window: violations, peak, first and last.

    Readings without a violation stay in the stream: they move the watermark on.
    """
    bad = is_violation(threshold)
    return (
        readings.withWatermark("ReadingTime", late)
        .groupBy("FreezerID", F.window("ReadingTime", window).alias("w"))
        .agg(
            F.max(F.when(bad, F.col("ReadingValue"))).alias("MaxViolationTemp"),
            F.min(F.when(bad, F.col("ReadingTime"))).alias("FirstViolation"),
            F.max(F.when(bad, F.col("ReadingTime"))).alias("LastViolation"),
            F.count(F.when(bad, 1)).alias("ViolationCount"),
        )
        .where(F.col("ViolationCount") > 0)
        .select(
            "FreezerID",
            F.col("w.start").alias("WindowStart"),
            F.col("w.end").alias("WindowEnd"),
            "MaxViolationTemp",
            "FirstViolation",
            "LastViolation",
            "ViolationCount",
        )
    )


def sliding_stats(readings: DataFrame, window: str = "6 hours", slide: str = "1 hour", late: str = LATE) -> DataFrame:
    """Per freezer and sliding window: readings, mean and deviation."""
    return (
        readings.withWatermark("ReadingTime", late)
        .groupBy("FreezerID", F.window("ReadingTime", window, slide).alias("w"))
        .agg(
            F.count("*").alias("Readings"),
            F.avg("ReadingValue").alias("MeanValue"),
            F.stddev_samp("ReadingValue").alias("Deviation"),
        )
        .select(
            "FreezerID",
            F.col("w.start").alias("WindowStart"),
            F.col("w.end").alias("WindowEnd"),
            "Readings",
            "MeanValue",
            "Deviation",
        )
    )


def distinct_readings(readings: DataFrame, late: str = LATE) -> DataFrame:
    """One row per LogID, however often the log delivers it.

    The first delivery passes at once and whole; later ones with the same LogID
    are dropped, whatever they hold, as long as they are not later than ``late``.
    """
    kept = readings.withWatermark("ReadingTime", late).dropDuplicatesWithinWatermark(["LogID"])
    return kept.select("LogID", "FreezerID", "ReadingTime", "ReadingValue")


def with_freezer(readings: DataFrame, freezer: DataFrame) -> DataFrame:
    """All readings, with the columns of a static table of one row per freezer.

    A reading of an unknown freezer stays, with NULL in those columns. A batch is
    as large as its trigger allows, so its rows are joined as they come; the table
    is neither repeated nor salted.
    """
    return readings.join(freezer, "FreezerID", "left")


def states_stream(
    readings: DataFrame, window: str = "1 hour", threshold: float = THRESHOLD, late: str = LATE
) -> DataFrame:
    """Closed windows per freezer with their violation state."""
    return window_states(readings.withWatermark("ReadingTime", late), window, threshold)


ALARM_SCHEMA = "FreezerID {id}, FirstWindow timestamp, AlarmWindow timestamp, PeakValue double"
RUN_STATE = "length long, first timestamp, peak double"
# Typed values for the state of a freezer without a run; NULL has no type in Arrow.
NO_RUN = (0, datetime(1970, 1, 1), 0.0)


def alarms(states_path: str, like: DataFrame, length: int) -> DataFrame:
    """One row when a freezer completes ``length`` violating windows in a row.

    Reads the table that ``states_stream`` writes, as a stream. ``like`` is that
    stream or table. A freezer contributes one row per window, so the function
    sees a short sequence even for a sensor that reports most of the readings.
    Windows arrive in time order across batches because a window is written when
    the watermark passes its end.
    """
    id_type = like.schema["FreezerID"].dataType.simpleString()

    def advance(key, batches, state):
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values("WindowStart")
        run, first, peak = state.get if state.exists else NO_RUN
        found = []
        for start, value, bad in zip(rows["WindowStart"], rows["PeakValue"], rows["Violating"]):
            if not bad:
                run, first, peak = NO_RUN
                continue
            run += 1
            first = start if run == 1 else first
            peak = float(value) if run == 1 else max(peak, float(value))
            if run == length:
                found.append((key[0], first, start, peak))
        state.update((run, first, peak))
        if found:
            yield pd.DataFrame(found, columns=["FreezerID", "FirstWindow", "AlarmWindow", "PeakValue"])

    states = read_folder(like.sparkSession, states_path, like.schema)
    return states.groupBy("FreezerID").applyInPandasWithState(
        advance, ALARM_SCHEMA.format(id=id_type), RUN_STATE, "append", "NoTimeout"
    )
