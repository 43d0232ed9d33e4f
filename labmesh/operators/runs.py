"""Consecutive violations of a freezer, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labmesh.operators.violations import THRESHOLD


def violation_runs(temperature_log: DataFrame, length: int, threshold: float = THRESHOLD) -> DataFrame:
    """Runs of at least ``length`` violating readings in a row, per freezer.

    A run ends at the first moment with a reading below the threshold. Readings
    of one moment belong together: any of them below the threshold ends the run.

    A run is identified by the number of breaking moments before it. That number
    is summed in two steps, over the minutes of a freezer and over the moments
    of a minute, so that neither window holds all readings of a busy freezer.
    """
    moments = (
        temperature_log.groupBy("FreezerID", "ReadingTime")
        .agg(
            F.count("*").alias("readings"),
            F.min("ReadingValue").alias("lowest"),
            F.max("ReadingValue").alias("highest"),
        )
        .withColumn("breaks", (F.col("lowest") < F.lit(threshold)).cast("int"))
        .withColumn("minute", F.date_trunc("minute", "ReadingTime"))
    )
    up_to = Window.partitionBy("FreezerID").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = (
        moments.groupBy("FreezerID", "minute")
        .agg(F.sum("breaks").alias("b"))
        .select("FreezerID", "minute", F.coalesce(F.sum("b").over(up_to), F.lit(0)).alias("earlier"))
    )
    within = Window.partitionBy("FreezerID", "minute").orderBy("ReadingTime").rowsBetween(Window.unboundedPreceding, 0)
    return (
        moments.withColumn("so_far", F.sum("breaks").over(within))
        .where(F.col("breaks") == 0)
        .join(minutes, ["FreezerID", "minute"])
        .groupBy("FreezerID", (F.col("so_far") + F.col("earlier")).alias("run"))
        .agg(
            F.sum("readings").alias("Readings"),
            F.min("ReadingTime").alias("RunStart"),
            F.max("ReadingTime").alias("RunEnd"),
            F.max("highest").alias("PeakValue"),
        )
        .where(F.col("Readings") >= length)
        .drop("run")
    )


def window_states(readings: DataFrame, window: str, threshold: float = THRESHOLD) -> DataFrame:
    """Per freezer and tumbling window: peak, and whether every reading violates.

    Works on batch and streaming input alike.
    """
    return (
        readings.groupBy("FreezerID", F.window("ReadingTime", window).alias("w"))
        .agg(F.max("ReadingValue").alias("PeakValue"), F.min("ReadingValue").alias("__low"))
        .select(
            "FreezerID",
            F.col("w.start").alias("WindowStart"),
            F.col("w.end").alias("WindowEnd"),
            "PeakValue",
            (F.col("__low") >= F.lit(threshold)).alias("Violating"),
        )
    )


def window_alarms(states: DataFrame, length: int) -> DataFrame:
    """One row per run of ``length`` violating windows in a row, per freezer.

    The row belongs to the window that completes the run. Windows without
    readings are not part of the sequence. A freezer has one row per window, so
    its sequence is bounded by the time span.
    """
    ordered = Window.partitionBy("FreezerID").orderBy("WindowStart")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    runs = states.withColumn("run", F.sum((~F.col("Violating")).cast("int")).over(upto)).where("Violating")
    inside = Window.partitionBy("FreezerID", "run").orderBy("WindowStart")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        runs.withColumn("pos", F.row_number().over(inside))
        .withColumn("FirstWindow", F.min("WindowStart").over(so_far))
        .withColumn("Peak", F.max("PeakValue").over(so_far))
        .where(F.col("pos") == length)
        .select("FreezerID", "FirstWindow", F.col("WindowStart").alias("AlarmWindow"), F.col("Peak").alias("PeakValue"))
    )
