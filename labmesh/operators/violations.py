"""Temperature violations of freezers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labmesh.functions import asof

# A reading at or above this many degrees is a violation, and
# the rollup looks back one week.
THRESHOLD = -70
LOOKBACK_DAYS = 7


def is_violation(threshold: float = THRESHOLD) -> Column:
    return F.col("ReadingValue") >= F.lit(threshold)


def violation_rollup(
    temperature_log: DataFrame,
    as_of: asof.AsOf,
    threshold: float = THRESHOLD,
    lookback_days: int = LOOKBACK_DAYS,
) -> DataFrame:
    """One row per freezer with a violation in the window up to ``as_of``.

    The filter on both columns reaches the scan; tasks combine readings before
    the shuffle, so a freezer with most of the readings stays cheap.
    """
    when = F.col("ReadingTime")
    since = asof.as_type(asof.days_before(as_of, lookback_days), temperature_log, "ReadingTime")
    until = asof.as_type(asof.instant(as_of), temperature_log, "ReadingTime")
    if "ReadingDay" in temperature_log.columns:
        # The log is stored by day: days outside the window are not read.
        day = F.col("ReadingDay")
        first, last = asof.days_before(as_of, lookback_days), asof.instant(as_of)
        temperature_log = temperature_log.where((day >= F.to_date(first)) & (day <= F.to_date(last)))
    return (
        temperature_log.where(is_violation(threshold) & (when >= since) & (when <= until))
        .groupBy("FreezerID")
        .agg(
            F.max("ReadingValue").alias("MaxViolationTemp"),
            F.min("ReadingTime").alias("FirstViolation"),
            F.max("ReadingTime").alias("LastViolation"),
            F.count("*").alias("ViolationCount"),
        )
    )
