"""Data-access monitors. Input columns: UserID, AccessTime, Action."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def bursts(accesses: DataFrame, more_than: int, window: str = "1 hour", late: str = LATE) -> DataFrame:
    """Users with more than a number of accesses in a tumbling window."""
    return (
        accesses.withWatermark("AccessTime", late)
        .groupBy("UserID", F.window("AccessTime", window).alias("w"))
        .agg(F.count("*").alias("Accesses"))
        .where(F.col("Accesses") > more_than)
        .select("UserID", F.col("w.start").alias("WindowStart"), F.col("w.end").alias("WindowEnd"), "Accesses")
    )


def sessions(accesses: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Sessions per user: chains of accesses at most ``gap`` apart.

    State holds the open sessions of a user as intervals; an access that arrives late
    can join two of them. A session is emitted when the watermark is ``gap`` past its
    last access. Run it with ``MERGED_EARLY``: accesses of a batch then merge into
    sessions before they shuffle, however many one user has.
    """
    return (
        accesses.withWatermark("AccessTime", late)
        .groupBy("UserID", F.session_window("AccessTime", gap).alias("s"))
        .agg(
            F.count("*").alias("Accesses"),
            F.min("AccessTime").alias("FirstAccess"),
            F.max("AccessTime").alias("LastAccess"),
        )
        .select("UserID", "FirstAccess", "LastAccess", "Accesses")
    )


def audit_summary(accesses: DataFrame, window: str = "1 day", late: str = LATE) -> DataFrame:
    """Accesses by user, action and window, for the audit trail."""
    return (
        accesses.withWatermark("AccessTime", late)
        .groupBy("UserID", "Action", F.window("AccessTime", window).alias("w"))
        .agg(F.count("*").alias("Accesses"))
        .select("UserID", "Action", F.col("w.start").alias("WindowStart"), "Accesses")
    )
