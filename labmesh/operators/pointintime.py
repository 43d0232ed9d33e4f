"""What was known of a key on a day: totals of dated facts up to and with that day.

Facts shrink to one row per key and day before anything is ordered, and the days that
are asked for join them as rows without facts. One window per key then runs over
days; however many facts or asking rows a key has, it sees at most two rows a day.
No fact meets an asking row in a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily(facts: DataFrame, key: str, day: str, sums: dict | None = None, highest: dict | None = None) -> DataFrame:
    """Facts with a key and a date as one row per key and ``Day``.

    ``sums`` and ``highest`` map names to the column that is summed or whose
    largest value counts.
    """
    dated = facts.withColumn("Day", F.to_date(day)).where(F.col(key).isNotNull() & F.col("Day").isNotNull())
    totals = [F.sum(column).alias(name) for name, column in (sums or {}).items()]
    peaks = [F.max(column).alias(name) for name, column in (highest or {}).items()]
    return dated.groupBy(key, "Day").agg(*totals, *peaks)


def known_totals(
    asked: DataFrame, facts: Sequence[DataFrame], key: str, sums: Sequence[str], highest: Sequence[str] = ()
) -> DataFrame:
    """One row per key and ``Day`` of ``asked`` with the totals of all facts up to that day.

    ``facts`` are tables that `daily` made, for the same key; a name belongs to one of
    them. A sum without any fact is 0, a highest value NULL. Rows of ``asked`` without
    a key or a day ask nothing.
    """
    wanted = asked.select(key, "Day").dropna().distinct().withColumn("__asked", F.lit(True))
    rows = wanted
    for table in facts:
        rows = rows.unionByName(table.select(key, "Day", *_own(table, key)), allowMissingColumns=True)
    until = Window.partitionBy(key).orderBy("Day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        key,
        "Day",
        "__asked",
        *[F.coalesce(F.sum(name).over(until), F.lit(0)).alias(name) for name in sums],
        *[F.max(name).over(until).alias(name) for name in highest],
    ).where("__asked").drop("__asked")


def _own(table: DataFrame, key: str) -> list[str]:
    return [c for c in table.columns if c not in (key, "Day")]
