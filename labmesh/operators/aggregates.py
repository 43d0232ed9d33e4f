"""Aggregations that combine rows before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"
TOTAL = "decimal(38,2)"


def money_sum(column: str | Column) -> Column:
    """Exact sum of a money column, whatever type it was loaded with."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column.cast(MONEY)).cast(TOTAL)


def exact_mean(total: Column, count: Column) -> Column:
    """Mean from a sum and a count; NULL for an empty group."""
    return F.try_divide(total.cast("double"), count.cast("double"))


def best_per_group(rows: DataFrame, keys: list[str], rank: list[Column], value: str, alias: str) -> DataFrame:
    """The value of the row ranked lowest in each group.

    ``rank`` must order the rows of a group without ties. Each task keeps one
    candidate per group, so no group is gathered or sorted.
    """
    order = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])
    return rows.groupBy(*keys).agg(F.min_by(F.col(value), order).alias(alias))


def severity_by_institution(participant: DataFrame, adverse_event: DataFrame) -> DataFrame:
    """Per institution the sum and number of severity grades of its participants.

    Events collapse to one row per participant before the join, so a
    participant or institution with most of the events stays cheap.
    """
    per_person = adverse_event.groupBy("ParticipantID").agg(
        F.sum(F.col("SeverityGrade").cast("bigint")).alias("__sum"), F.count("SeverityGrade").alias("__n")
    )
    return (
        participant.select("ParticipantID", "InstitutionID")
        .join(per_person, "ParticipantID")
        .groupBy("InstitutionID")
        .agg(F.sum("__sum").alias("SeveritySum"), F.sum("__n").alias("SeverityCount"))
    )
