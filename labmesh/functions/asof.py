"""Time bounds relative to an explicit evaluation time.

``as_of`` is a timestamp string, a ``datetime`` or a Column. Two ways of
comparing a DATE with it exist. *Instant* comparison promotes the date to its
midnight, so a date equal to today already lies in the past after 00:00. *Day*
comparison looks at calendar days only.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AsOf = str | datetime | Column


def instant(as_of: AsOf | None) -> Column:
    """The evaluation time as a timestamp; the clock only if none is given."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of.cast("timestamp")
    return F.lit(str(as_of)).cast("timestamp")


def day(as_of: AsOf | None) -> Column:
    return F.to_date(instant(as_of))


def years_before(as_of: AsOf | None, years: int, by_day: bool = True) -> Column:
    """``as_of`` minus whole years; 29 February falls back to the 28th."""
    start = F.add_months(day(as_of), -12 * years)
    if by_day:
        return start
    now = instant(as_of)
    midnight = F.date_trunc("day", now)
    return start.cast("timestamp") + (now - midnight)


def days_after(as_of: AsOf | None, days: int, by_day: bool = True) -> Column:
    if by_day:
        return F.date_add(day(as_of), days)
    return instant(as_of) + F.make_dt_interval(F.lit(days))


def days_before(as_of: AsOf | None, days: int) -> Column:
    return instant(as_of) - F.make_dt_interval(F.lit(days))


def before(date_col: Column, as_of: AsOf | None, by_day: bool = True) -> Column:
    """``date_col`` lies strictly before the evaluation time."""
    return date_col < (day(as_of) if by_day else instant(as_of))


def after(date_col: Column, as_of: AsOf | None, by_day: bool = True) -> Column:
    """``date_col`` lies strictly after the evaluation time; NULL does not."""
    return date_col > (day(as_of) if by_day else instant(as_of))


def as_type(bound: Column, df: DataFrame, column: str) -> Column:
    """``bound`` in the type of a column, so that the filter reaches the scan."""
    return bound.cast(df.schema[column].dataType)


def sql_literal(as_of: AsOf) -> str:
    """``as_of`` as text for a SQL rule."""
    return f"timestamp'{as_of}'"
