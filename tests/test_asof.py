"""Time bounds."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from labmesh.functions import asof


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_leap_day_falls_back(spark):
    assert value(spark, asof.years_before("2024-02-29 10:00:00", 5)) == date(2019, 2, 28)
    assert value(spark, asof.years_before("2024-02-29 10:00:00", 5, by_day=False)) == datetime(2019, 2, 28, 10)


def test_days(spark):
    assert value(spark, asof.days_after("2024-12-20", 30)) == date(2025, 1, 19)
    assert value(spark, asof.days_after("2024-12-20 01:00:00", 30, by_day=False)) == datetime(2025, 1, 19, 1)
    assert value(spark, asof.days_before("2024-03-01 01:00:00", 7)) == datetime(2024, 2, 23, 1)


@pytest.mark.parametrize("by_day, past", [(True, False), (False, True)])
def test_today_is_past_only_by_the_clock(spark, by_day, past):
    today = F.lit("2025-07-05").cast("date")
    assert value(spark, asof.before(today, "2025-07-05 00:00:01", by_day)) is past
    assert value(spark, asof.after(today, "2025-07-05 00:00:01", by_day)) is False


def test_datetime_and_default(spark):
    assert value(spark, asof.instant(datetime(2025, 1, 2, 3))) == datetime(2025, 1, 2, 3)
    assert value(spark, asof.instant(None)) is not None
