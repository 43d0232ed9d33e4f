"""Consecutive violations in batch."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from itertools import groupby

import pytest

from labmesh.operators.runs import violation_runs, window_alarms, window_states
from tests.conftest import rows_of

SCHEMA = "LogID long, FreezerID long, ReadingTime timestamp_ntz, ReadingValue double"


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_a_scan(spark, seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows, at = [], start
    for i in range(1500):
        at += timedelta(seconds=rng.choice([0, 1, 20, 45, 4000]))
        rows.append((i, 1 if rng.random() < 0.8 else rng.randint(2, 4), at, rng.choice([-80.0, -60.0, -60.0, -50.0])))
    df = spark.createDataFrame(rows, SCHEMA)

    expected = []
    for freezer in range(1, 5):
        mine = sorted((t, v) for _, f, t, v in rows if f == freezer)
        moments = [(t, [v for _, v in g]) for t, g in groupby(mine, key=lambda x: x[0])]
        run = []
        for t, values in [*moments, (None, [-99.0])]:
            if min(values) >= -70:
                run.append((t, values))
                continue
            readings = [v for _, vs in run for v in vs]
            if len(readings) >= 3:
                expected.append((freezer, len(readings), run[0][0], run[-1][0], max(readings)))
            run = []
    assert rows_of(violation_runs(df, 3)) == sorted(expected, key=repr)


def test_alarm_belongs_to_the_completing_window(spark):
    values = [(0, -60.0), (1, -50.0), (1, -80.0), (2, -60.0), (3, -55.0), (5, -40.0), (6, -40.0)]
    rows = [(i, 1, datetime(2024, 1, 1, h, 30), v) for i, (h, v) in enumerate(values)]
    states = window_states(spark.createDataFrame(rows, SCHEMA), "1 hour")
    assert rows_of(window_alarms(states, 3)) == [(1, datetime(2024, 1, 1, 2), datetime(2024, 1, 1, 5), -40.0)]
