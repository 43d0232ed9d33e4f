"""Streams: late rows, copies, alarms and sessions."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from labmesh.operators.runs import window_alarms, window_states
from labmesh.streaming import access, freezers
from labmesh.streaming.run import read_folder, run_available
from tests.conftest import rows_of

START = datetime(2024, 1, 1)
READINGS = "LogID long, FreezerID long, ReadingTime timestamp, ReadingValue double"


@pytest.fixture
def deliver(spark, tmp_path):
    """Write one file per batch and read them in that order as a stream."""
    path = str(tmp_path / "in")

    def stream(schema, *batches):
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        frame = spark.createDataFrame([], schema)
        return read_folder(spark, path, frame.schema, files_per_batch=1)

    return stream


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_late_reading_is_dropped(deliver):
    # Spark drops rows later than the watermark of the batch before.
    stream = deliver(
        READINGS,
        [(1, 1, at(5), -60.0), (2, 1, at(50), -50.0), (3, 1, at(55), -90.0)],
        [(4, 1, at(200), -90.0)],
        [(7, 1, at(210), -90.0)],
        [(5, 1, at(10), -1.0)],
        [(6, 1, at(400), -90.0)],
    )
    got = run_available(freezers.violation_windows(stream), "late")
    assert rows_of(got) == [(1, at(0), at(60), -50.0, at(5), at(50), 2)]


def test_reading_within_the_delay_counts(deliver):
    stream = deliver(READINGS, [(1, 1, at(65), -60.0)], [(2, 1, at(58), -40.0)], [(3, 1, at(400), -90.0)])
    got = run_available(freezers.violation_windows(stream), "delayed")
    assert rows_of(got, "WindowStart", "ViolationCount") == [(at(0), 1), (at(60), 1)]


def test_copies_within_and_across_batches(deliver):
    stream = deliver(
        READINGS,
        [(1, 1, at(1), -60.0), (1, 1, at(1), -60.0), (2, 1, at(2), -60.0)],
        [(1, 1, at(1), -60.0)],
        [(9, 1, at(300), -60.0)],
    )
    assert rows_of(run_available(freezers.distinct_readings(stream), "copies"), "LogID") == [(1,), (2,), (9,)]


def test_run_goes_on_from_its_checkpoint(deliver, spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    first = deliver(READINGS, [(1, 1, at(1), -60.0)], [(2, 1, at(300), -60.0)])
    assert run_available(freezers.violation_windows(first), "a", out, state).count() == 1
    second = deliver(READINGS, [(3, 1, at(900), -60.0)])
    got = run_available(freezers.violation_windows(second), "a", out, state)
    assert rows_of(got, "WindowStart") == [(at(0),), (at(300),)]


def test_no_input_at_all(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = read_folder(spark, str(tmp_path / "in"), spark.createDataFrame([], READINGS).schema)
    assert run_available(freezers.violation_windows(stream), "none").collect() == []
    path = str(tmp_path / "states")
    states = freezers.states_stream(stream)
    assert run_available(states, "states", out=path).collect() == []
    assert run_available(freezers.alarms(path, states, length=3), "alarms").collect() == []


def test_alarms_equal_the_batch_result(deliver, spark, tmp_path):
    rows = []
    for i in range(400):
        freezer = 1 if i % 3 else 2
        rows.append((i, freezer, at(20 * i), -60.0 if (i // 7) % 3 else -80.0))
    stream = deliver(READINGS, rows[:150], rows[150:300], rows[300:], [(999, 3, at(20000), -90.0)])
    states = freezers.states_stream(stream)
    path = str(tmp_path / "states")
    written = run_available(states, "states", out=path)
    got = run_available(freezers.alarms(path, states, length=3), "alarms")
    batch = window_states(spark.createDataFrame(rows, READINGS), "1 hour")
    assert rows_of(written) == rows_of(batch)
    expected = rows_of(window_alarms(batch, 3))
    assert len(expected) > 5 and rows_of(got) == expected


def test_alarm_state_crosses_batches(spark, tmp_path):
    """The second run sees only the window that completes the sequence."""
    path, out, state = (str(tmp_path / n) for n in ("states", "out", "state"))
    schema = "FreezerID long, WindowStart timestamp, WindowEnd timestamp, PeakValue double, Violating boolean"

    def push(*hours):
        rows = [(1, at(60 * h), at(60 * h + 60), -60.0 + h, True) for h in hours]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        like = spark.createDataFrame([], schema)
        return rows_of(run_available(freezers.alarms(path, like, length=3), "x", out, state))

    assert push(0, 1) == []
    assert push(2) == [(1, at(0), at(120), -58.0)]
    assert push(3) == [(1, at(0), at(120), -58.0)]


def test_stream_joins_static_table(deliver, spark):
    stream = deliver(READINGS, [(1, 1, at(1), -60.0), (2, 2, at(2), -60.0)])
    names = spark.createDataFrame([(1, "north")], "FreezerID long, FreezerName string")
    out = freezers.with_freezer(stream, names).select("LogID", "FreezerName")
    assert rows_of(run_available(out, "named")) == [(1, "north"), (2, None)]


def test_conflicting_copies_stay_whole(deliver):
    stream = deliver(READINGS, [(1, 2, at(1), -60.0)], [(1, 1, at(2), -50.0)], [(9, 1, at(300), -60.0)])
    got = run_available(freezers.distinct_readings(stream), "copies")
    assert rows_of(got, "LogID", "FreezerID", "ReadingValue") == [(1, 2, -60.0), (9, 1, -60.0)]


ACCESS = "UserID long, AccessTime timestamp, Action string"


def test_bursts_and_audit(deliver):
    rows = [(1, at(m), "view") for m in (1, 2, 3)] + [(2, at(5), "edit")]
    stream = deliver(ACCESS, rows, [(3, at(3000), "view")])
    assert rows_of(run_available(access.bursts(stream, more_than=2), "bursts")) == [(1, at(0), at(60), 3)]
    audit = rows_of(run_available(access.audit_summary(stream), "audit"))
    assert audit == [(1, "view", START, 3), (2, "edit", START, 1)]


def test_sessions_across_batches(deliver):
    stream = deliver(
        ACCESS,
        [(1, at(0), "v"), (1, at(0.2), "v"), (1, at(20), "v")],
        [(1, at(45), "v"), (1, at(120), "v"), (2, at(121), "v")],
        [(9, at(5000), "v")],
    )
    got = run_available(access.sessions(stream), "sessions")
    assert rows_of(got) == [(1, at(0), at(45), 4), (1, at(120), at(120), 1), (2, at(121), at(121), 1)]
