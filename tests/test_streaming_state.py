"""State in event-time order: alarms on readings, versions, late rows, exact sessions."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin as spark_groups

from labmesh.operators.runs import violation_runs
from labmesh.streaming import access, freezers, ordered
from labmesh.streaming.alarms import reading_alarms
from labmesh.streaming.late import account, deliveries, on_time
from labmesh.streaming.run import MERGED_EARLY, ROCKSDB, read_folder, replay, run_available
from labmesh.streaming.versions import with_version
from tests.conftest import rows_of

START = datetime(2024, 1, 1)
READINGS = "LogID long, FreezerID long, ReadingTime timestamp, ReadingValue double"
ACCESS = "UserID long, AccessTime timestamp, Action string"


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.fixture
def deliver(spark, tmp_path):
    """Write one file per batch and read them in that order as a stream."""
    count = [0]

    def stream(schema, *batches):
        count[0] += 1
        path = str(tmp_path / f"in{count[0]}")
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        return read_folder(spark, path, spark.createDataFrame([], schema).schema, files_per_batch=1)

    return stream


END = [(None, 0, at(10_000_000), None)]


def test_reading_alarms_equal_the_batch_result(deliver, spark):
    """Runs inside and across batches, rows out of order within the delay, copies of a moment."""
    rows = []
    for i in range(600):
        value = -60.0 + i % 5 if (i // 9) % 3 else -80.0
        rows.append((i, 1 if i % 3 else 2, at(2 * i + (7 if i % 11 == 0 else 0)), value))
    rows += [(1000, 1, at(2 * 40), -60.0), (1001, 2, at(2 * 50 + 0.5), -90.0), (1002, 3, at(900), -50.0)]
    batches = [[r for r in rows if 240 * k <= (r[2] - START).total_seconds() / 60 < 240 * k + 240] for k in range(5)]
    assert sum(map(len, batches)) >= len(rows) - 5 and all(batches)
    rows = [r for batch in batches for r in batch]
    out = run_available(reading_alarms(deliver(READINGS, *batches, END), 4, quiet="400 days"), "a", conf=ROCKSDB)
    columns = ["FreezerID", "Readings", "RunStart", "RunEnd", "PeakValue"]
    want = rows_of(violation_runs(spark.createDataFrame(rows, READINGS), 4), *columns)
    assert len(want) > 20 and rows_of(out.where("State = 'ended'"), *columns) == want
    assert out.where("State = 'raised'").count() == len(want)


def test_an_alarm_is_raised_before_its_run_ends(deliver):
    stream = deliver(
        READINGS,
        [(k, 1, at(k), -60.0 + k) for k in range(3)],
        [(9, 2, at(100), -90.0)],
        [(10, 2, at(200), -90.0)],
    )
    out = run_available(reading_alarms(stream, 3), "raised", conf=ROCKSDB)
    assert rows_of(out) == [(1, "raised", at(0), at(2), 3, -58.0)]


def test_a_silent_freezer_ends_its_run(deliver):
    stream = deliver(
        READINGS,
        [(1, 1, at(0), -60.0), (2, 1, at(1), -61.0), (3, 1, at(61), -50.0), (4, 1, at(62), -50.0)],
        END,
    )
    out = run_available(reading_alarms(stream, 2, quiet="60 minutes"), "quiet", conf=ROCKSDB)
    ended = out.where("State = 'ended'")
    assert rows_of(ended, "RunStart", "RunEnd", "Readings", "PeakValue") == [
        (at(0), at(1), 2, -60.0),
        (at(61), at(62), 2, -50.0),
    ]


def test_a_reading_that_arrives_late_takes_its_place(deliver):
    """The break comes a batch after readings that follow it."""
    stream = deliver(
        READINGS,
        [(1, 1, at(0), -60.0), (2, 1, at(2), -60.0), (3, 1, at(4), -60.0)],
        [(4, 1, at(3), -90.0), (5, 1, at(5), None)],
        END,
    )
    out = run_available(reading_alarms(stream, 2, quiet="1 day"), "late", conf=ROCKSDB)
    assert rows_of(out.where("State = 'ended'"), "RunStart", "RunEnd") == [(at(0), at(2))]


def test_alarm_state_survives_a_restart(deliver, spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("source", "out", "state"))

    def push(*rows):
        spark.createDataFrame(list(rows), READINGS).coalesce(1).write.mode("append").parquet(source)
        stream = read_folder(spark, source, spark.createDataFrame([], READINGS).schema, files_per_batch=1)
        got = run_available(reading_alarms(stream, 3), "x", out, state, conf=ROCKSDB)
        return rows_of(got, "State", "RunStart", "RunEnd", "Readings")

    assert push((1, 1, at(0), -60.0), (2, 1, at(1), -60.0)) == []
    assert push((3, 1, at(2), -60.0), (4, 2, at(90), -90.0)) == [("raised", at(0), at(2), 3)]
    assert push((5, 1, at(91), -90.0), (6, 2, at(190), -90.0))[0] == ("ended", at(0), at(2), 3)


def test_sessions_split_and_join_at_the_gap(deliver):
    second = 1 / 60
    stream = deliver(
        ACCESS,
        [(1, at(0), "v"), (1, at(30 - second), "v"), (2, at(0), "v"), (2, at(30 + second), "v"), (3, at(0), "v"), (3, at(30), "v")],
        [(9, at(5000), "v")],
    )
    got = run_available(access.sessions(stream), "s", conf=MERGED_EARLY)
    assert rows_of(got, "UserID", "Accesses") == [(1, 2), (2, 1), (2, 1), (3, 2)]


def test_a_late_access_joins_two_sessions(deliver):
    stream = deliver(
        ACCESS, [(1, at(0), "v"), (1, at(40), "v")], [(1, at(20), "v"), (2, at(41), "v")], [(9, at(5000), "v")]
    )
    got = run_available(access.sessions(stream, late="30 minutes"), "s", conf=MERGED_EARLY)
    assert rows_of(got) == [(1, at(0), at(40), 3), (2, at(41), at(41), 1)]


CHANGES = "FreezerID long, ValidFrom timestamp, Setting int, Note string"


def test_readings_carry_the_version_of_their_time(deliver):
    readings = deliver(
        READINGS,
        [(1, 1, at(5), 1.0), (2, 1, at(10), 2.0), (3, 2, at(10), None)],
        [(4, 1, at(30), 4.0), (5, 1, at(29), 5.5), (6, None, at(30), 1.0)],
        END,
    )
    changes = deliver(
        CHANGES,
        [(1, at(10), 7, "a"), (1, at(25), 9, None)],
        # Behind, but within the delay.
        [(1, at(29), 8, 'q"\n'), (2, at(60), 1, "z")],
        [(0, at(10_000_000), None, None)],
    )
    got = run_available(with_version(readings, changes), "v", conf=ROCKSDB)
    assert got.columns == ["FreezerID", "ReadingTime", "LogID", "ReadingValue", "ValidFrom", "Setting", "Note"]
    assert rows_of(got, "LogID", "ReadingValue", "ValidFrom", "Setting", "Note") == [
        (1, 1.0, None, None, None),
        (2, 2.0, at(10), 7, "a"),
        (3, None, None, None, None),
        (4, 4.0, at(29), 8, 'q"\n'),
        (5, 5.5, at(29), 8, 'q"\n'),
    ]


@pytest.mark.parametrize("buckets", [1, 64])
def test_keys_of_a_bucket_do_not_mix(deliver, spark, monkeypatch, buckets):
    """Freezers that share a bucket, one of them without an id, and rows without a time."""
    rows = [
        (i, None if i % 50 == 49 else i % 50, at(i // 50 + i % 3 / 10), -60.0 if (i * 7919) % 11 else -80.0) for i in range(6000)
    ]
    batches = [[r for r in rows if 30 * k <= (r[2] - START).total_seconds() / 60 < 30 * k + 30] for k in range(4)]
    asked = []
    apply = spark_groups.applyInPandasWithState

    def counted(self, advance, *args):
        asked.append(self)
        return apply(self, advance, *args)

    monkeypatch.setattr(spark_groups, "applyInPandasWithState", counted)
    monkeypatch.setattr(ordered.in_order, "__defaults__", (buckets,))
    stream = deliver(READINGS, *[[*batch, (9999, 7, None, -90.0)] for batch in batches], END)
    out = run_available(reading_alarms(stream, 4, quiet="400 days"), "b", conf=ROCKSDB)
    columns = ["FreezerID", "Readings", "RunStart", "RunEnd", "PeakValue"]
    # The batch form joins by freezer, which leaves out rows without an id.
    named = spark.createDataFrame([(*r[:1], -1 if r[1] is None else r[1], *r[2:]) for r in rows], READINGS)
    want = [(None if r[0] == -1 else r[0], *r[1:]) for r in rows_of(violation_runs(named, 4), *columns)]
    ended = rows_of(out.where("State = 'ended'"), *columns)
    assert asked and len(want) > 100 and any(r[0] is None for r in want) and ended == sorted(want, key=repr)
    assert out.where("State = 'raised'").count() == len(want)


def test_what_was_delivered_is_accounted_for(deliver, spark, tmp_path):
    stream = deliver(
        READINGS,
        [(1, 1, at(5), 0.0), (2, 1, at(50), 0.0), (2, 1, at(50), 0.0)],
        [(3, 1, at(39), 0.0), (4, 1, at(40), 0.0), (5, 1, at(41), 0.0), (2, 1, at(50), 0.0), (8, 1, None, 0.0)],
        [(6, 1, at(300), 0.0), (1, 1, at(5), 0.0)],
        [(7, 1, at(289), 0.0), (6, 1, at(300), 0.0)],
    )
    path = str(tmp_path / "delivered")
    delivered = deliveries(stream, "ReadingTime", "d", out=path)
    kept = run_available(freezers.distinct_readings(on_time(delivered, path)), "k")
    rows = rows_of(account(delivered, kept, "LogID"), "LogID", "Delivered", "Kept", "Duplicates", "Late")
    assert rows == [
        (1, 2, 1, 0, 1),
        (2, 3, 1, 2, 0),
        (3, 1, 0, 0, 1),
        (4, 1, 0, 0, 1),
        (5, 1, 1, 0, 0),
        (6, 2, 1, 1, 0),
        (7, 1, 0, 0, 1),
        (8, 1, 1, 0, 0),
    ]


def test_deliveries_go_on_where_they_stopped(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("source", "out", "state"))

    def push(*rows):
        spark.createDataFrame(list(rows), READINGS).coalesce(1).write.mode("append").parquet(source)
        stream = read_folder(spark, source, spark.createDataFrame([], READINGS).schema, files_per_batch=1)
        return rows_of(deliveries(stream, "ReadingTime", "d", out=out, state=state), "LogID", "Late", "Batch")

    assert push((1, 1, at(100), 0.0)) == [(1, False, 0)]
    assert push((2, 1, at(90), 0.0), (3, 1, at(91), 0.0)) == [(1, False, 0), (2, True, 1), (3, False, 1)]


def test_replay_delivers_batches_in_order(spark):
    table = spark.createDataFrame([(k, k % 3) for k in range(9)], "n long, b int")
    out = run_available(replay(table, "b", 4), "replayed")
    assert out.columns == ["n"] and rows_of(out) == [(k,) for k in range(9)]


def test_a_large_batch_is_several_files(spark, tmp_path):
    """Batches stay together and in order, those with few rows or none among them."""
    table = spark.range(1000).selectExpr("id AS n", "CAST(id % 2 AS INT) * 3 AS b", "IF(id > 990, NULL, id) AS v")
    table = table.unionByName(spark.createDataFrame([(5000, 2, None)], "n long, b int, v long"))
    stream = replay(table, "b", 5, rows_per_file=120)
    seen = {}

    def keep(batch, number):
        seen[number] = rows_of(batch), batch.rdd.getNumPartitions()

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    want = {k: sorted(((r.n, r.v) for r in table.where(f"b = {k}").collect()), key=repr) for k in range(5)}
    assert {k: rows for k, (rows, _) in seen.items()} == want
    assert seen[0][1] > 1 and stream.columns == ["n", "v"]


def test_no_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    empty = read_folder(spark, str(tmp_path / "in"), spark.createDataFrame([], READINGS).schema)
    assert run_available(reading_alarms(empty, 3), "none", conf=ROCKSDB).collect() == []
    delivered = deliveries(empty, "ReadingTime", "none", out=str(tmp_path / "out"))
    assert delivered.collect() == [] and "Batch" in delivered.columns
