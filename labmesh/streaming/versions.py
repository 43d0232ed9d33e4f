"""Readings with the row of a changing table that was valid at their time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labmesh.streaming.freezers import LATE
from labmesh.streaming.ordered import InOrder, codes, column, in_order, packed, unpacked

CHANGE, READING = 0, 1


class ValidAt(InOrder):
    """Readings and changes; remembered is the change that holds now, by key.

    A change holds from its own moment on, so it goes before readings of that moment;
    of changes of one moment the greater row holds.
    """

    waiting = pa.schema({"key": pa.string(), "time": pa.int64(), "kind": pa.int32(), "row": pa.string()})
    memory = pa.schema({"key": pa.string(), "since": pa.int64(), "row": pa.string()})
    results = "key string, time long, row string, since long, valid string"

    def arrive(self, rows):
        return rows

    def step(self, memory, ready, until):
        is_change = pc.equal(ready.column("kind"), CHANGE)
        readings = ready.filter(pc.invert(is_change))
        arrived = ready.filter(is_change).select(["key", "time", "row"]).rename_columns(["key", "since", "row"])
        changes = pa.concat_tables([memory, arrived])
        # By key, time and text, which for UTF-8 is the order of code points.
        of_change, of_reading = codes(changes.column("key"), readings.column("key"))
        by = pa.table({"code": of_change, "since": changes.column("since"), "row": changes.column("row")})
        order = pc.sort_indices(by, sort_keys=[("code", "ascending"), ("since", "ascending"), ("row", "ascending")])
        changes, of_change = changes.take(order), of_change[order.to_numpy()]
        since = column(changes, "since")
        last = np.append(of_change[1:] != of_change[:-1], True)[: len(of_change)]

        code = np.concatenate([of_change, of_reading])
        time = np.concatenate([since, column(readings, "time")])
        kind = np.repeat([CHANGE, READING], [len(changes), len(readings)])
        place = np.concatenate([np.arange(len(changes)), np.full(len(readings), -1)])
        merged = np.lexsort((kind, time, code))
        before = np.empty(len(merged), np.int64)
        before[merged] = np.maximum.accumulate(place[merged]) if len(merged) else place
        before = before[len(changes) :]
        held = before >= 0
        held[held] = of_change[before[held]] == of_reading[held]
        valid = changes.select(["since", "row"]).take(pa.array(before, mask=~held))
        found = pa.table(
            {
                "key": readings.column("key"),
                "time": readings.column("time"),
                "row": readings.column("row"),
                "since": valid.column("since"),
                "valid": valid.column("row"),
            }
        )
        return changes.filter(pa.array(last)).combine_chunks(), found


def with_version(
    readings: DataFrame,
    changes: DataFrame,
    key: str = "FreezerID",
    time: str = "ReadingTime",
    since: str = "ValidFrom",
    late: str = LATE,
) -> DataFrame:
    """Every reading with the latest change of its key that is not later than itself.

    Both are streams; each has a watermark, and readings wait until both have passed
    them, so a change that is at most ``late`` behind is still taken. A key keeps one
    change, and the readings that wait. A reading before any change has NULL in those
    columns. Readings and changes without a key or a time are left out.
    """
    own = [c for c in readings.columns if c not in (key, time)]
    more = [c for c in changes.columns if c not in (key, since)]
    both = (
        readings.where(F.col(key).isNotNull() & F.col(time).isNotNull())
        .select(F.col(key), F.col(time).alias("at"), F.lit(READING).alias("kind"), packed([time, *own]).alias("row"))
        .withWatermark("at", late)
        .unionByName(
            changes.where(F.col(key).isNotNull() & F.col(since).isNotNull())
            .select(F.col(key), F.col(since).alias("at"), F.lit(CHANGE).alias("kind"), packed([since, *more]).alias("row"))
            .withWatermark("at", late)
        )
    )
    found = in_order(both, key, "at", ValidAt())
    reading = unpacked("row", readings, own)
    version = unpacked("valid", changes, more)
    return found.select(
        unpacked("key", readings, [key])[key].alias(key),
        F.timestamp_micros("time").alias(time),
        *(reading[c].alias(c) for c in own),
        F.timestamp_micros("since").alias(since),
        *(version[c].alias(c) for c in more),
    )
