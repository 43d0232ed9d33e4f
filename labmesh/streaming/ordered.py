"""Per-key processing in event-time order: a buffer, the watermark and timers.

Rows of a key wait in state until the watermark has passed them, so that late
arrivals take their place; then they are handed on, oldest first. What waits is
bounded by what a key delivers within the delay of the watermark.

Keys are dealt by hash into buckets. A bucket is one row of state and one call per
batch, in which the rows of all its keys are worked on as columns, so that many keys
with few rows each cost no call of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Buckets of keys: the number of tasks that can share the state.
BUCKETS = 1024
NO_TIME = -(2**63)
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def packed(columns: list[str]) -> Column:
    """Columns of any types as one text."""
    return F.to_json(F.struct(*columns), _TIMES)


def unpacked(text: str, frame: DataFrame, columns: list[str]) -> Column:
    """The columns of ``frame`` that ``packed`` has put into a text."""
    kinds = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in columns)
    return F.from_json(text, kinds, _TIMES)


def codes(*keys: pa.ChunkedArray) -> list[np.ndarray]:
    """Keys of several tables as numbers, equal ones for equal keys."""
    flat = pa.concat_arrays([chunk for column in keys for chunk in column.chunks] or [pa.array([], pa.string())])
    numbers = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(numbers, np.cumsum([len(column) for column in keys])[:-1])


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


class InOrder:
    """Base of processors that see the rows of keys in event-time order.

    A subclass states `waiting` and `memory`, the columns of what waits and of what is
    remembered, one row per key, beside the column ``key``; `results`, the columns it
    gives; and three methods: `arrive`, from input rows to waiting ones; `step`, from
    memory and the rows whose time has come to new memory and results; and `wake`, when
    it wants to be called although nothing waits. Waiting rows have a ``time`` in
    microseconds; all that a moment has is handed on at once. A key is not remembered
    unless `step` returns it.
    """

    waiting: pa.Schema
    memory: pa.Schema
    results: str

    def arrive(self, rows: pa.Table) -> pa.Table:
        raise NotImplementedError

    def step(self, memory: pa.Table, ready: pa.Table, until: int) -> tuple[pa.Table, pa.Table]:
        raise NotImplementedError

    def wake(self, memory: pa.Table) -> int | None:
        """When to call `step` without rows, in microseconds."""
        return None

    def advance(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, memory = map(_read, state.get) if state.exists else (self.waiting.empty_table(), self.memory.empty_table())
        new = [self.arrive(_timed(frame)).select(self.waiting.names).cast(self.waiting) for frame in frames if len(frame)]
        waiting = pa.concat_tables([waiting, *new])
        until = state.getCurrentWatermarkMs() * 1000
        # Spark drops what is not later than the watermark: up to it all has arrived.
        passed = pc.less_equal(waiting.column("time"), until)
        ready, rest = waiting.filter(passed), waiting.filter(pc.invert(passed))
        memory, found = self.step(memory, ready, until)
        due = [pc.min(rest.column("time")).as_py()] if len(rest) else []
        due += [at for at in [self.wake(memory)] if at is not None and at > until]
        if len(rest) or len(memory):
            state.update((_written(rest), _written(memory)))
            if due:
                state.setTimeoutTimestamp(-(-min(due) // 1000))
        elif state.exists:
            state.remove()
        if len(found):
            yield found.to_pandas()


def _timed(frame: pd.DataFrame) -> pa.Table:
    rows = pa.Table.from_pandas(frame, preserve_index=False)
    return rows.filter(pc.not_equal(rows.column("time"), NO_TIME))


def _written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(held: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(held)).read_all()


def in_order(rows: DataFrame, key: str, time: str, processor: InOrder, buckets: int = BUCKETS) -> DataFrame:
    """The results of the processor for the keys of a stream with a watermark on ``time``.

    Keys reach the processor packed, in the column ``key``, and so they come back. Rows
    without a time are left out.
    """
    dealt = rows.withColumns(
        {
            "bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"),
            "key": packed([key]),
            "time": F.coalesce(F.unix_micros(time), F.lit(NO_TIME)),
        }
    )
    return dealt.groupBy("bucket").applyInPandasWithState(
        processor.advance, processor.results, "waiting binary, memory binary", "append", GroupStateTimeout.EventTimeTimeout
    )
