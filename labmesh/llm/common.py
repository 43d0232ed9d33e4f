"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labmesh.sources.scratch import fresh_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# A word is a run of anything but space, tab, line feed, vertical tab, form feed
# and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, by whatever path Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder; cuts lineage and outlives executors."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, everything else unchanged."""
    return F.translate(text, UPPER, UPPER.lower())


def n_words(text: Column) -> Column:
    """Number of words, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def add_column(
    df: DataFrame,
    source: str,
    name: str,
    kind: str,
    arrow: pa.DataType,
    start: Callable[[], Callable[[pa.Array], Sequence | pa.Array]],
    rows: int = 256,
) -> DataFrame:
    """The rows with a column computed in Python from another one, `rows` at a time.

    `start` is called once per task and returns the function from an array of
    values to as many results.
    The other columns pass by as they are; one that is called `name` is replaced.
    Small steps keep what a task holds near the size of one Arrow batch, however
    long the results are.
    """
    kept = [c for c in df.columns if c != name]
    fields = [f for f in df.schema.fields if f.name != name]
    result = T.StructType(fields + T._parse_datatype_string(f"`{name}` {kind}").fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                values = convert(part.column(source))
                if not isinstance(values, pa.Array):
                    values = pa.array(values, arrow)
                columns = [*(part.column(c) for c in kept), values]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, name])

    return df.mapInArrow(work, result)


def by_bytes(
    batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20
) -> Iterator[pa.RecordBatch]:
    """Rows in steps of about so many bytes in a text column; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for at, size in enumerate(sizes):
            if at > start and held + size > most:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def in_groups(
    df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply `work` to the rows of each key, one group in memory at a time.

    Rows are dealt by key and sorted, so that a task streams through its groups;
    thousands of small groups cost little more than their rows. The caller sees to
    it that no group is large.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            values = [batch[k].to_numpy() for k in keys]
            changes = np.zeros(len(batch) - 1, bool)
            for v in values:
                changes |= v[1:] != v[:-1]
            cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), len(batch)]
            out = []
            for start, end in zip(cuts, cuts[1:]):
                part = batch.iloc[start:end]
                if waiting and any(
                    waiting[0][k].iloc[0] != part[k].iloc[0] for k in keys
                ):
                    out.append(work(_joined(waiting)))
                    waiting = []
                waiting.append(part)
            out = [frame for frame in out if len(frame)]
            if out:
                yield pd.concat(out, ignore_index=True)
        if waiting:
            yield work(_joined(waiting))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(stream, schema)


def _joined(frames: list[pd.DataFrame]) -> pd.DataFrame:
    return frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
