"""Running a stream over everything that has arrived, into a table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labmesh.sources.scratch import fresh_folder


def read_folder(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the parquet files that ``path`` holds or will receive."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


# State in RocksDB, which processors with timers need.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
}
# Sessions of a batch merge where it is read, so that a busy user shuffles few rows.
MERGED_EARLY = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


# Rows of a replayed batch that one file should hold at most.
ROWS_PER_FILE = 250_000
_EXTRA, _PLACE = "__extra", "__place"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time in which a stream is started."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def replay(
    table: DataFrame, batch: str, batches: int, label: str = "replay", rows_per_file: int = ROWS_PER_FILE
) -> DataFrame:
    """A table as a stream that delivers the rows of each batch number together, in order.

    Each number from 0 on is one micro-batch. All have the same number of files, as many
    as the largest needs at ``rows_per_file``, which as many tasks write and read; a
    number without rows has empty ones. For backfills and for tests of what depends on
    arrival.
    """
    spark = table.sparkSession
    path = fresh_folder(spark, label)
    columns = [c for c in table.columns if c != batch]
    sizes = table.where(F.col(batch).between(0, batches - 1)).groupBy(batch).agg(F.count("*").alias("n"))
    files = max(1, -(-(sizes.agg(F.max("n")).head()[0] or 0) // rows_per_file))
    # A task without rows writes no file: each gets a row that the stream leaves out.
    place = F.pmod(F.xxhash64(*columns), F.lit(files)).cast("int")
    extra = spark.range(files).select(
        *(F.lit(None).cast(table.schema[c].dataType).alias(c) for c in columns),
        F.lit(True).alias(_EXTRA),
        F.col("id").cast("int").alias(_PLACE),
    )
    for number in range(batches):
        rows = table.where(F.col(batch) == number).select(*columns, F.lit(False).alias(_EXTRA), place.alias(_PLACE))
        dealt = rows.unionByName(extra).repartitionById(files, _PLACE) if files > 1 else rows.coalesce(1)
        dealt.drop(_PLACE).write.mode("append").parquet(path)
    schema = table.select(*columns, F.lit(False).alias(_EXTRA)).schema
    return read_folder(spark, path, schema, files_per_batch=files).where(~F.col(_EXTRA)).drop(_EXTRA)


def run_available(
    stream: DataFrame,
    label: str,
    out: str | None = None,
    state: str | None = None,
    conf: dict[str, str] | None = None,
) -> DataFrame:
    """Process all available input in append mode and return the written table.

    Rows go to parquet in shared storage, and offsets and state to a checkpoint
    beside it. Give both paths to go on where an earlier run stopped. ``conf`` holds
    settings for this stream, such as ROCKSDB.
    """
    spark = stream.sparkSession
    out = out or fresh_folder(spark, label)
    state = state or fresh_folder(spark, f"{label}-state")
    # A stream without any input writes nothing; the table exists all the same.
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(out)
    with settings(spark, conf or {}):
        query = (
            stream.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", state)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
