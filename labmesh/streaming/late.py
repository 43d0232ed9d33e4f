"""Late rows kept aside, so that what was delivered can be accounted for.

Stateful operators drop what their watermark has passed. Here each batch is split
before it reaches them: a row is late if it is not later than the watermark of its
batch, which is the latest time of all earlier batches less the delay. All rows are
written with that mark; operators read the others as a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labmesh.sources.scratch import fresh_folder
from labmesh.streaming.run import read_folder

LATE = "10 minutes"


def deliveries(
    stream: DataFrame, time: str, label: str, late: str = LATE, out: str | None = None, state: str | None = None
) -> DataFrame:
    """All rows that a stream delivers, with ``Late`` and the number of their ``Batch``.

    Rows without a time are not late. A batch that is repeated after a failure
    replaces what it wrote. Give both paths to go on where an earlier run stopped.
    """
    spark = stream.sparkSession
    out = out or fresh_folder(spark, label)
    state = state or fresh_folder(spark, f"{label}-state")
    schema = stream.withColumns({"Late": F.lit(False)}).schema
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{out}/Batch=-1")
    marks, mark_schema = f"{state}/marks", "Latest timestamp, Number long"
    spark.createDataFrame([], mark_schema).write.mode("append").parquet(f"{marks}/none")

    def split(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # One small row per batch; the latest time so far is in the one before.
        earlier = session.read.schema(mark_schema).option("recursiveFileLookup", "true").parquet(marks)
        before = earlier.where(F.col("Number") < number).agg(F.max("Latest").alias("Latest")).head()["Latest"]
        passed = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {late}")
        marked = batch.withColumn("Late", F.coalesce(F.col(time) <= passed, F.lit(False)))
        target = f"{out}/Batch={number}"
        marked.write.mode("overwrite").parquet(target)
        latest = session.read.schema(schema).parquet(target).agg(F.max(time).alias("Latest"))
        latest.select(F.greatest("Latest", F.lit(before).cast("timestamp")).alias("Latest"), F.lit(number).cast("long").alias("Number")).write.mode(
            "overwrite"
        ).parquet(f"{marks}/{number}")

    query = (
        stream.writeStream.foreachBatch(split)
        .option("checkpointLocation", f"{state}/stream")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(f"{_ddl(schema)}, Batch int").parquet(out)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def on_time(delivered: DataFrame, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The rows of a table that ``deliveries`` wrote that were not late, as a stream."""
    stream = read_folder(delivered.sparkSession, path, delivered.schema, files_per_batch)
    return stream.where(~F.col("Late")).drop("Late", "Batch")


def account(delivered: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Per key how often it was delivered: kept, late, or a duplicate of what was kept."""
    came = delivered.groupBy(key).agg(
        F.count("*").alias("Delivered"), F.count(F.when(F.col("Late"), 1)).alias("Late")
    )
    stayed = kept.groupBy(key).agg(F.count("*").alias("Kept"))
    kept_or_none = F.coalesce("Kept", F.lit(0))
    return came.join(stayed, key, "left").select(
        key,
        "Delivered",
        kept_or_none.alias("Kept"),
        (F.col("Delivered") - F.col("Late") - kept_or_none).alias("Duplicates"),
        "Late",
    )
