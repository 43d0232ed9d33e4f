"""Dense numbers and ranks over whole tables, without a single-task window.

Whole-number keys are cut into blocks of 65,536 consecutive values. A window
then sees either the values of one block or the blocks of one parent, never the
table. Keys of any kind are cut into ranges of about equal size, which are sorted and
written; the rows before each range come from the counts of the ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labmesh.sources.scratch import fresh_folder

BLOCK_BITS = 16
# Blocks for rows without a key.
NULL_BITS = 12
NULL_BLOCKS = 2**NULL_BITS


def _offsets(counts: DataFrame, bits: int) -> DataFrame:
    """Rows in lower blocks for each block of ``counts(block, n)``.

    ``bits`` is the width of a block number. A level holds at most 2**16 blocks
    per parent block.
    """
    if bits <= BLOCK_BITS:
        # At most 2**16 blocks in all.
        w = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("below"))
    parent = F.shiftright("block", BLOCK_BITS)
    w = Window.partitionBy("parent").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    nested = counts.select("block", "n", parent.alias("parent")).withColumn(
        "inner", F.coalesce(F.sum("n").over(w), F.lit(0))
    )
    parents = counts.groupBy(parent.alias("block")).agg(F.sum("n").alias("n"))
    outer = _offsets(parents, bits - BLOCK_BITS).select(F.col("block").alias("parent"), "below")
    return nested.join(outer, "parent").select("block", (F.col("below") + F.col("inner")).alias("below"))


def _width(df: DataFrame, column: str) -> int:
    """Bits of a whole-number column; the type is the proof of the bound."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return 32 if isinstance(df.schema[column].dataType, small) else 64


def assign_keys(rows: DataFrame, order_by: str, alias: str, start: int = 1) -> DataFrame:
    """Consecutive numbers from ``start`` in the order of a whole number, NULL first.

    Every row gets a number. Rows of equal keys, and those without one, are
    ordered by a hash of all their columns, so that a recomputed task numbers
    them alike; rows that are equal throughout are interchangeable. Rows without a
    key spread over blocks of their own by that hash.
    """
    bits = _width(rows, order_by)
    everything = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    lowest = -(2 ** (bits - BLOCK_BITS - 1))
    without = F.lit(lowest - NULL_BLOCKS) + F.shiftrightunsigned(everything, 64 - NULL_BITS)
    block = F.coalesce(F.shiftright(F.col(order_by).cast("bigint"), BLOCK_BITS), without)
    marked = rows.withColumns({"__tie": everything, "__block": block})
    counts = marked.groupBy(F.col("__block").alias("block")).agg(F.count("*").alias("n"))
    offsets = _offsets(counts, bits - BLOCK_BITS).select(F.col("block").alias("__block"), "below")
    if bits - BLOCK_BITS <= BLOCK_BITS:
        offsets = F.broadcast(offsets)  # at most 2**16 rows and the blocks without a key
    inside = F.row_number().over(Window.partitionBy("__block").orderBy(order_by, "__tie"))
    return (
        marked.withColumn("__inside", inside)
        .join(offsets, "__block")
        .withColumn(alias, (F.col("below") + F.col("__inside") + (start - 1)).cast("bigint"))
        .drop("__block", "__inside", "__tie", "below")
    )


def rank_values(rows: DataFrame, value: str, alias: str) -> DataFrame:
    """One row per distinct whole-number value with its rank, highest first.

    Equal rows share a rank and leave a gap after them.
    """
    # Descending order of the value is ascending order of its negation.
    distinct = (
        rows.where(F.col(value).isNotNull())
        .groupBy((-F.col(value).cast("bigint")).alias("v"))
        .agg(F.count("*").alias("n"))
    )
    block = F.shiftright("v", BLOCK_BITS)
    counts = distinct.groupBy(block.alias("block")).agg(F.sum("n").alias("n"))
    # A negated value needs one bit more.
    offsets = _offsets(counts, _width(rows, value) + 1 - BLOCK_BITS).select(F.col("block").alias("__block"), "below")
    w = Window.partitionBy("__block").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return (
        distinct.withColumn("__block", block)
        .withColumn("__above", F.coalesce(F.sum("n").over(w), F.lit(0)))
        .join(offsets, "__block")
        .select((-F.col("v")).alias(value), (F.col("below") + F.col("__above") + 1).cast("bigint").alias(alias))
    )


def number_rows(rows: DataFrame, order_by: Sequence[str | Column], alias: str, start: int = 1) -> DataFrame:
    """Consecutive numbers from ``start`` in the order of any columns, such as ``F.desc("x")``.

    Every row gets a number. Rows of equal keys are ordered by a hash of all their
    columns, which also cuts a key with many rows into several ranges; rows that are
    equal throughout are interchangeable. Ranges are sorted once and written to shared
    storage, so that counting and numbering see the same ranges. Their totals, one row
    per range, are the only thing that a window over everything sees.
    """
    spark = rows.sparkSession
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    keys = [F.col(k) if isinstance(k, str) else k for k in order_by] + [F.col("__tie")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__tie", tie).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # The low 33 bits of this number are the position in the range.
    placed = dealt.withColumns(
        {"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    ).drop("__tie")
    path = fresh_folder(spark, "numbered")
    placed.write.parquet(path)
    written = spark.read.schema(placed.schema).parquet(path)
    totals = written.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    below = totals.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__below"))
    # At most as many rows as there are shuffle partitions.
    numbered = written.join(F.broadcast(below), "__range")
    number = (F.col("__below") + F.col("__at") + start).cast("bigint")
    return numbered.withColumn(alias, number).drop("__range", "__at", "__below")


def arranged(rows: DataFrame, order_by: Sequence[str | Column], position: str | None = None) -> DataFrame:
    """The rows sorted or, if a column for it is named, with their position in that order."""
    return rows.orderBy(*order_by) if position is None else number_rows(rows, order_by, position)
