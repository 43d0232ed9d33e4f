"""Joins from many rows to one matching row, safe against hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labmesh.sources.scratch import fresh_folder

# Rows that one task should take at most. A key with more is hot, and its rows
# spread over as many tasks as they need at this size.
ROWS_PER_TASK = 2_000_000
# A list of hot keys up to this length is broadcast; its length is counted.
BROADCAST_KEYS = 200_000

_HOT = "__hot"
_SALT = "__salt"


def planned_bytes(df: DataFrame) -> int:
    """Spark's own size estimate for a plan, without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _bytes(setting: str) -> int:
    """A size setting such as 10485760b or 10MB as a number."""
    text = setting.lower().rstrip("b")
    units = {"k": 10, "m": 20, "g": 30}
    return int(text[:-1]) << units[text[-1]] if text[-1] in units else int(text)


def broadcast_limit(df: DataFrame) -> int:
    return _bytes(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10MB"))


def input_bytes(df: DataFrame) -> int:
    """Size estimate of everything a plan reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def fits_broadcast(df: DataFrame) -> bool:
    """True if ``df`` passes Spark's broadcast check, so that Spark will broadcast it."""
    return planned_bytes(df) <= broadcast_limit(df)


def too_small_to_skew(rows: DataFrame) -> bool:
    """True if all input together is less than one partition Spark calls skewed.

    A quarter leaves room for the growth of compressed files in memory.
    """
    name = "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"
    return input_bytes(rows) <= _bytes(rows.sparkSession.conf.get(name, "256MB")) // 4


def hot_keys(rows: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more rows than one task should take, and how many tasks they need.

    Counted once and written to the shared folder, since both sides of a join
    read the list. It has fewer keys than the table has ``rows_per_task`` of rows.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("__rows"))
    tasks = F.ceil(F.col("__rows") / rows_per_task).cast("int")
    hot = counted.where(F.col("__rows") > rows_per_task).select(*keys, tasks.alias(_HOT))
    path = fresh_folder(rows.sparkSession, "hot-keys")
    hot.write.parquet(path)
    listed = rows.sparkSession.read.schema(hot.schema).parquet(path)
    return F.broadcast(listed) if listed.count() <= BROADCAST_KEYS else listed


def _mark(df: DataFrame, keys: list[str], hot: DataFrame, hot_names: list[str]) -> DataFrame:
    renamed = hot.select(*[F.col(k).alias(n) for k, n in zip(hot.columns[:-1], hot_names)], _HOT)
    cond = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, hot_names)])
    return df.join(renamed, cond, "left").drop(*hot_names)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: str | list[str] | dict[str, str],
    spread_by: list[str],
    how: str = "inner",
    null_safe: bool = False,
    keys_from: DataFrame | None = None,
    strategy: str = "auto",
    rows_per_task: int | None = None,
) -> DataFrame:
    """Join ``rows`` to ``lookup``, which holds at most one row per key.

    ``on`` names the shared key columns, or maps row columns to lookup columns.
    ``how`` is inner, left, left_semi or left_anti. Columns of ``lookup`` that
    serve as keys are dropped from the result.

    A lookup that passes Spark's broadcast size check is left to Spark, and so
    are rows whose whole input is smaller than one skewed partition. Beyond
    that both sides shuffle, and the rows of a key with more than ``rows_per_task``
    are spread, by a hash of ``spread_by`` (columns that tell the rows of a key
    apart), over as many salts as they need, while its lookup row is repeated. The
    salt is a function of the row, so a recomputed task puts its rows where the
    lost one did. Counting the keys runs when the join is made.

    ``keys_from`` is a table to count keys in instead of ``rows``: the base that
    ``rows`` was joined from, so that counting does not repeat those joins.
    ``strategy`` "salt" or "plain" overrides the size check.
    """
    if isinstance(on, str):
        on = [on]
    pairs = on if isinstance(on, dict) else {k: k for k in on}
    keys = list(pairs)
    names = [f"__k{i}" for i in range(len(keys))]
    side = lookup.select(
        *[F.col(l).alias(n) for l, n in zip(pairs.values(), names)],
        *([] if how in ("left_semi", "left_anti") else [c for c in lookup.columns if c not in pairs.values()]),
    )

    def matches() -> Column:
        tests = [
            F.col(k).eqNullSafe(F.col(n)) if null_safe else F.col(k) == F.col(n) for k, n in zip(keys, names)
        ]
        return reduce(Column.__and__, tests)

    if strategy == "plain" or (strategy == "auto" and (fits_broadcast(side) or too_small_to_skew(rows))):
        return rows.join(side, matches(), how).drop(*names)

    hot = hot_keys(rows if keys_from is None else keys_from, keys, rows_per_task or ROWS_PER_TASK)
    hot_names = [f"__h{i}" for i in range(len(keys))]
    salted = _mark(rows, keys, hot, hot_names).withColumn(
        _SALT,
        F.when(F.col(_HOT).isNotNull(), F.pmod(F.xxhash64(*spread_by), F.col(_HOT)).cast("int")).otherwise(0),
    )
    copies = F.sequence(F.lit(0), F.coalesce(F.col(_HOT), F.lit(1)) - 1)
    repeated = _mark(side, names, hot, hot_names).withColumn("__copy", F.explode(copies)).drop(_HOT)
    cond = matches() & (F.col(_SALT) == F.col("__copy"))
    return salted.drop(_HOT).join(repeated, cond, how).drop(*names, _SALT, "__copy")
