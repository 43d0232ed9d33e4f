"""Loading, completing and writing tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labmesh.functions import asof
from labmesh.functions.text import one_of
from labmesh.operators.ordering import assign_keys
from labmesh.sources.schemas import TABLES, Table


def load(spark: SparkSession, name: str, path: str | None = None, as_of: asof.AsOf | None = None) -> DataFrame:
    """A domain table from parquet or, without a path, from the catalog, in its declared schema.

    Columns that the files lack take their declared defaults; ``as_of`` is the
    time of those that default to the present.
    """
    table = TABLES[name]
    raw = spark.table(name) if path is None else spark.read.parquet(path)
    return conform(fill_defaults(raw, table.defaults, as_of), table)


def load_jdbc(
    spark: SparkSession,
    name: str,
    url: str,
    lower: int,
    upper: int,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A domain table from a database, read in parallel ranges of its key.

    ``lower`` and ``upper`` only set the stride; rows outside are read too.
    """
    table = TABLES[name]
    raw = spark.read.jdbc(
        url,
        name,
        column=table.key,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties or {},
    )
    return conform(raw, table)


def _canonical(field: T.StructField, table: Table) -> Column:
    """Cast to the declared type; drop padding; unify the spelling of enums."""
    value = F.col(field.name).cast(field.dataType)
    if field.name in table.padded:
        value = F.rtrim(value)
    if field.name in table.enums:
        # Values compare without regard to case and trailing blanks.
        chosen = F.when(F.lit(False), F.lit(None).cast("string"))
        for listed in table.enums[field.name]:
            chosen = chosen.when(one_of(value, [listed]), F.lit(listed))
        value = chosen.otherwise(value)
    return value.alias(field.name)


def conform(raw: DataFrame, table: Table) -> DataFrame:
    """Columns in declared order and type; absent nullable columns as NULL.

    Columns that are not declared follow as they are.
    """
    missing = [f.name for f in table.columns if f.name not in raw.columns and not f.nullable]
    if missing:
        raise ValueError(f"{table.name} lacks {', '.join(missing)}")
    return raw.select(
        *[
            _canonical(f, table) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in table.columns
        ],
        *[F.col(f"`{c}`") for c in raw.columns if c not in {f.name for f in table.columns}],
    )


def literal_rows(spark: SparkSession, name: str, columns: list[str], rows: list[tuple], start: int = 1) -> DataFrame:
    """Hand-written rows; a generated key counts up in the order given."""
    table = TABLES[name]
    fields = {f.name: f for f in table.columns}
    if table.generated_key and table.key not in columns:
        columns = [table.key, *columns]
        rows = [(start + i, *row) for i, row in enumerate(rows)]
    schema = T.StructType([T.StructField(c, fields[c].dataType, True) for c in columns])
    return spark.createDataFrame(rows, schema)


def fill_defaults(batch: DataFrame, defaults: dict[str, str], as_of: asof.AsOf | None = None) -> DataFrame:
    """Add default columns the batch lacks; a supplied NULL stays NULL."""
    now = "current_timestamp()" if as_of is None else asof.sql_literal(as_of)
    added = {c: F.expr(e.format(as_of=now)) for c, e in defaults.items() if c not in batch.columns}
    return batch.withColumns(added) if added else batch


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; a column that one side lacks is NULL there."""
    return old.unionByName(new, allowMissingColumns=True)


def append_with_keys(existing: DataFrame, batch: DataFrame, key: str, order_by: str) -> DataFrame:
    """The batch with keys that go on after the highest existing one."""
    highest = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).select("m").scalar()
    numbered = assign_keys(batch, order_by, "__n")
    return numbered.withColumn(key, F.col("__n") + highest).drop("__n")


def replace_table(
    df: DataFrame,
    path: str | None = None,
    table: str | None = None,
    by: Iterable[str] = (),
    bucket_by: str | None = None,
    buckets: int = 0,
) -> None:
    """Write ``df`` in place of whatever is there, to a path or a catalog table.

    ``by`` names partition columns. Tables bucketed by the same key and number
    join on that key without a shuffle; only catalog tables keep buckets.
    """
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    if table:
        writer.saveAsTable(table)
    else:
        writer.parquet(path)


def write_log(readings: DataFrame, path: str) -> None:
    """Append readings partitioned by day, so that recency filters skip days.

    Rebalancing gathers the rows of a day into few files and splits a day that
    is too large for one task.
    """
    dated = readings.withColumn("ReadingDay", F.to_date("ReadingTime")).hint("rebalance", "ReadingDay")
    dated.write.mode("append").partitionBy("ReadingDay").parquet(path)


def preview(df: DataFrame, rows: int = 3) -> DataFrame:
    return df.limit(rows)


def _readable(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def missing_tables(
    spark: SparkSession,
    names: Iterable[str] = ("Researcher", "Participant", "Institution"),
    root: str | None = None,
) -> DataFrame:
    """Names of required tables that the catalog does not hold or, with a root, no folder below it."""
    if root is None:
        absent = [(n,) for n in names if not spark.catalog.tableExists(n)]
    else:
        absent = [(n,) for n in names if not _readable(spark, f"{root}/{n}.parquet")]
    return spark.createDataFrame(absent, "table_name string")


def or_empty(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df``, or an empty table of the given schema if it holds no row."""
    return df.sparkSession.createDataFrame([], schema) if df.isEmpty() else df
