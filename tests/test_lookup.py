"""Lookup joins with hot and missing keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labmesh.operators import lookup as module
from labmesh.operators.lookup import hot_keys, lookup_join
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share key 1, a third have no key."""
    key = F.when(F.col("id") < 3000, 1).when(F.col("id") < 6000, None).otherwise(F.col("id") % 500)
    return spark.range(9000).select(F.col("id").alias("row_id"), key.cast("long").alias("k"))


@pytest.fixture(scope="module")
def lookup(spark):
    return spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_equals_plain(skewed, lookup, how):
    plain = lookup_join(skewed, lookup, "k", ["row_id"], how, strategy="plain")
    salted = lookup_join(skewed, lookup, "k", ["row_id"], how, strategy="salt", rows_per_task=200)
    assert salted.columns == plain.columns
    assert rows_of(salted) == rows_of(plain)
    # And both equal what Spark's own join says.
    assert rows_of(plain) == rows_of(skewed.join(lookup, "k", how).select(*plain.columns))


def test_null_safe_keys_match(spark, skewed):
    groups = spark.createDataFrame([(None,), (7,)], "k long")
    plain = skewed.where("k is not null and k <> 7")
    out = lookup_join(skewed, groups, "k", ["row_id"], "left_anti", null_safe=True, strategy="salt", rows_per_task=200)
    assert rows_of(out) == rows_of(plain)


def test_keys_of_different_names(skewed, lookup):
    renamed = lookup.withColumnRenamed("k", "other")
    out = lookup_join(skewed, renamed, {"k": "other"}, ["row_id"], strategy="salt", rows_per_task=200)
    assert out.columns == ["row_id", "k", "v"]
    assert out.count() == lookup_join(skewed, lookup, "k", ["row_id"], strategy="plain").count()


def test_keys_counted_in_a_base_table(skewed, lookup):
    some = skewed.where("row_id < 7000")
    out = lookup_join(some, lookup, "k", ["row_id"], "left", keys_from=skewed, strategy="salt", rows_per_task=200)
    assert rows_of(out) == rows_of(lookup_join(some, lookup, "k", ["row_id"], "left", strategy="plain"))


def test_hot_keys_are_those_beyond_a_task(skewed):
    listed = {r[0]: r[1] for r in hot_keys(skewed, ["k"], 1000).collect()}
    assert listed == {1: 4, None: 3}
    assert hot_keys(skewed, ["k"]).count() == 0


def test_many_equally_hot_keys(spark):
    """2,000 keys of 20 rows each, more than a task should take."""
    rows = spark.range(40_000).select(F.col("id").alias("row_id"), (F.col("id") % 2000).alias("k"))
    assert hot_keys(rows, ["k"], 8).agg(F.count("*"), F.min("__hot"), F.max("__hot")).first() == (2000, 3, 3)
    side = spark.range(0, 2000, 2).select(F.col("id").alias("k"), (-F.col("id")).alias("v"))
    out = lookup_join(rows, side, "k", ["row_id"], "left", strategy="salt", rows_per_task=8)
    assert out.count() == 40_000 and out.where("v is null").count() == 20_000


def test_hot_rows_spread_over_tasks(spark, skewed, lookup):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        def largest(strategy):
            out = lookup_join(skewed, lookup, "k", ["row_id"], "left", strategy=strategy, rows_per_task=200)
            return out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

        assert largest("plain") > 3000
        assert largest("salt") < 1300
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_size_check_decides(spark, skewed, lookup):
    joined = lookup_join(skewed, lookup, "k", ["row_id"])
    assert "__salt" not in joined._jdf.queryExecution().toString()
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = lookup_join(skewed, lookup, "k", ["row_id"])
        assert module.ROWS_PER_TASK == 2_000_000
        assert "__salt" in joined._jdf.queryExecution().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)
