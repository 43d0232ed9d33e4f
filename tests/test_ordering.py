"""Dense numbers and ranks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from labmesh.operators.ordering import arranged, assign_keys, number_rows, rank_values
from tests.conftest import rows_of


@pytest.mark.parametrize("bits, span", [(32, 2**31 - 1), (64, 2**62)])
def test_numbers_follow_the_key(spark, bits, span):
    rng = random.Random(1)
    keys = {rng.randint(-span, span) for _ in range(2000)} | set(range(-50, 300)) | {-span - 1, span}
    df = spark.createDataFrame([(k,) for k in keys], "k int" if bits == 32 else "k long")
    expected = sorted((k, i) for i, k in enumerate(sorted(keys), start=11))
    got = sorted((r.k, r.n) for r in assign_keys(df, "k", "n", start=11).collect())
    assert got == expected


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(5000)
    one = rows_of(assign_keys(df.repartition(1), "id", "n"))
    assert one == rows_of(assign_keys(df.repartition(13), "id", "n"))


@pytest.mark.parametrize("kind", ["int", "long"])
def test_rows_without_a_key_and_equal_keys_are_numbered(spark, kind):
    keys = [1, None, 3, None, 3, -5, 2**31 - 1, -(2**31), None]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"k {kind}, i int")
    got = assign_keys(df, "k", "n").collect()
    assert sorted(r.n for r in got) == list(range(1, 10))
    in_order = [r.k for r in sorted(got, key=lambda r: r.n)]
    assert in_order == [None] * 3 + [-(2**31), -5, 1, 3, 3, 2**31 - 1]
    assert rows_of(assign_keys(df.repartition(5), "k", "n")) == rows_of(assign_keys(df, "k", "n"))


def test_ranks_with_ties(spark):
    rng = random.Random(2)
    values = [rng.choice([0, 0, 0, 5, -3, 70000, 2**31 - 1, -(2**31), rng.randint(0, 10**6)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v int")
    expected = sorted((v, 1 + sum(w > v for w in values)) for v in set(values))
    assert sorted((r.v, r.place) for r in rank_values(df, "v", "place").collect()) == expected


def test_no_window_over_the_whole_table(spark):
    df = spark.range(10)
    plan = assign_keys(df, "id", "n")._jdf.queryExecution().executedPlan().toString()
    # The only single-partition exchange holds block totals.
    assert plan.count("SinglePartition") <= 1


def shuffled(spark, rows, schema):
    rows = list(rows)
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(7)


def test_numbers_over_texts_dates_and_several_columns(spark):
    rows = [(random.Random(i).choice(["é", "a", "B", None, ""]), i % 13 or None, i) for i in range(700)]
    df = shuffled(spark, rows, "name string, day int, id int")
    order = [F.asc_nulls_last("name"), F.desc("day"), "id"]
    got = [r["id"] for r in sorted(number_rows(df, order, "n", start=5).collect(), key=lambda r: r["n"])]
    want = sorted(rows, key=lambda r: (r[0] is None, (r[0] or "").encode(), r[1] is None, -(r[1] or 0), r[2]))
    assert got == [r[2] for r in want]
    numbers = sorted(r["n"] for r in number_rows(df, order, "n", start=5).collect())
    assert numbers == list(range(5, 705))


def test_a_key_with_a_third_of_the_rows_is_cut(spark):
    """No range holds much more than its share, though one key has a third and another is NULL."""
    rows = [("hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i}", i) for i in range(6000)]
    df = shuffled(spark, rows, "key string, id int")
    out = number_rows(df, ["key"], "n")
    assert sorted(r["n"] for r in out.collect()) == list(range(1, 6001))
    files = [spark.read.parquet(f).count() for f in out.inputFiles()]
    assert len(files) >= 6 and max(files) < 2 * 6000 / 8
    names = [r["key"] for r in sorted(out.collect(), key=lambda r: r["n"])]
    assert names[:2000] == [None] * 2000 and names[2000:4000] == ["hot"] * 2000


def test_equal_rows_and_no_rows(spark):
    df = spark.createDataFrame([("a",)] * 30, "k string")
    assert sorted(r["n"] for r in number_rows(df, ["k"], "n").collect()) == list(range(1, 31))
    assert number_rows(df.limit(0), ["k"], "n").collect() == []


def test_positions_or_a_sort(spark):
    df = spark.createDataFrame([(2,), (1,)], "k int")
    assert [r["k"] for r in arranged(df, ["k"]).collect()] == [1, 2]
    assert rows_of(arranged(df, [F.desc("k")], "p")) == [(1, 2), (2, 1)]
