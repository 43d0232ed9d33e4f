"""Key indexes, checks of appended batches, and loads with good and bad rows apart."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labmesh.plans import quality
from labmesh.sources.keyindex import KeyIndex
from labmesh.sources.quarantine import Rejected, load_batch, mark_broken
from labmesh.sources.schemas import TABLES
from tests.conftest import AS_OF, rows_of


def held(index, batch, key="k"):
    return sorted(r[0] for r in index.held(batch, key).collect())


def test_the_index_is_exact(spark, tmp_path):
    table = spark.range(0, 3000).select((F.col("id") * 3).alias("k"))
    index = KeyIndex.create(table, "k", str(tmp_path / "i"), keys_per_bucket=100)
    assert index.buckets == 30
    asked = spark.range(0, 20_000).select("id", F.col("id").alias("k")).unionByName(spark.createDataFrame([(1, None)], "id long, k long"))
    assert held(index, asked) == list(range(0, 9000, 3))
    assert held(index, asked.where("k % 3 = 1")) == []
    assert held(index, asked.limit(0)) == []
    again = KeyIndex(spark, str(tmp_path / "i"))
    again.append(spark.createDataFrame([(10,), (10,), (None,)], "k long"), "k")
    assert held(again, asked.where("k in (9, 10, 11)")) == [9, 10]


def test_full_filters_only_cost_look_ups(spark, tmp_path):
    """With filters of a few bits nearly all keys seem to be there; the look-up stays exact."""
    table = spark.range(0, 500).select(F.concat(F.lit("key "), "id").alias("k"))
    index = KeyIndex.create(table, "k", str(tmp_path / "i"), keys_per_bucket=100, bits=64)
    asked = spark.range(400, 900).select(F.concat(F.lit("key "), "id").alias("k"))
    assert held(index, asked) == sorted(f"key {i}" for i in range(400, 500))


def test_an_empty_table_has_an_index(spark, tmp_path):
    empty = spark.createDataFrame([], "k int")
    index = KeyIndex.create(empty, "k", str(tmp_path / "i"))
    assert held(index, spark.range(5).select(F.col("id").cast("int").alias("k"))) == []
    index.append(spark.createDataFrame([(3,)], "k int"), "k")
    assert held(index, spark.range(5).select(F.col("id").cast("int").alias("k"))) == [3]


def test_a_batch_reads_neither_the_table_nor_other_buckets(spark, tmp_path):
    table = spark.range(0, 2000).withColumnRenamed("id", "k")
    table.write.parquet(str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    index = KeyIndex.create(table, "k", str(tmp_path / "i"), keys_per_bucket=50)
    found = index.held(spark.createDataFrame([(7,), (5000,)], "k long"), "k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "table") not in plan
    files = [f for f in found.inputFiles() if "/keys/" in f]
    every = spark.read.parquet(str(tmp_path / "i" / "keys")).inputFiles()
    assert "PartitionFilters: [isnotnull(bucket" in plan and len(every) >= 40
    assert rows_of(found) == [(7,)] and files


def test_append(spark, make, tmp_path):
    table = TABLES["Regulatory"]
    earlier = make("Regulatory", *[{"RegulatorID": i, "InstitutionID": 1} for i in range(1, 50)])
    own = KeyIndex.create(earlier, "RegulatorID", str(tmp_path / "own"), keys_per_bucket=10)
    parents = KeyIndex.create(make("Institution", {"InstitutionID": 1}), "InstitutionID", str(tmp_path / "parents"))
    batch = make(
        "Regulatory",
        {"RegulatorID": 49, "InstitutionID": 1},
        {"RegulatorID": 50, "InstitutionID": 9},
        {"RegulatorID": 51, "InstitutionID": 9},
        {"RegulatorID": 51},
    )
    out = quality.check_append(batch, table, own, {"InstitutionID": parents})
    assert rows_of(out, "rule_id", "row_key", "detail", "n_rows") == [
        ("InstitutionID_parent", "9", "no parent", 2),
        ("primary_key", "49", "known", 1),
        ("primary_key", "51", "duplicate", 2),
    ]


def freezers(make):
    good = {"FreezerName": "f", "LocationID": 1, "TemperatureRangeLow": "-80", "TemperatureRangeHigh": "-20", "BSLLevel": 2}
    return make(
        "Freezer",
        {"FreezerID": 1, **good, "SerialNumber": "a"},
        {"FreezerID": 2, **good, "SerialNumber": "B", "BSLLevel": 7, "LocationID": 5},
        {"FreezerID": 3, **good, "SerialNumber": "b "},
        {"FreezerID": 4, **good, "SerialNumber": "c"},
        {"FreezerID": 4, **good, "SerialNumber": "d", "FreezerName": None},
        {"FreezerID": None, **good, "SerialNumber": "e", "LocationID": None},
    )


EXPECTED = {
    "a": [],
    "B": ["LocationID_parent", "bsl_range", "unique_SerialNumber"],
    "b ": ["unique_SerialNumber"],
    "c": ["primary_key"],
    "d": ["FreezerName_required", "primary_key"],
    "e": ["FreezerID_required", "LocationID_required"],
}


def test_every_broken_rule_of_a_row(make):
    parents = {"LocationID": make("Location", {"LocationID": 1}).select("LocationID")}
    marked = mark_broken(freezers(make), TABLES["Freezer"], AS_OF, parents)
    assert marked.columns[-1] == "BrokenRules"
    assert {r["SerialNumber"]: r["BrokenRules"] for r in marked.collect()} == EXPECTED


def test_good_and_bad_rows_go_apart(make, spark, tmp_path):
    batch = freezers(make)
    parents = {"LocationID": KeyIndex.create(make("Location", {"LocationID": 1}), "LocationID", str(tmp_path / "p"))}
    earlier = KeyIndex.create(make("Freezer", {"FreezerID": 1}), "FreezerID", str(tmp_path / "o"))
    good, bad = load_batch(batch, TABLES["Freezer"], str(tmp_path / "a"), AS_OF, parents)
    assert good.columns == batch.columns and good.count() + bad.count() == batch.count()
    assert rows_of(good, "SerialNumber") == [("a",)]
    good, bad = load_batch(batch, TABLES["Freezer"], str(tmp_path / "b"), AS_OF, parents, earlier)
    assert good.collect() == [] and rows_of(bad.where("FreezerID = 1"), "BrokenRules") == [(["primary_key"],)]


def test_a_load_that_fails_names_the_rules(make, tmp_path):
    parents = {"LocationID": make("Location", {"LocationID": 1}).select("LocationID")}
    with pytest.raises(Rejected, match="Freezer.bsl_range: 1; .*Freezer.primary_key: 2"):
        load_batch(freezers(make), TABLES["Freezer"], str(tmp_path / "x"), AS_OF, parents, mode="fail")
    fine = freezers(make).where("FreezerID = 1")
    good, bad = load_batch(fine, TABLES["Freezer"], str(tmp_path / "y"), AS_OF, parents, mode="fail")
    assert good.count() == 1 and bad.collect() == []
    with pytest.raises(ValueError):
        load_batch(fine, TABLES["Freezer"], str(tmp_path / "z"), AS_OF, parents, mode="some")


def test_the_registry_reads_each_table_once(spark, make, tmp_path):
    tables = {}
    for name in ("Location", "Institution", "Freezer", "Biospecimen"):
        make(name).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    report = quality.check_all(tables, AS_OF)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == len(tables)
    assert report.collect() == []
