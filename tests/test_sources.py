"""Loading, completing and writing tables."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from labmesh.operators.violations import violation_rollup
from labmesh.reports import load_all
from labmesh.sources import scratch, tables
from labmesh.sources.schemas import TABLES
from tests.conftest import AS_OF, rows_of


def test_literal_rows_get_keys_in_order(spark):
    df = tables.literal_rows(spark, "ScreeningLog", ["ParticipantID"], [(7,), (5,), (6,)], start=3)
    assert rows_of(df, "LogID", "ParticipantID") == [(3, 7), (4, 5), (5, 6)]
    lab = tables.literal_rows(spark, "GovernmentFacility", ["InstitutionID", "AgencyAffiliation"], [(3, "X")])
    assert lab.columns == ["InstitutionID", "AgencyAffiliation"]


def test_append_continues_after_the_highest_key(spark):
    existing = spark.createDataFrame([(4,), (9,)], "LogID int")
    batch = spark.createDataFrame([(30,), (10,), (20,)], "ParticipantID int")
    out = tables.append_with_keys(existing, batch, "LogID", "ParticipantID")
    assert rows_of(out, "LogID", "ParticipantID") == [(10, 10), (11, 20), (12, 30)]
    assert rows_of(tables.append_with_keys(existing.limit(0), batch, "LogID", "ParticipantID"), "LogID") == [(1,), (2,), (3,)]


def test_defaults_fill_absent_columns_only(spark):
    batch = spark.createDataFrame([(1, None)], "LogID int, IsManualEntry boolean")
    out = tables.fill_defaults(batch, TABLES["TemperatureLog"].defaults, AS_OF)
    (row,) = out.collect()
    assert row.IsManualEntry is None and row.ReadingTime == datetime(2025, 7, 5, 12)


def test_evolution(spark):
    old = spark.createDataFrame([(1,)], "a int")
    new = spark.createDataFrame([(2, "x")], "a int, b string")
    assert rows_of(tables.evolve(old, new)) == [(1, None), (2, "x")]


def test_conform_types_enums_and_padding(spark):
    raw = spark.createDataFrame(
        [(1, "AB ", "0000-0001-2345-6789  ", "v", "c", "d", 1)],
        "ResearcherID long, NIHHISID string, ORCID string, VisaStatus string, SecurityClearance string, "
        "COIDisclosure string, InstitutionID long",
    )
    out = tables.conform(raw, TABLES["Researcher"])
    (row,) = out.collect()
    assert (row.NIHHISID, row.ORCID, row.IRBRenewalDate) == ("AB", "0000-0001-2345-6789", None)
    assert [f.dataType for f in out.schema] == [f.dataType for f in TABLES["Researcher"].schema]
    raw = spark.createDataFrame([(1, "government ", "x"), (2, "NGO", "y")], "InstitutionID int, Type string, LegalName string")
    raw = raw.withColumns({"DateFounded": F.lit("2000-01-01"), "TaxStatus": F.lit("FOR-PROFIT"), "LocationID": F.lit(1)})
    assert rows_of(tables.conform(raw, TABLES["Institution"]), "Type", "TaxStatus") == [
        ("Government", "For-Profit"),
        ("NGO", "For-Profit"),
    ]


def test_required_column_must_be_there(spark):
    with pytest.raises(ValueError, match="Address"):
        tables.conform(spark.createDataFrame([(1,)], "LocationID int"), TABLES["Location"])


def test_load_all(spark, make, tmp_path):
    make("Language", {"LanguageID": 1, "Name": "A"}).write.parquet(str(tmp_path / "Language.parquet"))
    got = load_all(spark, str(tmp_path), ["Language"])
    assert rows_of(got["Language"], "LanguageID", "Name") == [(1, "A")]


def test_replace_and_preview(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(10), path)
    tables.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    assert tables.preview(spark.read.parquet(path)).count() == 3


def test_missing_tables(spark):
    tables.replace_table(spark.range(1), table="Researcher")
    assert rows_of(tables.missing_tables(spark)) == [("Institution",), ("Participant",)]
    spark.sql("DROP TABLE Researcher")


def test_bucketed_tables_join_without_shuffle(spark):
    for name in ("left_rows", "right_rows"):
        tables.replace_table(spark.range(1000).withColumn("v", F.col("id")), table=name, bucket_by="id", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("left_rows").join(spark.table("right_rows"), "id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE left_rows")
        spark.sql("DROP TABLE right_rows")


def test_log_is_partitioned_by_day(spark, make, tmp_path):
    path = str(tmp_path / "log")
    log = make("TemperatureLog", *[{"LogID": i, "ReadingTime": f"2025-07-0{1 + i % 3} 00:00:00"} for i in range(9)])
    tables.write_log(log, path)
    kept = spark.read.parquet(path).where("ReadingDay >= '2025-07-03'")
    assert kept.count() == 3
    assert "PartitionFilters: [isnotnull(ReadingDay" in kept._jdf.queryExecution().executedPlan().toString()


def test_log_reads_only_the_days_asked_for(spark, make, tmp_path):
    path = str(tmp_path / "log")
    days = [f"2025-0{6 + i % 2}-0{1 + i} 00:00:00" for i in range(5)]
    log = make(
        "TemperatureLog",
        *[{"LogID": i, "FreezerID": 1, "ReadingTime": d, "ReadingValue": -10} for i, d in enumerate(days)],
    )
    tables.write_log(log, path)
    loaded = tables.load(spark, "TemperatureLog", path)
    out = violation_rollup(loaded, "2025-07-05 12:00:00")
    assert rows_of(out, "FreezerID", "ViolationCount") == [(1, 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ReadingDay" in plan


def test_other_columns_stay(spark, make, tmp_path):
    path = str(tmp_path / "people")
    make("Participant", {"ParticipantID": 1}).withColumn("Age", F.lit(40)).write.parquet(path)
    (row,) = tables.load(spark, "Participant", path).collect()
    assert (row.ParticipantID, row.Age) == (1, 40)


def test_loading_fills_declared_defaults(spark, make, tmp_path):
    path = str(tmp_path / "log")
    make("TemperatureLog", {"LogID": 1}).drop("ReadingTime", "IsManualEntry").write.parquet(path)
    (row,) = tables.load(spark, "TemperatureLog", path, AS_OF).collect()
    assert str(row.ReadingTime) == AS_OF and row.IsManualEntry is False


def test_only_scratch_is_discarded(spark, tmp_path):
    path = scratch.fresh_folder(spark, "gone")
    spark.range(3).write.parquet(path)
    scratch.discard(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    with pytest.raises(ValueError):
        scratch.discard(spark, str(tmp_path))


def test_empty_guard(spark):
    schema = TABLES["Participant"].schema
    assert tables.or_empty(spark.range(0), schema).schema == schema
    assert tables.or_empty(spark.range(2), schema).count() == 2


def test_shared_folder_is_the_named_one(spark):
    assert scratch.fresh_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


class Session:
    """Just what the folder lookup reads from a session."""

    def __init__(self, master, named=None):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self.master, self.applicationId = master, f"app-{master}"


def test_only_local_sessions_get_a_temporary_folder():
    assert scratch.shared_folder(Session("spark://host", "s3://shared/")) == "s3://shared"
    local = Session("local[2]")
    assert scratch.shared_folder(local) == scratch.shared_folder(local)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session("spark://host"))


def test_load_from_the_catalog(spark):
    from labmesh.sources import tables

    spark.createDataFrame([(1, 2, 5.0, "s")], "LogID long, FreezerID long, ReadingValue double, SensorID string").createOrReplaceTempView("TemperatureLog")
    try:
        row = tables.load(spark, "TemperatureLog", as_of="2025-01-01 00:00:00").first()
        assert (row["LogID"], str(row["ReadingTime"]), row["IsManualEntry"]) == (1, "2025-01-01 00:00:00", False)
    finally:
        spark.catalog.dropTempView("TemperatureLog")


def test_missing_tables_below_a_folder(spark, tmp_path):
    from labmesh.sources import tables

    spark.range(1).write.parquet(str(tmp_path / "Researcher.parquet"))
    missing = tables.missing_tables(spark, ["Researcher", "Participant"], root=str(tmp_path))
    assert [r[0] for r in missing.collect()] == ["Participant"]
