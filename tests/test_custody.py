"""Chain of custody."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from labmesh.operators.violations import violation_rollup
from labmesh.reports import specimen_custody, specimen_trials
from tests.conftest import AS_OF, rows_of


def lab(make, **change):
    reading = {"SensorID": "s"}
    tables = {
        "Location": make("Location", {"LocationID": 1, "Address": "North"}, {"LocationID": 2, "Address": "South"}),
        "Freezer": make(
            "Freezer",
            {"FreezerID": 1, "FreezerName": "F1", "LocationID": 1},
            {"FreezerID": 2, "FreezerName": "F2", "LocationID": 1},
            {"FreezerID": 3, "FreezerName": "F3", "LocationID": 2},
        ),
        "TemperatureLog": make(
            "TemperatureLog",
            *[{**reading, "LogID": i, "FreezerID": f, "ReadingValue": v, "ReadingTime": t}
              for i, (f, v, t) in enumerate([
                  (1, "-70.00", "2025-07-01 00:00:00"),
                  (1, "-70.01", "2025-07-02 00:00:00"),
                  (1, "-69.99", "2025-07-03 00:00:00"),
                  (1, "-10.00", "2025-06-27 12:00:00"),
                  (1, "-10.00", "2025-07-05 12:00:01"),
                  (2, "-80.00", "2025-07-01 00:00:00"),
                  (3, "-60.00", "2025-06-28 11:59:59"),
              ])],
        ),
        "Biospecimen": make(
            "Biospecimen",
            {"RepositoryID": 1, "AliquotCounts": 5, "InstitutionID": 1, "FreezerID": 1},
            {"RepositoryID": 2, "AliquotCounts": 6, "InstitutionID": 2, "FreezerID": 1},
            {"RepositoryID": 3, "AliquotCounts": 7, "InstitutionID": 3, "FreezerID": 2},
        ),
        "Project": make(
            "Project",
            {"ProtocolID": 1, "ProjectTitle": "T1", "InstitutionID": 1, "PrincipalInvestigatorID": 1},
            {"ProtocolID": 2, "ProjectTitle": "T2", "InstitutionID": 2, "PrincipalInvestigatorID": 1},
            {"ProtocolID": 3, "ProjectTitle": "T3", "InstitutionID": 2, "PrincipalInvestigatorID": None},
        ),
        "Researcher": make("Researcher", {"ResearcherID": 1, "FirstName": "A", "LastName": "B", "Email": "e"}),
    }
    return tables | change


def test_rollup_edges(make):
    (row,) = violation_rollup(lab(make)["TemperatureLog"], AS_OF).collect()
    assert (row.FreezerID, row.MaxViolationTemp, row.ViolationCount) == (1, Decimal("-69.99"), 2)
    assert (row.FirstViolation.day, row.LastViolation.day) == (1, 3)


def test_window_start_is_included(make):
    log = make("TemperatureLog", {"LogID": 1, "FreezerID": 3, "ReadingValue": "-60", "ReadingTime": "2025-06-28 12:00:00"})
    assert violation_rollup(log, AS_OF).count() == 1


def test_specimens_of_the_violating_freezer(make):
    df = specimen_custody(lab(make), AS_OF, scope="freezer")
    got = rows_of(df, "RepositoryID", "Location", "CandidateTrials", "ProtocolID", "PrincipalInvestigator")
    # One trial at the institution is the origin; of two neither is certain.
    assert got == [(1, "North", 1, 1, "A B"), (2, "North", 2, None, None)]


def test_location_scope_adds_its_other_freezers(make):
    df = specimen_custody(lab(make), AS_OF)
    got = rows_of(df, "RepositoryID", "FreezerID", "ViolationCount", "CandidateTrials")
    assert got == [(1, 1, 2, 1), (2, 1, 2, 2), (3, 2, None, 0)]


def test_specimen_that_names_its_trial(make):
    tables = lab(make)
    named = tables["Biospecimen"].withColumn("ProtocolID", F.when(F.col("RepositoryID") == 2, 3).otherwise(1))
    df = specimen_custody(tables | {"Biospecimen": named}, AS_OF, scope="freezer")
    assert rows_of(df, "RepositoryID", "ProtocolID", "ProjectTitle", "PI_Contact") == [(1, 1, "T1", "e"), (2, 3, "T3", None)]


def test_candidate_trials(make):
    got = rows_of(specimen_trials(lab(make), AS_OF, scope="freezer"), "ProtocolID", "AffectedSpecimens", "AffectedAliquots", "PI_Contact")
    assert got == [(1, 1, 5, "e"), (2, 1, 6, "e"), (3, 1, 6, None)]


def test_specimens_and_trials_together_give_every_pair(make):
    tables = lab(make)
    specimens = specimen_custody(tables, AS_OF, scope="freezer").select("RepositoryID", "InstitutionID")
    pairs = specimens.join(specimen_trials(tables, AS_OF, scope="freezer").select("ProtocolID", "InstitutionID"), "InstitutionID")
    assert rows_of(pairs, "RepositoryID", "ProtocolID") == [(1, 1), (2, 2), (2, 3)]


def test_filter_reaches_the_scan(spark, make, tmp_path):
    path = str(tmp_path / "log")
    lab(make)["TemperatureLog"].write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = violation_rollup(spark.read.parquet(path), AS_OF)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "GreaterThanOrEqual(ReadingTime" in pushed and "GreaterThanOrEqual(ReadingValue" in pushed
    assert "SensorID" not in plan


def test_empty_tables_keep_the_schema(make):
    tables = {n: make(n) for n in lab(make)}
    for scope in ("freezer", "location"):
        df = specimen_custody(tables, AS_OF, scope=scope)
        assert df.collect() == []
        assert df.columns == specimen_custody(lab(make), AS_OF, scope=scope).columns
