"""Constraint checks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labmesh.functions.text import valid_orcid
from labmesh.plans import quality
from labmesh.sources.schemas import TABLES
from tests.conftest import AS_OF, rows_of


def broken(df, name):
    out = quality._explode_rules(df, name, [TABLES[name].key], quality._check_tests(TABLES[name].rules(), AS_OF))
    return rows_of(out, "rule_id", "row_key")


@pytest.mark.parametrize(
    "name, column, good, bad, rule",
    [
        ("Location", "SquareFeet", "0.01", "0", "area_positive"),
        ("Location", "BSLLabLevel", 4, 5, "bsl_range"),
        ("Institution", "DateFounded", "2025-07-05", "2025-07-06", "founded_in_past"),
        ("Institution", "TaxStatus", "Nonprofit", "Other", "TaxStatus_listed"),
        ("Institution", "Type", "Academic", "Private", "Type_listed"),
        ("CorporateLab", "RnDBudget", "0", "-0.01", "budget_not_negative"),
        ("AcademicInstitution", "NumPhdPrograms", 0, -1, "programs_not_negative"),
        ("AcademicInstitution", "IRBApprovalCapacity", 0, -1, "capacity_not_negative"),
        ("GovernmentFacility", "SecurityClearLevel", "Top Secret", "None", "SecurityClearLevel_listed"),
        ("Researcher", "ORCID", "0000-0001-2345-678X", "0000-0000-2345-6789", "orcid_shape"),
        ("EmploymentHistory", "FTEPercentage", "1.00", "1.01", "fte_range"),
        ("Degree", "Year", 2025, 2026, "year_plausible"),
        ("Degree", "Year", 1901, 1900, "year_plausible"),
        ("Certification", "Year", 2025, 2026, "year_plausible"),
        ("Language", "ProficiencyLevel", 5, 0, "proficiency_range"),
        ("Publication", "AltmetricScore", 0, -1, "score_not_negative"),
        ("Publication", "EmbargoPeriod", "2025-07-05 12:00:01", "2025-07-05 12:00:00", "embargo_ahead"),
        ("Freezer", "TemperatureRangeLow", "-20", "-19.99", "low_bound"),
        ("Freezer", "TemperatureRangeHigh", "-196", "-196.01", "high_bound"),
        ("Freezer", "BSLLevel", 1, 0, "bsl_range"),
        ("Freezer", "MaintenanceSchedule", "Weekly", "Daily", "MaintenanceSchedule_listed"),
        ("Freezer", "Status", "Active", "Broken", "Status_listed"),
        ("Biospecimen", "AliquotCounts", 1, 0, "aliquots_positive"),
        ("DataSharing", "DeIdentificationMethod", "k-anonymity", "none", "DeIdentificationMethod_listed"),
        ("AdverseEventReport", "SeverityGrade", 5, 6, "grade_range"),
        ("Patent", "LicensingRevenue", "0", "-1", "revenue_not_negative"),
        ("Funding", "Disbursements", "0", "-1", "disbursement_not_negative"),
        ("Regulatory", "FDAPhase", 4, 5, "phase_range"),
    ],
)
def test_each_rule(make, name, column, good, bad, rule):
    key = TABLES[name].key
    df = make(name, {key: 1, column: good}, {key: 2, column: bad}, {key: 3, column: None})
    assert broken(df, name) == [(rule, "2")]


def test_rules_over_two_columns(make):
    posts = make(
        "EmploymentHistory",
        {"ExperienceRecordID": 1, "StartDate": "2020-01-01", "EndDate": "2020-01-02"},
        {"ExperienceRecordID": 2, "StartDate": "2020-01-01", "EndDate": "2020-01-01"},
        {"ExperienceRecordID": 3, "StartDate": "2020-01-01"},
    )
    assert broken(posts, "EmploymentHistory") == [("ends_after_start", "2")]
    freezers = make(
        "Freezer",
        {"FreezerID": 1, "Capacity": 5, "CurrentUtilization": 5},
        {"FreezerID": 2, "Capacity": 5, "CurrentUtilization": 6},
        {"FreezerID": 3, "CurrentUtilization": 6},
        {"FreezerID": 4, "LastCalibrationDate": "2025-01-01", "NextCalibrationDate": "2025-01-01"},
    )
    assert broken(freezers, "Freezer") == [("calibration_order", "4"), ("within_capacity", "2")]


def test_rule_count():
    assert sum(len(t.rules()) for t in TABLES.values()) == 30
    assert len(TABLES) == 25
    assert sum(len(t.references) for t in TABLES.values()) == 26


def test_unknown_passes_checks_but_not_required(make):
    df = make("Location", {"LocationID": 1})
    assert broken(df, "Location") == []
    out = quality.missing_values(df, "Location", ["LocationID"], ["Address", "SquareFeet", "BSLLabLevel"])
    assert [r[0] for r in rows_of(out, "rule_id")] == ["Address_required", "BSLLabLevel_required", "SquareFeet_required"]


def test_missing_values_of_a_unique_column_clash(make):
    df = make("Freezer", {"FreezerID": 1}, {"FreezerID": 2}, {"FreezerID": 3, "SerialNumber": "x"})
    out = quality.duplicate_keys(df, "Freezer", ["SerialNumber"])
    assert rows_of(out, "row_key", "n_rows") == [("NULL", 2)]


def test_unique_texts_ignore_case_and_trailing_blanks(make):
    names = [(1, "Shelf A"), (1, "shelf a "), (2, "Shelf A")]
    df = make("FreezerCompartment", *[{"CompartmentID": i, "FreezerID": f, "CompartmentName": n} for i, (f, n) in enumerate(names)])
    out = quality.duplicate_keys(df, "FreezerCompartment", ["FreezerID", "CompartmentName"])
    assert rows_of(out, "row_key", "n_rows") == [("1|shelf a", 2)]


def test_orphans_count_rows(make):
    child = make("Participant", *[{"ParticipantID": i, "InstitutionID": n} for i, n in enumerate([1, 9, 9, None])])
    parent = make("Institution", {"InstitutionID": 1})
    out = quality.orphans(child, "Participant", "InstitutionID", parent, "InstitutionID")
    assert rows_of(out, "row_key", "n_rows") == [("9", 2)]


def test_whole_registry(make):
    tables = {n: make(n) for n in TABLES}
    assert quality.check_all(tables, AS_OF).collect() == []
    tables["Location"] = make(
        "Location",
        {"LocationID": 1, "Address": "x" * 256, "SquareFeet": "1", "BSLLabLevel": 9},
        {"LocationID": 1, "Address": "y", "SquareFeet": "1", "BSLLabLevel": 1},
    )
    tables["Freezer"] = make(
        "Freezer",
        {"FreezerID": 1, "FreezerName": "f", "LocationID": 2, "TemperatureRangeLow": "-80", "TemperatureRangeHigh": "-20",
         "BSLLevel": 2, "Status": "Active"},
    )
    got = rows_of(quality.check_all(tables, AS_OF), "table_name", "rule_id", "row_key", "n_rows")
    assert got == [
        ("Freezer", "LocationID_parent", "2", 1),
        ("Location", "Address_length", "1", 1),
        ("Location", "bsl_range", "1", 1),
        ("Location", "primary_key", "1", 2),
    ]


def test_caller_may_refuse_a_load(make):
    tables = {"Location": make("Location", *[{"LocationID": i, "Address": "a", "SquareFeet": "1", "BSLLabLevel": i} for i in (1, 7, 8)])}
    with pytest.raises(ValueError, match="Location.bsl_range: 2"):
        quality.require_none(quality.check_all(tables, AS_OF))
    quality.require_none(quality.check_all({"Location": tables["Location"].where("LocationID = 1")}, AS_OF))


def test_cascade(make):
    labs = make("CorporateLab", {"InstitutionID": 1}, {"InstitutionID": 2})
    gone = make("Institution", {"InstitutionID": 2})
    assert rows_of(quality.cascade_delete(labs, "InstitutionID", gone, "InstitutionID", ["InstitutionID"]), "InstitutionID") == [(1,)]


def test_registry_names_what_a_deletion_takes_along(make):
    tables = {
        "Institution": make("Institution", {"InstitutionID": 1}, {"InstitutionID": 2}),
        "CorporateLab": make("CorporateLab", {"InstitutionID": 1}, {"InstitutionID": 2}),
        "GovernmentFacility": make("GovernmentFacility", {"InstitutionID": 2}),
        "Project": make("Project", {"ProtocolID": 7, "InstitutionID": 2}),
    }
    out = quality.cascade(tables, "Institution", make("Institution", {"InstitutionID": 2}))
    assert {n: rows_of(df, "InstitutionID") for n, df in out.items()} == {
        "Institution": [(1,)], "CorporateLab": [(1,)], "GovernmentFacility": [],
    }


def test_valid_rows_keep_unknowns(make):
    df = make("Location", {"LocationID": 1, "BSLLabLevel": 9}, {"LocationID": 2}, {"LocationID": 3, "BSLLabLevel": 1})
    assert rows_of(quality.valid_rows(df, TABLES["Location"].rules(), AS_OF), "LocationID") == [(2,), (3,)]


def test_subtypes(make):
    parents = [(1, "Academic"), (2, "Corporate"), (3, "Government"), (4, "Academic"), (5, "Academic"), (6, "Corporate")]
    institution = make("Institution", *[{"InstitutionID": i, "LegalName": f"I{i}", "Type": t} for i, t in parents])
    academic = make("AcademicInstitution", *[{"InstitutionID": i, "NumPhdPrograms": i} for i in (1, 5, 6)])
    corporate = make("CorporateLab", *[{"InstitutionID": i, "ParentCompany": "P"} for i in (2, 5, 8)])
    government = make("GovernmentFacility", {"InstitutionID": 3, "AgencyAffiliation": "G"})
    out = quality.subtype_violations(institution, academic, corporate, government)
    assert rows_of(out, "row_key", "rule_id", "detail") == [
        ("4", "subtype_missing", ""),
        ("5", "subtypes_overlap", "Academic,Corporate"),
        ("6", "subtype_disagrees", "Academic"),
        ("8", "subtype_without_parent", "Corporate"),
    ]
    wide = quality.institution_wide(institution, academic, corporate, government)
    assert rows_of(wide.where("InstitutionID <= 3"), "InstitutionID", "NumPhdPrograms", "ParentCompany", "AgencyAffiliation") == [
        (1, 1, None, None),
        (2, None, "P", None),
        (3, None, None, "G"),
    ]


def test_containment(make):
    location = make("Location", {"LocationID": 1, "BSLLabLevel": 2})
    freezers = make("Freezer", *[{"FreezerID": i, "LocationID": 1, "BSLLevel": i} for i in (1, 2, 3)])
    assert rows_of(quality.containment_violations(freezers, location)) == [(3, 1, 3, 2)]


def test_orcid(spark):
    texts = ["0000-0001-2345-6789", "0000-0001-2345-678X", "0000-0000-2345-6789", "0000-0001-2345-6789X", "0000-0001-2345-6789 "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.v for r in df.orderBy("i").select(valid_orcid(F.col("t")).alias("v")).collect()] == [True, True, False, False, True]


def test_the_registry_check_counts_all_tables_together(make):
    """One aggregation and one look-up, however many tables there are."""
    from labmesh.plans.quality import check_all
    from labmesh.sources.schemas import TABLES

    tables = {name: make(name) for name in ("Institution", "Researcher", "Project", "Funding", "Patent")}
    tables["Patent"] = make("Patent", {"PatentID": 1, "InstitutionID": 4}, {"PatentID": 1, "InstitutionID": 5})
    tables["Institution"] = make("Institution", {"InstitutionID": 4})
    assert set(tables) <= set(TABLES)
    found = check_all(tables, "2025-07-05 12:00:00")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
    got = [tuple(r) for r in found.where("table_name = 'Patent' AND rule_id IN ('primary_key', 'InstitutionID_parent')").collect()]
    assert sorted(got) == [
        ("Patent", "InstitutionID_parent", "5", "no parent", 1),
        ("Patent", "primary_key", "1", "duplicate", 2),
    ]
