"""Researcher workload."""

from __future__ import annotations

from decimal import Decimal

from labmesh.plans.workload import best_degree
from labmesh.reports import researcher_workload
from tests.conftest import AS_OF, rows_of


def staff(make, **change):
    post = {"StartDate": "2020-01-01", "ResearcherID": 1}
    tables = {
        "Researcher": make(
            "Researcher",
            {"ResearcherID": 1, "NIHHISID": "N1", "ORCID": "O1", "SecurityClearance": "Secret", "InstitutionID": 1},
        ),
        "Institution": make(
            "Institution", {"InstitutionID": 1, "LegalName": "Zeta"}, {"InstitutionID": 2, "LegalName": "Alpha"}
        ),
        "EmploymentHistory": make(
            "EmploymentHistory",
            {**post, "ExperienceRecordID": 1, "FTEPercentage": "0.50", "InstitutionID": 1},
            {**post, "ExperienceRecordID": 2, "FTEPercentage": "0.75", "InstitutionID": 2},
        ),
        "Project": make("Project", *[_project(i, "2026-01-01") for i in range(4)]),
        "Degree": make(
            "Degree",
            {"DegreeID": 1, "Year": 2000, "Field": "MD", "ResearcherID": 1},
            {"DegreeID": 2, "Year": 1990, "Field": "PhD Virology", "ResearcherID": 1},
        ),
    }
    return tables | change


def _project(key, end):
    return {"ProtocolID": key, "EndDate": end, "PrincipalInvestigatorID": 1}


def test_total_and_lists(make):
    (row,) = researcher_workload(staff(make), AS_OF).collect()
    assert row.asDict() == {
        "ResearcherID": 1,
        "NIHHISID": "N1",
        "ORCID": "O1",
        "SecurityClearance": "Secret",
        "InstitutionCount": 2,
        "ActiveProjectCount": 4,
        "TotalFTE": Decimal("1.25"),
        "TotalFTEPercent": Decimal("125.00"),
        "HighestQualification": "PhD Virology",
        "Institutions": "Alpha; Zeta",
    }


def test_posts_at_unknown_institutions_count_nowhere(make):
    post = {"StartDate": "2020-01-01", "ResearcherID": 1, "FTEPercentage": "0.50"}
    tables = staff(
        make,
        EmploymentHistory=make(
            "EmploymentHistory",
            {**post, "ExperienceRecordID": 1, "InstitutionID": 1},
            {**post, "ExperienceRecordID": 2, "InstitutionID": 99},
        ),
    )
    assert researcher_workload(tables, AS_OF).collect() == []
    (row,) = researcher_workload(tables, AS_OF, more_than_institutions=0).collect()
    assert (row.InstitutionCount, row.Institutions, row.TotalFTE) == (1, "Zeta", Decimal("0.50"))


def test_literal_query_counts_the_home_institution(make):
    df = researcher_workload(staff(make), AS_OF, "as_written")
    assert df.collect() == []
    assert "QualificationLevel" in df.columns


def test_three_projects_are_too_few(make):
    projects = make("Project", *[_project(i, "2026-01-01") for i in range(3)])
    assert researcher_workload(staff(make, Project=projects), AS_OF).isEmpty()


def test_project_ending_today_or_open_is_not_active(make):
    for end in ("2025-07-05", None):
        projects = make("Project", *[_project(i, "2026-01-01") for i in range(3)], _project(9, end))
        assert researcher_workload(staff(make, Project=projects), AS_OF).isEmpty()


def test_ended_post_does_not_count(make):
    posts = make(
        "EmploymentHistory",
        {"ExperienceRecordID": 1, "FTEPercentage": "0.5", "InstitutionID": 1, "ResearcherID": 1},
        {"ExperienceRecordID": 2, "FTEPercentage": "0.5", "InstitutionID": 2, "ResearcherID": 1, "EndDate": "2024-01-01"},
    )
    assert researcher_workload(staff(make, EmploymentHistory=posts), AS_OF).isEmpty()


def test_two_posts_at_one_institution_are_not_concurrent(make):
    post = {"FTEPercentage": "0.5", "InstitutionID": 1, "ResearcherID": 1}
    posts = make("EmploymentHistory", {**post, "ExperienceRecordID": 1}, {**post, "ExperienceRecordID": 2})
    assert researcher_workload(staff(make, EmploymentHistory=posts), AS_OF).isEmpty()


def test_repeated_institution_is_listed_once(make):
    post = {"FTEPercentage": "0.25", "ResearcherID": 1}
    posts = make(
        "EmploymentHistory", *[{**post, "ExperienceRecordID": i, "InstitutionID": n} for i, n in enumerate([1, 1, 2])]
    )
    (row,) = researcher_workload(staff(make, EmploymentHistory=posts), AS_OF).collect()
    assert (row.Institutions, row.TotalFTE) == ("Alpha; Zeta", Decimal("0.75"))


def test_no_degree(make):
    (row,) = researcher_workload(staff(make, Degree=make("Degree")), AS_OF).collect()
    assert row.HighestQualification is None


def test_degree_ties(make):
    rows = [(1, 2000, "Physics"), (2, 2010, "Chemistry"), (3, 2010, "Biology")]
    degrees = make("Degree", *[{"DegreeID": i, "Year": y, "Field": f, "ResearcherID": 7} for i, y, f in rows])
    assert rows_of(best_degree(degrees)) == [(7, "Chemistry")]


def test_degree_markers_ignore_case(make):
    rows = [(1, 2020, "Physics"), (2, 2010, "md"), (3, 1990, "phd Biology")]
    degrees = make("Degree", *[{"DegreeID": i, "Year": y, "Field": f, "ResearcherID": 7} for i, y, f in rows])
    assert rows_of(best_degree(degrees)) == [(7, "phd Biology")]
