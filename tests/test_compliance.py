"""Renewal compliance."""

from __future__ import annotations

import pytest

from labmesh.reports import renewal_compliance
from tests.conftest import AS_OF


def trials(make, *dates, first="Ada"):
    return {
        "Project": make(
            "Project",
            *[{"ProtocolID": i, "ProjectTitle": f"T{i}", "InstitutionID": 2, "PrincipalInvestigatorID": i}
              for i in range(len(dates))],
        ),
        "Researcher": make(
            "Researcher",
            *[{"ResearcherID": i, "FirstName": first, "LastName": "Lee", "Email": "a@b", "InstitutionID": 1,
               "IRBRenewalDate": d} for i, d in enumerate(dates)],
        ),
        "Institution": make(
            "Institution",
            {"InstitutionID": 1, "LegalName": "Home", "Type": "Academic"},
            {"InstitutionID": 2, "LegalName": "Site", "Type": "Corporate"},
        ),
    }


DATES = [None, "2025-07-04", "2025-07-05", "2025-08-04", "2025-08-05"]


def test_states(make):
    got = {r.ProtocolID: (r.RenewalStatus, r.StatusColor[2:]) for r in renewal_compliance(trials(make, *DATES), AS_OF).collect()}
    assert got == {
        0: ("MISSING", "GREY"),
        1: ("PAST DUE", "RED"),
        2: ("DUE WITHIN 30 DAYS", "YELLOW"),
        3: ("DUE WITHIN 30 DAYS", "YELLOW"),
    }


def test_states_as_written(make):
    df = renewal_compliance(trials(make, *DATES), AS_OF, "as_written")
    got = {r.ProtocolID: (r.RenewalStatus, r.StatusColor[2:]) for r in df.collect()}
    assert got == {
        0: ("UP TO DATE", "GREEN"),
        1: ("PAST DUE", "RED"),
        2: ("PAST DUE", "RED"),
        3: ("DUE WITHIN 30 DAYS", "YELLOW"),
    }


def test_order(make):
    df = renewal_compliance(trials(make, None, "2025-08-01", "2025-01-01", "2025-07-10", "2024-01-01"), AS_OF)
    assert [r.ProtocolID for r in df.collect()] == [4, 2, 3, 1, 0]


def test_unknown_first_name_leaves_no_name(make):
    (row,) = renewal_compliance(trials(make, None, first=None), AS_OF).collect()
    assert row.PrincipalInvestigator is None


@pytest.mark.parametrize("via, name", [("pi", "Home"), ("project", "Site")])
def test_institution_source(make, via, name):
    (row,) = renewal_compliance(trials(make, None), AS_OF, institution_via=via).collect()
    assert row.Institution == name


@pytest.mark.parametrize("via, expected", [("pi", "Oncology; Virology"), ("project", "Surgery")])
def test_departments(make, via, expected):
    posts = [(1, "Virology", None), (1, "Oncology", None), (1, "Oncology", None), (1, "Old", "2020-01-01"), (2, "Surgery", None)]
    employment = make(
        "EmploymentHistory",
        *[{"ExperienceRecordID": i, "ResearcherID": 0, "InstitutionID": n, "Department": d, "EndDate": e}
          for i, (n, d, e) in enumerate(posts)],
    )
    (row,) = renewal_compliance(trials(make, None), AS_OF, institution_via=via, employment=employment).collect()
    assert row.Department == expected


def test_unknown_mode(make):
    with pytest.raises(ValueError):
        renewal_compliance(trials(make, None), AS_OF, "other")
