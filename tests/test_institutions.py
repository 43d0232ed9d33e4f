"""Institution report: traps of the literal query, and its product form."""

from __future__ import annotations

import random
from decimal import Decimal

import duckdb
import pytest

from labmesh.reports import institution_funding
from tests.conftest import AS_OF


def network(make, **change):
    """One government site at the highest level with fan-out on every child."""
    tables = {
        "Location": make("Location", {"LocationID": 1, "BSLLabLevel": 4}, {"LocationID": 2, "BSLLabLevel": 3}),
        "Institution": make(
            "Institution",
            {"InstitutionID": 1, "LegalName": "A", "LocationID": 1, "Type": "Government"},
            {"InstitutionID": 2, "LegalName": "B", "LocationID": 2, "Type": "Government"},
            {"InstitutionID": 3, "LegalName": "C", "LocationID": 1, "Type": "Academic"},
        ),
        "Funding": make(
            "Funding",
            {"FundingID": 1, "Disbursements": 100, "InstitutionID": 1},
            {"FundingID": 2, "Disbursements": 50, "InstitutionID": 1},
            {"FundingID": 3, "Disbursements": 7, "InstitutionID": 2},
            {"FundingID": 4, "Disbursements": 9, "InstitutionID": 3},
        ),
        "Regulatory": make(
            "Regulatory",
            *[{"RegulatorID": i, "IRBApprovalDate": "2022-01-01", "FDAPhase": 3, "InstitutionID": n}
              for i, n in enumerate([1, 1, 2, 3])],
        ),
        "Project": make("Project", {"ProtocolID": 1, "InstitutionID": 1}, {"ProtocolID": 2, "InstitutionID": 1}),
        "Participant": make(
            "Participant",
            {"ParticipantID": 1, "InstitutionID": 1},
            {"ParticipantID": 2, "InstitutionID": 1},
            {"ParticipantID": 3, "InstitutionID": 2},
        ),
        "AdverseEventReport": make(
            "AdverseEventReport",
            {"ReportID": 1, "SeverityGrade": 1, "ParticipantID": 1},
            {"ReportID": 2, "SeverityGrade": 2, "ParticipantID": 1},
            {"ReportID": 3, "SeverityGrade": 4, "ParticipantID": 2},
        ),
    }
    return tables | change


def report(tables, mode="specified"):
    return [tuple(r) for r in institution_funding(tables, AS_OF, mode).collect()]


def test_children_do_not_multiply(make):
    (row,) = report(network(make))
    assert row[:2] == ("A", Decimal("150.00"))
    assert row[2] == pytest.approx(7 / 3)


def test_literal_fan_out(make):
    (row,) = report(network(make), "as_written")
    assert row == ("A", Decimal(150 * 2 * 2 * (2 + 1 + 1)), 2)


def _filings(make, *filings):
    return make(
        "Regulatory",
        *[{"RegulatorID": i, "IRBApprovalDate": d, "FDAPhase": p, "ExportRestriction": e, "InstitutionID": 1}
          for i, (d, p, e) in enumerate(filings)],
    )


@pytest.mark.parametrize(
    "other, kept", [("ITAR", False), ("EAR", False), ("EAR99", True), ("itar ", False), (None, True)]
)
def test_one_restricted_filing_excludes_the_site(make, other, kept):
    filings = _filings(make, ("2022-01-01", 3, None), ("2010-01-01", 1, other))
    tables = network(make, Regulatory=filings)
    assert bool(report(tables)) is kept
    # The literal query drops filings, not sites.
    assert len(report(tables, "as_written")) == 1


@pytest.mark.parametrize(
    "day, specified, literal", [("2020-07-04", 0, 0), ("2020-07-05", 1, 0), ("2020-07-06", 1, 1)]
)
def test_window_edge(make, day, specified, literal):
    tables = network(make, Regulatory=_filings(make, (day, 3, None)))
    assert len(report(tables)) == specified
    assert len(report(tables, "as_written")) == literal


def test_unknown_phase_does_not_qualify(make):
    assert report(network(make, Regulatory=_filings(make, ("2022-01-01", None, None)))) == []


def test_site_without_project(make):
    tables = network(make, Project=make("Project"))
    (row,) = report(tables)
    assert row[2] == pytest.approx(7 / 3)
    (row,) = report(tables, "as_written")
    assert row == ("A", Decimal("300.00"), None)


def test_no_participants(make):
    tables = network(make, Participant=make("Participant"))
    assert report(tables) == [("A", Decimal("150.00"), None)]
    assert report(tables, "as_written") == [("A", Decimal(150 * 2 * 2), None)]


def test_empty_tables_keep_the_schema(make):
    tables = {n: make(n) for n in network(make)}
    for mode in ("specified", "as_written"):
        df = institution_funding(tables, AS_OF, mode)
        assert df.columns == ["LegalName", "TotalFundingReceived", "AverageSeverityGrade"]
        assert df.collect() == []


LITERAL = """
SELECT i.LegalName, sum(f.Disbursements), sum(ae.SeverityGrade) // count(ae.SeverityGrade)
FROM Institution i JOIN Funding f ON i.InstitutionID = f.InstitutionID
JOIN Regulatory r ON i.InstitutionID = r.InstitutionID JOIN Location l ON i.LocationID = l.LocationID
LEFT JOIN Project p ON i.InstitutionID = p.InstitutionID LEFT JOIN Project ct ON p.ProtocolID = ct.ProtocolID
LEFT JOIN Participant pp ON ct.InstitutionID = f.InstitutionID
LEFT JOIN AdverseEventReport ae ON pp.ParticipantID = ae.ParticipantID
WHERE i.Type = 'Government' AND l.BSLLabLevel = 4 AND r.FDAPhase = 3
  AND (r.ExportRestriction IS NULL OR r.ExportRestriction NOT IN ('ITAR', 'EAR'))
  AND r.IRBApprovalDate >= TIMESTAMP '2025-07-05 12:00:00' - INTERVAL 5 YEAR
GROUP BY i.InstitutionID, i.LegalName
"""


@pytest.mark.parametrize("seed", range(6))
def test_product_form_equals_the_literal_join(make, seed):
    rng = random.Random(seed)
    ids = range(1, 5)

    def many(name, key, count, **columns):
        return make(name, *[{key: i, **{c: f() for c, f in columns.items()}} for i in range(1, count + 1)])

    site = lambda: rng.choice(ids)
    people = rng.choice([0, 3, 6])
    tables = {
        "Location": make("Location", *[{"LocationID": i, "BSLLabLevel": rng.choice([3, 4, 4])} for i in ids]),
        "Institution": make(
            "Institution",
            *[{"InstitutionID": i, "LegalName": f"I{i}", "LocationID": site(),
               "Type": rng.choice(["Government", "Government", "Academic"])} for i in ids],
        ),
        "Funding": many("Funding", "FundingID", 8, Disbursements=lambda: rng.randint(0, 99), InstitutionID=site),
        "Regulatory": many(
            "Regulatory", "RegulatorID", 10,
            IRBApprovalDate=lambda: rng.choice(["2020-07-05", "2020-07-06", "2024-01-01"]),
            FDAPhase=lambda: rng.choice([3, 3, 2, None]),
            ExportRestriction=lambda: rng.choice([None, "ITAR", "EAR99"]), InstitutionID=site,
        ),
        "Project": many("Project", "ProtocolID", rng.choice([0, 5]), InstitutionID=site),
        "Participant": many("Participant", "ParticipantID", people, InstitutionID=site),
        "AdverseEventReport": many(
            "AdverseEventReport", "ReportID", 7, SeverityGrade=lambda: rng.randint(1, 5),
            ParticipantID=lambda: rng.randint(1, 6),
        ),
    }
    db = duckdb.connect()
    for name, df in tables.items():
        arrow = df.toArrow()
        db.register(name, arrow)
    expected = sorted(db.execute(LITERAL).fetchall())
    got = sorted(report(tables, "as_written"))
    assert [(n, t, m) for n, t, m in got] == [(n, Decimal(t), None if m is None else int(m)) for n, t, m in expected]
