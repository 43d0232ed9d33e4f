"""Institution analytics."""

from __future__ import annotations

from decimal import Decimal

import pytest

from labmesh.plans import analytics
from tests.conftest import AS_OF, rows_of


def test_publication_ranks_share_and_skip(make):
    scores = [(1, 5), (1, 9), (2, 9), (3, 1)]
    df = make("Publication", *[{"PublicationID": i, "InstitutionID": n, "AltmetricScore": s} for i, (n, s) in enumerate(scores)])
    assert rows_of(analytics.publication_impact(df)) == [(1, 2, 7.0, 9, 1), (2, 1, 9.0, 9, 1), (3, 1, 1.0, 1, 3)]


def test_histogram(make):
    people = make("Participant", {"ParticipantID": 1, "InstitutionID": 1}, {"ParticipantID": 2, "InstitutionID": 1})
    grades = [(1, 1), (1, 3), (2, 5), (2, None), (9, 4)]
    events = make("AdverseEventReport", *[{"ReportID": i, "ParticipantID": p, "SeverityGrade": g} for i, (p, g) in enumerate(grades)])
    assert rows_of(analytics.adverse_event_histogram(people, events)) == [(1, 1, 0, 1, 0, 1, 4, 0.5)]


def test_efficiency_without_output_or_money(make):
    funding = make("Funding", {"FundingID": 1, "Disbursements": "2000000", "InstitutionID": 1}, {"FundingID": 2, "Disbursements": 0, "InstitutionID": 2})
    papers = make("Publication", {"PublicationID": 1, "InstitutionID": 1}, {"PublicationID": 2, "InstitutionID": 2})
    df = analytics.funding_efficiency(funding, papers, make("Patent"), make("Project"))
    got = rows_of(df, "InstitutionID", "Publications", "Patents", "Revenue", "PublicationsPerMillion", "RevenueRatio")
    assert got == [(1, 1, 0, Decimal("0.00"), 0.5, 0.0), (2, 1, 0, Decimal("0.00"), None, None)]


@pytest.mark.parametrize(
    "text, found",
    [
        ("Consulting for Pfizer", ["pfizer"]),
        ("pfizer, MERCK and others", ["merck", "pfizer"]),
        ("Stock in Blue Sky Labs", ["blue sky labs"]),
        ("Blue sky", []),
        ("Pfizerian studies", []),
        ("No conflicts", []),
        ("", []),
        (None, []),
    ],
)
def test_disclosures(make, text, found):
    labs = make(
        "CorporateLab",
        *[{"InstitutionID": i, "ParentCompany": c}
          for i, c in enumerate(["Pfizer Inc", "Merck & Co.", "Blue Sky Labs GmbH", "Inc.", "Pfizer AG"])],
    )
    people = make("Researcher", {"ResearcherID": 1, "COIDisclosure": text})
    got = rows_of(analytics.conflict_matches(people, labs), "Company", "Companies", "FirstInstitutionID")
    sizes = {"pfizer": (2, 0), "merck": (1, 1), "blue sky labs": (1, 2)}
    assert got == [(c, *sizes[c]) for c in found]


@pytest.mark.parametrize(
    "company, text, found",
    [
        ("SA Biotech", "Employed by Acme biotech", []),
        ("SA Biotech Ltd", "Shares in SA biotech.", ["sa biotech"]),
        ("Bank Co Partners", "Paid by Bank Co Partners", ["bank co partners"]),
        ("Corp Co Ltd", "Adviser of corp co ltd", ["corp co ltd"]),
    ],
)
def test_legal_forms_only_count_at_the_end(make, company, text, found):
    labs = make("CorporateLab", {"InstitutionID": 1, "ParentCompany": company})
    people = make("Researcher", {"ResearcherID": 1, "COIDisclosure": text})
    assert [r[0] for r in rows_of(analytics.conflict_matches(people, labs), "Company")] == found


def test_no_companies(make):
    people = make("Researcher", {"ResearcherID": 1, "COIDisclosure": "Pfizer"})
    assert analytics.conflict_matches(people, make("CorporateLab")).collect() == []


def test_trial_features(make):
    project = make(
        "Project",
        {"ProtocolID": 1, "InstitutionID": 1, "StartDate": "2025-06-25", "EndDate": "2025-12-25", "PrincipalInvestigatorID": 1},
        {"ProtocolID": 2, "InstitutionID": 2},
    )
    regulatory = make("Regulatory", {"RegulatorID": 1, "InstitutionID": 1, "FDAPhase": 3, "IRBApprovalDate": "2025-07-01"})
    people = make("Participant", {"ParticipantID": 1, "InstitutionID": 1}, {"ParticipantID": 2, "InstitutionID": 1})
    events = make("AdverseEventReport", {"ReportID": 1, "ParticipantID": 1, "SeverityGrade": 4})
    left = make("WithdrawalReason", {"ReasonID": 1, "ParticipantID": 2})
    funding = make("Funding", {"FundingID": 1, "InstitutionID": 1, "Disbursements": "5"})
    df = analytics.trial_features(project, regulatory, funding, people, events, left, AS_OF)
    first, second = rows_of(df)
    assert first == (1, 1, 183, 10, 4, 1, 3, 0, 1, Decimal("5.00"), 1, 4.0, 2, 1, 1)
    assert second == (2, 2, None, None, None, 0, 0, 0, 0, Decimal("0.00"), 0, 0.0, 0, 0, 0)


def test_a_filing_after_the_day_is_no_approval_yet(make):
    project = make("Project", {"ProtocolID": 1, "InstitutionID": 1})
    regulatory = make("Regulatory", {"InstitutionID": 1, "IRBApprovalDate": "2025-07-06"})
    rest = [make(n) for n in ("Funding", "Participant", "AdverseEventReport", "WithdrawalReason")]
    rows = rows_of(analytics.trial_features(project, regulatory, *rest, AS_OF), "DaysSinceApproval", "Filings")
    assert rows == [(None, 1)]


def dated(spark, kind, *rows):
    return spark.createDataFrame(list(rows), kind)


def test_features_know_nothing_of_the_future(spark, make):
    """Facts before, on and after the date of a trial, without a date, and of other sites."""
    project = make(
        "Project",
        {"ProtocolID": 1, "InstitutionID": 1, "StartDate": "2025-03-01", "EndDate": "2025-03-31", "PrincipalInvestigatorID": 9},
        {"ProtocolID": 2, "InstitutionID": 1, "StartDate": "2025-02-01", "PrincipalInvestigatorID": 9},
        {"ProtocolID": 3, "InstitutionID": 1, "PrincipalInvestigatorID": 9},
        {"ProtocolID": 4, "InstitutionID": 2, "StartDate": "2025-03-01"},
        {"ProtocolID": 5, "StartDate": "2025-03-01"},
    )
    regulatory = make(
        "Regulatory",
        {"InstitutionID": 1, "FDAPhase": 2, "IRBApprovalDate": "2025-02-27", "ExportRestriction": "EAR"},
        {"InstitutionID": 1, "FDAPhase": 4, "IRBApprovalDate": "2025-03-02"},
        {"InstitutionID": 1, "FDAPhase": 3, "IRBApprovalDate": "2025-03-01"},
    )
    funding = dated(spark, "InstitutionID int, Disbursements decimal(15,2), AwardDate string",
                    (1, Decimal(5), "2025-03-01"), (1, Decimal(7), "2025-03-02"), (1, Decimal(9), None))
    people = make("Participant", {"ParticipantID": 1, "InstitutionID": 1}, {"ParticipantID": 2, "InstitutionID": 2})
    events = dated(spark, "ParticipantID int, SeverityGrade int, ReportDate string",
                   (1, 4, "2025-02-10"), (1, 1, "2025-02-11"), (1, 5, "2025-04-01"), (1, None, "2025-02-10"), (2, 5, "2025-03-02"))
    left = dated(spark, "ParticipantID int, WithdrawalDate string", (1, "2025-02-15"), (1, "2025-03-15"))
    rows = rows_of(
        analytics.trial_features_known(project, regulatory, funding, people, events, left).drop("KnownAt", "PlannedDays")
    )
    nothing = (None,) * 10
    assert rows == [
        (1, 1, 0, 2, 3, 1, 1, Decimal("5.00"), 2, 2.5, 1, 2),
        (2, 1, None, 0, None, 0, 0, Decimal("0.00"), 0, None, 0, 1),
        (3, 1, *nothing),
        (4, 2, None, 0, None, 0, 0, Decimal("0.00"), 0, None, 0, None),
        (5, None, *nothing),
    ]
