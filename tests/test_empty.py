"""Every report and job on empty tables: no rows, full schema."""

from __future__ import annotations

import pytest

from labmesh import reports
from labmesh.operators import runs, timelines
from labmesh.plans import analytics, quality
from labmesh.sources.schemas import TABLES
from tests.conftest import AS_OF

REPORTS = [reports.institution_funding, reports.researcher_workload, reports.renewal_compliance]

JOBS = {
    "custody": lambda t: reports.specimen_custody(t, AS_OF),
    "custody at location": lambda t: reports.specimen_custody(t, AS_OF, scope="location"),
    "trials": lambda t: reports.specimen_trials(t, AS_OF),
    "posts": lambda t: timelines.concurrent_posts(t["EmploymentHistory"]),
    "researchers": lambda t: timelines.concurrent_researchers(t["EmploymentHistory"]),
    "timeline": lambda t: timelines.employment_timeline(t["EmploymentHistory"]),
    "runs": lambda t: runs.violation_runs(t["TemperatureLog"], 3),
    "impact": lambda t: analytics.publication_impact(t["Publication"]),
    "histogram": lambda t: analytics.adverse_event_histogram(t["Participant"], t["AdverseEventReport"]),
    "efficiency": lambda t: analytics.funding_efficiency(t["Funding"], t["Publication"], t["Patent"], t["Project"]),
    "conflicts": lambda t: analytics.conflict_matches(t["Researcher"], t["CorporateLab"]),
    "subtypes": lambda t: quality.subtype_violations(
        t["Institution"], t["AcademicInstitution"], t["CorporateLab"], t["GovernmentFacility"]
    ),
    "wide": lambda t: quality.institution_wide(
        t["Institution"], t["AcademicInstitution"], t["CorporateLab"], t["GovernmentFacility"]
    ),
    "containment": lambda t: quality.containment_violations(t["Freezer"], t["Location"]),
}


@pytest.fixture(scope="module")
def empty(make):
    return {name: make(name) for name in TABLES}


@pytest.mark.parametrize("mode", reports.MODES)
@pytest.mark.parametrize("report", REPORTS)
def test_reports(empty, report, mode):
    df = report(empty, AS_OF, mode)
    assert len(df.columns) >= 3 and df.collect() == []


@pytest.mark.parametrize("name", JOBS)
def test_jobs(empty, name):
    df = JOBS[name](empty)
    assert len(df.columns) >= 3 and df.collect() == []
