"""Concurrency, gaps and overlaps of posts."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from labmesh.operators.timelines import concurrent_posts, concurrent_researchers, employment_timeline
from tests.conftest import rows_of


def posts(make, *spans, person=1):
    return make(
        "EmploymentHistory",
        *[{"ExperienceRecordID": i, "ResearcherID": person, "InstitutionID": n, "StartDate": s, "EndDate": e}
          for i, (n, s, e) in enumerate(spans)],
    )


def test_overlap_and_touch(make):
    df = posts(make, (1, "2018-01-01", "2020-01-01"), (2, "2019-01-01", "2021-01-01"), (3, "2021-01-01", "2022-01-01"))
    assert rows_of(concurrent_posts(df), "ExperienceRecordID", "ConcurrentElsewhere") == [(0, 1), (1, 1), (2, 0)]
    assert rows_of(concurrent_researchers(df)) == [(1, 2, 1, 1)]


def test_same_institution_is_not_elsewhere(make):
    df = posts(make, (1, "2018-01-01", None), (1, "2019-01-01", None))
    assert concurrent_researchers(df).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_counts_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    start = date(2000, 1, 1)
    rows = []
    for i in range(400):
        # One researcher holds most posts, with many copies of few spans.
        person = 1 if rng.random() < 0.7 else rng.randint(2, 5)
        first = start + timedelta(days=rng.randint(0, 40))
        last = None if rng.random() < 0.3 else first + timedelta(days=rng.randint(0, 15))
        rows.append((i, person, rng.choice([1, 2, 3, None]), first, last))
    df = spark.createDataFrame(
        rows, "ExperienceRecordID int, ResearcherID int, InstitutionID int, StartDate date, EndDate date"
    )
    far = date(9999, 12, 31)
    spans = [(i, p, n, f, l or far) for i, p, n, f, l in rows if f < (l or far) and n is not None]
    expected = sorted(
        (i, sum(q == p and m != n and f < l2 and f2 < l for _, q, m, f2, l2 in spans)) for i, p, n, f, l in spans
    )
    assert rows_of(concurrent_posts(df), "ExperienceRecordID", "ConcurrentElsewhere") == sorted(expected, key=repr)


def test_timeline(make):
    df = posts(
        make,
        (1, "2010-01-01", "2012-01-01"),
        (2, "2011-01-01", "2011-06-01"),
        (3, "2012-01-02", "2013-01-01"),
        (4, "2014-01-01", None),
        (5, "2015-01-01", "2016-01-01"),
    )
    got = [(r.StartDate.year, r.GapDays, r.Transition) for r in employment_timeline(df).orderBy("StartDate").collect()]
    assert got[0] == (2010, None, None)
    assert got[1] == (2011, -365, "OVERLAP")
    # The longest earlier post counts, not the latest one.
    assert got[2] == (2012, 1, "CONTINUOUS")
    assert got[3] == (2014, 365, "GAP")
    assert got[4][2] == "OVERLAP"


def test_a_researcher_with_a_third_of_all_posts(spark, make, monkeypatch):
    """Hot scopes are summed per day before the window, and their marks are spread."""
    from labmesh.operators import lookup

    first = date(2020, 1, 1)
    rows = [
        {
            "ExperienceRecordID": i,
            "ResearcherID": 1 if i % 3 == 0 else i,
            "InstitutionID": i % 4,
            "StartDate": str(first + timedelta(days=i % 5)),
            "EndDate": None if i % 7 == 0 else str(first + timedelta(days=i % 5 + 1 + i % 11)),
        }
        for i in range(300)
    ]
    posts = make("EmploymentHistory", *rows)

    def plain():
        out = []
        for a in rows:
            end = a["EndDate"] or "9999-12-31"
            out.append(
                (
                    a["ExperienceRecordID"],
                    sum(
                        b["ResearcherID"] == a["ResearcherID"]
                        and b["InstitutionID"] != a["InstitutionID"]
                        and b["StartDate"] < end
                        and (b["EndDate"] or "9999-12-31") > a["StartDate"]
                        for b in rows
                    ),
                )
            )
        return sorted(out, key=repr)

    columns = ["ExperienceRecordID", "ConcurrentElsewhere"]
    assert rows_of(concurrent_posts(posts), *columns) == plain()
    monkeypatch.setattr(lookup, "ROWS_PER_TASK", 10)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = concurrent_posts(posts)
        assert "__salt" in found._jdf.queryExecution().toString()
        assert rows_of(found, *columns) == plain()
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_posts_shuffle_once(spark, make, monkeypatch):
    """Counting takes one shuffle of the posts, also where they are written and dealt to a number of tasks."""
    from labmesh.operators import timelines

    rows = [
        {"ExperienceRecordID": i % 250, "ResearcherID": None if i % 9 == 0 else i % 7, "InstitutionID": i % 3,
         "StartDate": f"2020-01-{i % 20 + 1:02d}", "EndDate": f"2020-02-{i % 11 + 1:02d}"}
        for i in range(300)
    ]
    posts = make("EmploymentHistory", *rows)
    small = concurrent_posts(posts)
    monkeypatch.setattr(timelines, "too_small_to_skew", lambda frame: False)
    large = concurrent_posts(posts)
    for found in (small, large):
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    # No researcher is too busy for a task, then all are.
    monkeypatch.setattr(timelines, "POSTS_PER_TASK", 5)
    split = concurrent_posts(posts)
    assert len(rows_of(small)) == 300 and rows_of(small) == rows_of(large) == rows_of(split)
