"""Researcher workload: concurrent posts, active projects, best degree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labmesh.functions import asof
from labmesh.functions.text import holds
from labmesh.operators.aggregates import best_per_group
from labmesh.operators.lookup import lookup_join
from labmesh.operators.ordering import arranged

FTE_TOTAL = "decimal(38,2)"


def degree_rank(first: str = "PhD", second: str = "MD") -> Column:
    """Rank of a degree by the marker its field contains."""
    held = F.col("Field")
    return F.when(holds(held, first), 1).when(holds(held, second), 2).otherwise(3)


def best_degree(degree: DataFrame, first: str = "PhD", second: str = "MD") -> DataFrame:
    """One row per researcher: the field of the highest degree.

    Equal ranks go to the later year, then to the lower key.
    """
    order = [degree_rank(first, second), -F.col("Year"), F.col("DegreeID")]
    return best_per_group(degree, ["ResearcherID"], order, "Field", "HighestQualification")


def active_leads(project: DataFrame, as_of: asof.AsOf, more_than: int = 3, by_day: bool = True) -> DataFrame:
    """Investigators leading more than a number of projects that end later."""
    return (
        project.where(asof.after(F.col("EndDate"), as_of, by_day) & F.col("PrincipalInvestigatorID").isNotNull())
        .groupBy(F.col("PrincipalInvestigatorID").alias("ResearcherID"))
        .agg(F.count("*").alias("ActiveProjectCount"))
        .where(F.col("ActiveProjectCount") > more_than)
    )


def distinct_employers(employment: DataFrame, departments: bool = True) -> DataFrame:
    """Per researcher with current posts: how many different institutions, and departments."""
    current = employment.where(F.col("EndDate").isNull() & F.col("ResearcherID").isNotNull())
    return current.groupBy("ResearcherID").agg(
        F.count_distinct("InstitutionID").alias("Institutions"),
        *([F.count_distinct("Department").alias("Departments")] if departments else []),
        F.count("*").alias("Posts"),
    )


def _current_posts(employment: DataFrame, institution: DataFrame) -> DataFrame:
    """One row per researcher and known institution of the current posts.

    A post at an institution without a master row counts nowhere.
    """
    posts = (
        employment.where(F.col("EndDate").isNull() & F.col("InstitutionID").isNotNull())
        .groupBy("ResearcherID", "InstitutionID")
        .agg(F.sum("FTEPercentage").cast(FTE_TOTAL).alias("__fte"))
    )
    named = institution.select("InstitutionID", "LegalName")
    return lookup_join(posts, named, "InstitutionID", spread_by=["ResearcherID"])


def workload_report(
    researcher: DataFrame,
    employment: DataFrame,
    project: DataFrame,
    degree: DataFrame,
    institution: DataFrame,
    as_of: asof.AsOf,
    more_than_projects: int = 3,
    more_than_institutions: int = 1,
    degree_markers: tuple[str, str] = ("PhD", "MD"),
    position: str | None = None,
) -> DataFrame:
    """One row per researcher with several current institutions and projects.

    Sorted by projects and share, or with the place in that order in ``position``.

    Posts shrink to one row per researcher and institution before any join, so
    the institution list is distinct and holds no more names than there are
    institutions.
    """
    # Few researchers lead so many projects: the others leave before anything is grouped.
    leads = active_leads(project, as_of, more_than_projects)
    led_by = leads.select("ResearcherID")
    employment = employment.join(led_by, "ResearcherID", "left_semi")
    degree = degree.join(led_by, "ResearcherID", "left_semi")
    load = (
        _current_posts(employment, institution)
        .groupBy("ResearcherID")
        .agg(
            F.count("InstitutionID").alias("InstitutionCount"),
            F.sum("__fte").cast(FTE_TOTAL).alias("TotalFTE"),
            F.expr("listagg(DISTINCT LegalName, '; ') WITHIN GROUP (ORDER BY LegalName)").alias("Institutions"),
        )
        .where(F.col("InstitutionCount") > more_than_institutions)
    )
    rows = (
        researcher.select("ResearcherID", "NIHHISID", "ORCID", "SecurityClearance")
        .join(load, "ResearcherID")
        .join(leads, "ResearcherID")
        .join(best_degree(degree, *degree_markers), "ResearcherID", "left")
    )
    order = [F.desc("ActiveProjectCount"), F.desc("TotalFTE"), "ResearcherID"]
    return arranged(rows, order, position).select(
        "ResearcherID",
        "NIHHISID",
        "ORCID",
        "SecurityClearance",
        "InstitutionCount",
        "ActiveProjectCount",
        "TotalFTE",
        F.round(F.col("TotalFTE") * 100, 2).cast(FTE_TOTAL).alias("TotalFTEPercent"),
        "HighestQualification",
        "Institutions",
        *([position] if position else []),
    )


def workload_report_as_written(
    researcher: DataFrame,
    employment: DataFrame,
    project: DataFrame,
    degree: DataFrame,
    institution: DataFrame,
    as_of: asof.AsOf,
    more_than_projects: int = 3,
    degree_markers: tuple[str, str] = ("PhD", "MD"),
) -> DataFrame:
    """The literal report, which counts the home institution of a researcher.

    A researcher has one home institution, so the count never exceeds one and
    the result is empty on any table whose key holds.
    """
    current = employment.where(F.col("EndDate").isNull())
    concurrent = (
        researcher.select("ResearcherID", "NIHHISID", "ORCID", "InstitutionID")
        .join(current.select("ResearcherID").distinct(), "ResearcherID", "left_semi")
        .groupBy("ResearcherID", "NIHHISID", "ORCID")
        .agg(F.count_distinct("InstitutionID").alias("InstitutionCount"))
        .where(F.col("InstitutionCount") > 1)
        .select("ResearcherID", "InstitutionCount")
    )
    posts = lookup_join(
        current.join(concurrent, "ResearcherID", "left_semi")
        .groupBy("ResearcherID", "InstitutionID")
        .agg(
            F.sum("FTEPercentage").cast(FTE_TOTAL).alias("__fte"), F.count("*").alias("__posts")
        ),
        institution.select("InstitutionID", "LegalName"),
        "InstitutionID",
        spread_by=["ResearcherID"],
    )
    load = posts.groupBy("ResearcherID").agg(
        F.sum("__fte").cast(FTE_TOTAL).alias("TotalFTE"),
        F.expr(
            "listagg(array_join(array_repeat(LegalName, int(__posts)), '; '), '; ') WITHIN GROUP (ORDER BY LegalName)"
        ).alias("Institutions"),
    )
    return (
        researcher.select("ResearcherID", "NIHHISID", "ORCID", F.col("SecurityClearance").alias("QualificationLevel"))
        .join(concurrent, "ResearcherID")
        .join(active_leads(project, as_of, more_than_projects, by_day=False), "ResearcherID")
        .join(load, "ResearcherID")
        .join(best_degree(degree, *degree_markers), "ResearcherID", "left")
        .orderBy(F.desc("ActiveProjectCount"), F.desc("TotalFTE"), "ResearcherID")
        .select(
            "ResearcherID",
            "NIHHISID",
            "ORCID",
            "QualificationLevel",
            "InstitutionCount",
            "ActiveProjectCount",
            "TotalFTE",
            "HighestQualification",
            "Institutions",
        )
    )
