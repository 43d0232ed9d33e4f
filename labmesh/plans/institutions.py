"""Institution report: funding and trial severity of high-containment sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labmesh.functions import asof
from labmesh.functions.text import one_of
from labmesh.operators.aggregates import TOTAL, exact_mean, money_sum, severity_by_institution
from labmesh.operators.lookup import lookup_join
from labmesh.operators.ordering import arranged

# Fixed values of the report.
SITE_TYPE = "Government"
CONTAINMENT = 4
TRIAL_PHASE = 3
RESTRICTED = ("ITAR", "EAR")
YEARS = 5


def _sites(institution: DataFrame, location: DataFrame, site_type: str, containment: int) -> DataFrame:
    labs = location.where(F.col("BSLLabLevel") == containment).select("LocationID")
    chosen = institution.where(one_of(F.col("Type"), [site_type])).select("InstitutionID", "LegalName", "LocationID")
    return lookup_join(chosen, labs, "LocationID", spread_by=["InstitutionID"]).drop("LocationID")


def _unrestricted(restricted: tuple[str, ...]) -> Column:
    """Not on the list; an unknown restriction counts as none."""
    return F.col("ExportRestriction").isNull() | ~one_of(F.col("ExportRestriction"), restricted)


def institution_report(
    institution: DataFrame,
    location: DataFrame,
    funding: DataFrame,
    regulatory: DataFrame,
    participant: DataFrame,
    adverse_event: DataFrame,
    as_of: asof.AsOf,
    site_type: str = SITE_TYPE,
    containment: int = CONTAINMENT,
    phase: int = TRIAL_PHASE,
    restricted: tuple[str, ...] = RESTRICTED,
    years: int = YEARS,
    position: str | None = None,
) -> DataFrame:
    """One row per qualifying institution: name, total funding, mean severity.

    Sorted by funding, or with the place in that order in a column ``position``.

    An institution qualifies with a trial of the phase approved in the window
    and no restricted filing at all. Every child table is reduced to one row per
    institution before it is joined, so children do not multiply each other.
    """
    recent = (F.col("FDAPhase") == phase) & (F.col("IRBApprovalDate") >= asof.years_before(as_of, years))
    listed = one_of(F.col("ExportRestriction"), restricted)
    # One scan serves the existence and the exclusion test.
    cleared = (
        regulatory.where(recent | listed)
        .groupBy("InstitutionID")
        .agg(
            F.max(F.coalesce(recent, F.lit(False))).alias("__trial"),
            F.max(F.coalesce(listed, F.lit(False))).alias("__listed"),
        )
        .where(F.col("__trial") & ~F.col("__listed"))
        .select("InstitutionID")
    )
    sites = _sites(institution, location, site_type, containment).join(cleared, "InstitutionID", "left_semi")
    # The few qualifying sites thin out the child tables before anything is grouped.
    chosen = sites.select("InstitutionID")
    money = (
        funding.join(chosen, "InstitutionID", "left_semi")
        .groupBy("InstitutionID")
        .agg(money_sum("Disbursements").alias("TotalFundingReceived"))
    )
    severity = severity_by_institution(
        participant.join(chosen, "InstitutionID", "left_semi"), adverse_event
    )
    rows = sites.join(money, "InstitutionID").join(severity, "InstitutionID", "left")
    return arranged(rows, [F.desc("TotalFundingReceived"), "InstitutionID"], position).select(
        "LegalName",
        "TotalFundingReceived",
        exact_mean(F.col("SeveritySum"), F.col("SeverityCount")).alias("AverageSeverityGrade"),
        *([position] if position else []),
    )


def institution_report_as_written(
    institution: DataFrame,
    location: DataFrame,
    funding: DataFrame,
    regulatory: DataFrame,
    project: DataFrame,
    participant: DataFrame,
    adverse_event: DataFrame,
    as_of: asof.AsOf,
    site_type: str = SITE_TYPE,
    containment: int = CONTAINMENT,
    phase: int = TRIAL_PHASE,
    restricted: tuple[str, ...] = RESTRICTED,
    years: int = YEARS,
) -> DataFrame:
    """What the report's literal join chain returns, without its row product.

    The literal chain pairs every funding row of a site with every matching
    filing, every project and every participant of the whole network. Its sum is
    therefore the funding times the sizes of the other factors, and its mean is
    the network-wide integer mean. A site without projects keeps the filing
    factor only and has no mean.
    """
    matching = (
        regulatory.where(
            (F.col("FDAPhase") == phase)
            & _unrestricted(restricted)
            & (F.col("IRBApprovalDate") >= asof.years_before(as_of, years, by_day=False))
        )
        .groupBy("InstitutionID")
        .agg(F.count("*").alias("__filings"))
    )
    money = funding.groupBy("InstitutionID").agg(money_sum("Disbursements").alias("__money"))
    projects = project.groupBy("InstitutionID").agg(F.count("*").alias("__projects"))

    per_person = adverse_event.groupBy("ParticipantID").agg(
        F.count("*").alias("__rows"),
        F.sum(F.col("SeverityGrade").cast("bigint")).alias("__sum"),
        F.count("SeverityGrade").alias("__n"),
    )
    network = (
        participant.select("ParticipantID")
        .join(per_person, "ParticipantID", "left")
        .agg(
            # Without any participant the outer join still yields one row.
            F.greatest(F.sum(F.greatest(F.coalesce("__rows", F.lit(0)), F.lit(1))), F.lit(1)).alias("fan"),
            F.expr("CASE WHEN sum(__n) > 0 THEN sum(__sum) div sum(__n) END").alias("mean"),
        )
    )
    fan = network.select("fan").scalar()
    mean = network.select("mean").scalar()
    has_project = F.col("__projects").isNotNull()
    # Counts multiply beyond a bigint before they meet the money.
    wide = "decimal(38,0)"
    fanned = F.col("__projects").cast(wide) * fan.cast(wide)
    factor = F.col("__filings").cast(wide) * F.when(has_project, fanned).otherwise(F.lit(1).cast(wide))
    return (
        _sites(institution, location, site_type, containment)
        .join(matching, "InstitutionID")
        .join(money, "InstitutionID")
        .join(projects, "InstitutionID", "left")
        .select(
            "InstitutionID",
            "LegalName",
            (F.col("__money") * factor.cast(wide)).cast(TOTAL).alias("TotalFundingReceived"),
            F.when(has_project, mean).cast("bigint").alias("AverageSeverityGrade"),
        )
        .orderBy(F.desc("TotalFundingReceived"), "InstitutionID")
        .drop("InstitutionID")
    )
