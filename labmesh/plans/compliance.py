"""Ethics-renewal compliance: trials whose renewal is missing, past or near."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labmesh.functions import asof
from labmesh.operators.lookup import lookup_join
from labmesh.operators.ordering import arranged

# Report labels.
PAST_DUE, DUE_SOON, MISSING, CURRENT = "PAST DUE", "DUE WITHIN 30 DAYS", "MISSING", "UP TO DATE"
RED, YELLOW, GREY, GREEN = "🔴 RED", "🟡 YELLOW", "⚪ GREY", "🟢 GREEN"


def _departments(employment: DataFrame) -> DataFrame:
    """Current departments per researcher and institution, as one text.

    Duplicates go before the list is built, so it holds department names only.
    """
    return (
        employment.where(F.col("EndDate").isNull())
        .select(F.col("ResearcherID").alias("__lead"), F.col("InstitutionID").alias("__site"), "Department")
        .distinct()
        .groupBy("__lead", "__site")
        .agg(F.expr("listagg(Department, '; ') WITHIN GROUP (ORDER BY Department)").alias("Department"))
    )


def _placed(rows: DataFrame, sites: DataFrame, departments: DataFrame | None, key: str) -> DataFrame:
    """Add the site, and optionally the departments there, to rows with both keys."""
    out = lookup_join(rows, sites, {"__site": "InstitutionID"}, spread_by=[key])
    if departments is None:
        return out
    return lookup_join(out, departments, ["__lead", "__site"], spread_by=[key], how="left", keys_from=rows)


def renewal_report(
    project: DataFrame,
    researcher: DataFrame,
    institution: DataFrame,
    as_of: asof.AsOf,
    employment: DataFrame | None = None,
    mode: str = "specified",
    institution_via: str = "pi",
    horizon_days: int = 30,
    ordered: bool = True,
    position: str | None = None,
) -> DataFrame:
    """One row per trial whose lead investigator needs attention.

    ``mode="specified"`` compares calendar days and reports a missing date as
    ``MISSING``. ``mode="as_written"`` compares with the instant and lets a
    missing date fall through to ``UP TO DATE``.

    ``institution_via`` takes the institution from the investigator ("pi") or
    from the trial ("project"). With ``employment`` given, a ``Department``
    column lists the investigator's current departments at that institution.
    ``ordered=False`` saves the global sort where the rows go on to another job;
    ``position`` names a column with the place in that order instead.
    """
    by_day = mode == "specified"
    renewal = F.col("IRBRenewalDate")
    past = asof.before(renewal, as_of, by_day)
    soon = renewal <= asof.days_after(as_of, horizon_days, by_day)

    sites = institution.select(
        "InstitutionID", F.col("LegalName").alias("Institution"), F.col("Type").alias("InstitutionType")
    )
    leads = researcher.where(renewal.isNull() | soon).select(
        F.col("ResearcherID").alias("__lead"),
        F.concat(F.col("FirstName"), F.lit(" "), F.col("LastName")).alias("PrincipalInvestigator"),
        F.col("Email").alias("PI_Contact"),
        "IRBRenewalDate",
        F.col("InstitutionID").alias("__site"),
        F.when(past, 0).when(soon, 1).otherwise(2).alias("__rank"),
    )
    trials = project.select(
        "ProtocolID",
        "ProjectTitle",
        F.col("PrincipalInvestigatorID").alias("__lead"),
        F.col("InstitutionID").alias("__site"),
    )
    departments = None if employment is None else _departments(employment)
    if institution_via not in ("pi", "project"):
        raise ValueError("institution_via is pi or project")
    if institution_via == "pi":
        # Small tables meet first; trials join once.
        leads = _placed(leads, sites, departments, "__lead")
        out = lookup_join(trials.drop("__site"), leads, "__lead", spread_by=["ProtocolID"])
    else:
        out = _placed(trials, sites, departments, "ProtocolID")
        out = lookup_join(out, leads.drop("__site"), "__lead", spread_by=["ProtocolID"], keys_from=trials)
    extra = [] if departments is None else ["Department"]

    rank = F.col("__rank")
    if by_day:
        status = F.when(rank == 0, PAST_DUE).when(rank == 1, DUE_SOON).otherwise(MISSING)
        colour = F.when(rank == 0, RED).when(rank == 1, YELLOW).otherwise(GREY)
    else:
        status = F.when(rank == 0, PAST_DUE).when(rank == 1, DUE_SOON).otherwise(CURRENT)
        colour = F.when(rank == 0, RED).when(rank == 1, YELLOW).otherwise(GREEN)
    if ordered or position:
        # The trial key makes the sort key unique, so one date cannot pile up
        # in one range of the sort.
        out = arranged(out, ["__rank", "IRBRenewalDate", "ProtocolID"], position)
    extra += [position] if position else []
    return out.select(
        "Institution",
        "InstitutionType",
        "PrincipalInvestigator",
        "PI_Contact",
        "ProtocolID",
        "ProjectTitle",
        "IRBRenewalDate",
        status.alias("RenewalStatus"),
        colour.alias("StatusColor"),
        *extra,
    )
