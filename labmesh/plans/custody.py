"""Chain of custody: specimens in violating freezers, their trials and leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labmesh.functions import asof
from labmesh.operators.lookup import lookup_join
from labmesh.operators.violations import LOOKBACK_DAYS, THRESHOLD, violation_rollup

ROLLUP = ["MaxViolationTemp", "FirstViolation", "LastViolation", "ViolationCount"]


def affected_freezers(
    freezer: DataFrame,
    location: DataFrame,
    temperature_log: DataFrame,
    as_of: asof.AsOf,
    scope: str = "freezer",
    threshold: float = THRESHOLD,
    lookback_days: int = LOOKBACK_DAYS,
) -> DataFrame:
    """One row per affected freezer with its location and violation rollup.

    ``scope="freezer"`` keeps freezers that violated themselves. With
    ``scope="location"`` one violation affects every freezer at the location;
    freezers without a violation of their own carry a NULL rollup.
    """
    if scope not in ("freezer", "location"):
        raise ValueError("scope is freezer or location")
    rollup = violation_rollup(temperature_log, as_of, threshold, lookback_days)
    units = freezer.select("FreezerID", "FreezerName", "LocationID")
    if scope == "freezer":
        hit = units.join(rollup, "FreezerID")
    else:
        every = units.join(rollup, "FreezerID", "left")
        places = every.where(F.col("ViolationCount").isNotNull()).select("LocationID").distinct()
        hit = lookup_join(every, places, "LocationID", spread_by=["FreezerID"], how="left_semi", keys_from=units)
    place = location.select("LocationID", F.col("Address").alias("Location"))
    return lookup_join(hit, place, "LocationID", spread_by=["FreezerID"], keys_from=units)


def _leads(project: DataFrame, researcher: DataFrame) -> DataFrame:
    people = researcher.select(
        "ResearcherID",
        F.concat(F.col("FirstName"), F.lit(" "), F.col("LastName")).alias("PrincipalInvestigator"),
        F.col("Email").alias("PI_Contact"),
    )
    trials = project.select("ProtocolID", "ProjectTitle", "InstitutionID", "PrincipalInvestigatorID")
    return lookup_join(
        trials, people, {"PrincipalInvestigatorID": "ResearcherID"}, spread_by=["ProtocolID"], how="left"
    )


def custody_report(
    freezers: DataFrame,
    biospecimen: DataFrame,
    project: DataFrame,
    researcher: DataFrame,
    specimen_key: list[str],
) -> DataFrame:
    """One row per specimen in an affected freezer, traced to trial and lead.

    A specimen table with a ``ProtocolID`` names its trial, and the trace follows
    it. Without one a specimen shares only its institution with trials: the row
    then carries the number of trials there, and the trial itself where it is
    the only one. ``candidate_trials`` lists the others.
    """
    stored = lookup_join(biospecimen, freezers, "FreezerID", spread_by=specimen_key)
    if "ProtocolID" in biospecimen.columns:
        origin = _leads(project, researcher).drop("InstitutionID")
        traced = lookup_join(
            stored, origin, "ProtocolID", spread_by=specimen_key, how="left", keys_from=biospecimen
        )
        extra = []
    else:
        # Trials per institution shrink to one row before they meet specimens.
        only = F.when(F.col("CandidateTrials") == 1, F.col("__trial"))
        per_site = (
            project.groupBy("InstitutionID")
            .agg(F.count("*").alias("CandidateTrials"), F.min("ProtocolID").alias("__trial"))
            .select("InstitutionID", "CandidateTrials", only.alias("ProtocolID"))
        )
        origin = _leads(project, researcher).drop("InstitutionID")
        # Sites with several trials all lack a key here; they spread too.
        sites = lookup_join(per_site, origin, "ProtocolID", spread_by=["InstitutionID"], how="left")
        traced = lookup_join(
            stored, sites, "InstitutionID", spread_by=specimen_key, how="left", keys_from=biospecimen
        ).withColumn("CandidateTrials", F.coalesce("CandidateTrials", F.lit(0)))
        extra = ["CandidateTrials"]
    trial = [] if "ProtocolID" in specimen_key else ["ProtocolID"]
    return traced.select(
        "FreezerID",
        "FreezerName",
        "Location",
        *ROLLUP,
        *specimen_key,
        "AliquotCounts",
        "InstitutionID",
        *extra,
        *trial,
        "ProjectTitle",
        "PrincipalInvestigatorID",
        "PrincipalInvestigator",
        "PI_Contact",
    )


def candidate_trials(
    freezers: DataFrame, biospecimen: DataFrame, project: DataFrame, researcher: DataFrame, specimen_key: list[str]
) -> DataFrame:
    """One row per trial at an institution that owns affected specimens.

    Together with ``custody_report`` this states every specimen-trial link that
    an institution implies, without listing the pairs.
    """
    stored = lookup_join(
        biospecimen, freezers.select("FreezerID", *ROLLUP), "FreezerID", spread_by=specimen_key
    )
    exposure = stored.groupBy("InstitutionID").agg(
        F.count("*").alias("AffectedSpecimens"),
        F.sum(F.col("AliquotCounts").cast("bigint")).alias("AffectedAliquots"),
        F.max("MaxViolationTemp").alias("MaxViolationTemp"),
        F.min("FirstViolation").alias("FirstViolation"),
        F.max("LastViolation").alias("LastViolation"),
    )
    trials = lookup_join(project, exposure, "InstitutionID", spread_by=["ProtocolID"])
    return lookup_join(
        trials.select("ProtocolID", "ProjectTitle", "InstitutionID", "PrincipalInvestigatorID", *exposure.columns[1:]),
        researcher.select(
            "ResearcherID",
            F.concat(F.col("FirstName"), F.lit(" "), F.col("LastName")).alias("PrincipalInvestigator"),
            F.col("Email").alias("PI_Contact"),
        ),
        {"PrincipalInvestigatorID": "ResearcherID"},
        spread_by=["ProtocolID"],
        how="left",
        keys_from=project,
    )
