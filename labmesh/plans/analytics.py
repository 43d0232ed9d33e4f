"""Institution analytics. The reports are named by the model; definitions are ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labmesh.functions import asof, text
from labmesh.operators.aggregates import TOTAL, exact_mean, money_sum, severity_by_institution
from labmesh.operators.lookup import lookup_join
from labmesh.operators.ordering import rank_values
from labmesh.operators.pointintime import daily, known_totals


def publication_impact(publication: DataFrame) -> DataFrame:
    """Per institution: publications, mean and best score, rank of the best."""
    scored = publication.groupBy("InstitutionID").agg(
        F.count("*").alias("Publications"),
        F.sum(F.col("AltmetricScore").cast("bigint")).alias("__sum"),
        F.count("AltmetricScore").alias("__n"),
        F.max("AltmetricScore").alias("BestScore"),
    )
    ranks = rank_values(scored, "BestScore", "ImpactRank")
    ranked = lookup_join(scored, ranks, "BestScore", spread_by=["InstitutionID"], how="left")
    return ranked.select(
        "InstitutionID",
        "Publications",
        exact_mean(F.col("__sum"), F.col("__n")).alias("MeanScore"),
        "BestScore",
        "ImpactRank",
    )


def adverse_event_histogram(
    participant: DataFrame, adverse_event: DataFrame, grades: range = range(1, 6), severe_from: int = 3
) -> DataFrame:
    """Per institution: events by grade and the share of severe ones."""
    per_person = adverse_event.groupBy("ParticipantID").agg(
        *[F.count(F.when(F.col("SeverityGrade") == g, 1)).alias(f"g{g}") for g in grades],
        F.count(F.when(F.col("SeverityGrade") >= severe_from, 1)).alias("severe"),
        F.count("*").alias("events"),
    )
    totals = (
        participant.select("ParticipantID", "InstitutionID")
        .join(per_person, "ParticipantID")
        .groupBy("InstitutionID")
        .agg(
            *[F.sum(f"g{g}").alias(f"Grade{g}") for g in grades],
            F.sum("severe").alias("__severe"),
            F.sum("events").alias("Events"),
        )
    )
    return totals.select(
        "InstitutionID",
        *[f"Grade{g}" for g in grades],
        "Events",
        exact_mean(F.col("__severe"), F.col("Events")).alias("SevereShare"),
    )


def funding_efficiency(funding: DataFrame, publication: DataFrame, patent: DataFrame, project: DataFrame) -> DataFrame:
    """Per funded institution: output per million of funding."""
    money = funding.groupBy("InstitutionID").agg(money_sum("Disbursements").alias("Funding"))
    papers = publication.groupBy("InstitutionID").agg(F.count("*").alias("Publications"))
    patents = patent.groupBy("InstitutionID").agg(
        F.count("*").alias("Patents"), money_sum("LicensingRevenue").alias("Revenue")
    )
    projects = project.groupBy("InstitutionID").agg(F.count("*").alias("Projects"))
    joined = (
        money.join(papers, "InstitutionID", "left")
        .join(patents, "InstitutionID", "left")
        .join(projects, "InstitutionID", "left")
        .fillna(0, ["Publications", "Patents", "Projects"])
        .withColumn("Revenue", F.coalesce("Revenue", F.lit(0).cast(TOTAL)))
    )
    funds = F.col("Funding").cast("double")
    per_million = [
        F.try_divide(F.col(c).cast("double") * 1000000.0, funds).alias(f"{c}PerMillion")
        for c in ("Publications", "Patents", "Projects")
    ]
    return joined.select(
        "InstitutionID",
        "Funding",
        "Publications",
        "Patents",
        "Projects",
        "Revenue",
        *per_million,
        F.try_divide(F.col("Revenue").cast("double"), funds).alias("RevenueRatio"),
    )


def conflict_matches(researcher: DataFrame, corporate: DataFrame, ignored: list[str] = text.LEGAL_FORMS) -> DataFrame:
    """Researchers whose disclosure names a company, one row per company name.

    Both sides become word sequences and meet in an equality join. Companies of
    the same name count together.
    """
    named = corporate.select("InstitutionID", text.name_phrase(F.col("ParentCompany"), ignored).alias("Company"))
    companies = (
        named.where(F.col("Company") != "")
        .groupBy("Company")
        .agg(F.count("*").alias("Companies"), F.min("InstitutionID").alias("FirstInstitutionID"))
    )
    # Only sequences as long as some name can be one; an array of a few small numbers.
    sizes = companies.agg(F.collect_set(F.size(F.split("Company", " "))).alias("n")).select("n").scalar()
    disclosed = researcher.select("ResearcherID", "COIDisclosure").withColumn("__lengths", sizes)
    said = disclosed.select(
        "ResearcherID", F.explode(text.phrases(F.col("COIDisclosure"), F.col("__lengths"))).alias("Company")
    )
    return lookup_join(said, companies, "Company", spread_by=["ResearcherID"])


def trial_features(
    project: DataFrame,
    regulatory: DataFrame,
    funding: DataFrame,
    participant: DataFrame,
    adverse_event: DataFrame,
    withdrawal: DataFrame,
    as_of: asof.AsOf,
) -> DataFrame:
    """One feature row per project for delay models, as of one day for all.

    Counts are 0 where there is nothing to count; days are NULL where a date is
    missing. Filings approved after the day have no say in the days since approval.
    `trial_features_known` states what was known at the date of each trial.
    """
    filings = regulatory.groupBy("InstitutionID").agg(
        F.count("*").alias("Filings"),
        F.max("FDAPhase").alias("HighestPhase"),
        F.count(F.when(F.col("ExportRestriction").isNotNull(), 1)).alias("RestrictedFilings"),
        F.max(F.when(F.col("IRBApprovalDate") <= asof.day(as_of), F.col("IRBApprovalDate"))).alias("__approved"),
    )
    money = funding.groupBy("InstitutionID").agg(
        F.count("*").alias("Grants"), money_sum("Disbursements").alias("Funding")
    )
    severity = severity_by_institution(participant, adverse_event)
    left = withdrawal.groupBy("ParticipantID").agg(F.count("*").alias("__n"))
    withdrawn = (
        participant.select("ParticipantID", "InstitutionID")
        .join(left, "ParticipantID", "left")
        .groupBy("InstitutionID")
        .agg(F.count("*").alias("Participants"), F.coalesce(F.sum("__n"), F.lit(0)).alias("Withdrawals"))
    )
    sites = (
        filings.join(money, "InstitutionID", "full")
        .join(severity, "InstitutionID", "full")
        .join(withdrawn, "InstitutionID", "full")
    )
    leads = (
        project.where(F.col("PrincipalInvestigatorID").isNotNull())
        .groupBy("PrincipalInvestigatorID")
        .agg(F.count("*").alias("LeadProjects"))
    )
    rows = lookup_join(project, sites, "InstitutionID", spread_by=["ProtocolID"], how="left")
    rows = lookup_join(
        rows, leads, "PrincipalInvestigatorID", spread_by=["ProtocolID"], how="left", keys_from=project
    )

    def whole(name: str):
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)

    return rows.select(
        "ProtocolID",
        "InstitutionID",
        F.datediff("EndDate", "StartDate").alias("PlannedDays"),
        F.datediff(asof.day(as_of), "StartDate").alias("ElapsedDays"),
        F.datediff(asof.day(as_of), "__approved").alias("DaysSinceApproval"),
        whole("Filings"),
        whole("HighestPhase"),
        whole("RestrictedFilings"),
        whole("Grants"),
        F.coalesce("Funding", F.lit(0).cast(TOTAL)).alias("Funding"),
        whole("SeverityCount"),
        F.coalesce(exact_mean(F.col("SeveritySum"), F.col("SeverityCount")), F.lit(0.0)).alias("MeanSeverity"),
        whole("Participants"),
        whole("Withdrawals"),
        whole("LeadProjects"),
    )


def trial_features_known(
    project: DataFrame,
    regulatory: DataFrame,
    funding: DataFrame,
    participant: DataFrame,
    adverse_event: DataFrame,
    withdrawal: DataFrame,
    at: str = "StartDate",
    awarded: str = "AwardDate",
    reported: str = "ReportDate",
    withdrawn: str = "WithdrawalDate",
) -> DataFrame:
    """One feature row per project with what was known at its own date, for training.

    Filings count from their approval, grants, events and withdrawals from the day in
    the named column, and an investigator's projects from their start. What bears no
    date, or a later one, has no share in any feature. Counts are 0 and days, phase
    and mean NULL where nothing was known; a project without a date has NULL
    throughout. Rows of equal keys come back as often as they were given.
    """
    one, site = F.lit(1).cast("bigint"), "InstitutionID"
    filings = daily(
        regulatory,
        site,
        "IRBApprovalDate",
        {"Filings": one, "RestrictedFilings": F.col("ExportRestriction").isNotNull().cast("bigint")},
        {"HighestPhase": F.col("FDAPhase"), "__approved": F.col("IRBApprovalDate")},
    )
    grants = daily(funding, site, awarded, {"Grants": one, "Funding": F.col("Disbursements").cast(TOTAL)})

    def of_people(facts: DataFrame, day: str, sums: dict) -> DataFrame:
        """Facts of participants by the day, at the institutions of the participants."""
        per_person = daily(facts, "ParticipantID", day, sums)
        people = participant.select("ParticipantID", site)
        placed = lookup_join(per_person, people, "ParticipantID", spread_by=["Day"])
        return daily(placed, site, "Day", {name: F.col(name) for name in sums})

    graded = F.col("SeverityGrade").isNotNull()
    severity = of_people(
        adverse_event,
        reported,
        {"SeveritySum": F.col("SeverityGrade").cast("bigint"), "SeverityCount": graded.cast("bigint")},
    )
    left = of_people(withdrawal, withdrawn, {"Withdrawals": one})
    leads = daily(project, "PrincipalInvestigatorID", "StartDate", {"LeadProjects": one})

    rows = project.withColumn("Day", F.to_date(at))
    sums = ["Filings", "RestrictedFilings", "Grants", "Funding", "SeveritySum", "SeverityCount", "Withdrawals"]
    known = known_totals(rows, [filings, grants, severity, left], site, sums, ["HighestPhase", "__approved"])
    led = known_totals(rows, [leads], "PrincipalInvestigatorID", ["LeadProjects"])
    rows = lookup_join(rows, known, [site, "Day"], spread_by=["ProtocolID"], how="left")
    rows = lookup_join(
        rows,
        led,
        ["PrincipalInvestigatorID", "Day"],
        spread_by=["ProtocolID"],
        how="left",
        keys_from=project.withColumn("Day", F.to_date(at)),
    )
    return rows.select(
        "ProtocolID",
        site,
        F.col("Day").alias("KnownAt"),
        F.datediff("EndDate", "StartDate").alias("PlannedDays"),
        F.datediff("Day", "__approved").alias("DaysSinceApproval"),
        "Filings",
        "HighestPhase",
        "RestrictedFilings",
        "Grants",
        F.col("Funding").cast(TOTAL).alias("Funding"),
        "SeverityCount",
        F.when(F.col("SeverityCount") > 0, exact_mean(F.col("SeveritySum"), F.col("SeverityCount"))).alias("MeanSeverity"),
        "Withdrawals",
        "LeadProjects",
    )
