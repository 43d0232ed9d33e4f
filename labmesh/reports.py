"""The reports on a set of domain tables, by name.

``tables`` maps table names to DataFrames, as ``load_all`` returns them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labmesh.functions import asof
from labmesh.plans import compliance, custody, institutions, workload
from labmesh.sources.schemas import TABLES
from labmesh.sources.tables import load

Tables = dict[str, DataFrame]
MODES = ("specified", "as_written")


def load_all(spark: SparkSession, root: str, names: list[str] | None = None) -> Tables:
    """Domain tables from ``root/<name>.parquet``."""
    return {n: load(spark, n, f"{root}/{n}.parquet") for n in names or TABLES}


def _checked(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    return mode


def institution_funding(t: Tables, as_of: asof.AsOf, mode: str = "specified", **options) -> DataFrame:
    """Funding and severity of unrestricted high-containment government sites."""
    common = [t["Institution"], t["Location"], t["Funding"], t["Regulatory"]]
    people = [t["Participant"], t["AdverseEventReport"]]
    if _checked(mode) == "specified":
        return institutions.institution_report(*common, *people, as_of, **options)
    return institutions.institution_report_as_written(*common, t["Project"], *people, as_of, **options)


def researcher_workload(t: Tables, as_of: asof.AsOf, mode: str = "specified", **options) -> DataFrame:
    """Researchers with concurrent posts who lead more than three active projects."""
    names = ("Researcher", "EmploymentHistory", "Project", "Degree", "Institution")
    report = workload.workload_report if _checked(mode) == "specified" else workload.workload_report_as_written
    return report(*[t[n] for n in names], as_of, **options)


def renewal_compliance(t: Tables, as_of: asof.AsOf, mode: str = "specified", **options) -> DataFrame:
    """Trials whose ethics renewal is missing, past due or due soon."""
    return compliance.renewal_report(
        t["Project"], t["Researcher"], t["Institution"], as_of, mode=_checked(mode), **options
    )


def specimen_custody(t: Tables, as_of: asof.AsOf, scope: str = "location", **options) -> DataFrame:
    """Specimens in freezers with temperature violations, traced to trial and lead."""
    units = custody.affected_freezers(
        t["Freezer"], t["Location"], t["TemperatureLog"], as_of, scope=scope, **options
    )
    return custody.custody_report(units, t["Biospecimen"], t["Project"], t["Researcher"], ["RepositoryID"])


def specimen_trials(t: Tables, as_of: asof.AsOf, scope: str = "location", **options) -> DataFrame:
    """Trials at the institutions that own affected specimens."""
    units = custody.affected_freezers(
        t["Freezer"], t["Location"], t["TemperatureLog"], as_of, scope=scope, **options
    )
    return custody.candidate_trials(units, t["Biospecimen"], t["Project"], t["Researcher"], ["RepositoryID"])
