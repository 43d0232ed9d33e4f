"""All declared tables on the given ones, each with rows that break its rules.

Expressions are in the SQL that Spark and DuckDB share, so that the queries and their
SQL see the same rows; types are those of the registry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from labmesh.sources.schemas import TABLES
from labmesh.sources.tables import conform

REGISTRY_DAY = "2001-06-01 00:00:00"

_FIFTH = "CAST(substr(o_orderpriority, 1, 1) AS INT)"

# Table: the given table with a condition, and the columns that differ from "absent".
DOMAIN: dict[str, tuple[str, dict[str, str]]] = {
    "Location": (
        "nation",
        {
            "LocationID": "n_nationkey",
            "Address": "CASE WHEN n_regionkey <> 1 THEN n_name END",
            "SquareFeet": "n_regionkey * 100",
            "BSLLabLevel": "n_regionkey",
        },
    ),
    "Institution": (
        "customer WHERE c_acctbal >= 0",
        {
            "InstitutionID": "c_custkey",
            "LegalName": "c_name",
            "DateFounded": "DATE '2001-05-20' + c_nationkey",
            "TaxStatus": "CASE WHEN c_mktsegment = 'BUILDING' THEN 'government' WHEN c_nationkey = 7 THEN 'Church' ELSE 'Nonprofit' END",
            "LocationID": "c_nationkey + 1",
            "Type": "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'ACADEMIC ' ELSE c_mktsegment END",
        },
    ),
    "CorporateLab": (
        "customer WHERE c_nationkey < 12",
        {
            "InstitutionID": "c_custkey",
            "ParentCompany": "c_name",
            "StockTicker": "c_mktsegment || '-X'",
            "RnDBudget": "c_acctbal",
        },
    ),
    "AcademicInstitution": (
        "customer WHERE c_nationkey >= 12",
        {
            "InstitutionID": "c_custkey + 5",
            "QSWorldRanking": "c_nationkey",
            "NumPhdPrograms": "c_nationkey - 13",
            "IRBApprovalCapacity": "c_nationkey - 14",
        },
    ),
    "GovernmentFacility": (
        "customer WHERE c_mktsegment = 'BUILDING'",
        {
            "InstitutionID": "c_custkey",
            "SecurityClearLevel": "CASE c_nationkey % 3 WHEN 0 THEN 'secret ' WHEN 1 THEN 'Top Secret' ELSE 'Public' END",
            "AgencyAffiliation": "c_name",
        },
    ),
    "Researcher": (
        "customer",
        {
            "ResearcherID": "c_custkey",
            "NIHHISID": "substr(c_name, 10, 9)",
            "ORCID": "'0000-000' || CAST(c_nationkey % 3 AS STRING) || '-1234-567X'",
            "VisaStatus": "CASE WHEN c_nationkey <> 3 THEN 'none' END",
            "SecurityClearance": "c_mktsegment",
            "COIDisclosure": "c_name",
            "InstitutionID": "c_custkey",
        },
    ),
    "EmploymentHistory": (
        "orders",
        {
            "ExperienceRecordID": "o_orderkey",
            "StartDate": "CAST(o_orderdate AS DATE)",
            "EndDate": "CASE o_orderstatus WHEN 'F' THEN CAST(o_orderdate AS DATE) + 30 WHEN 'P' THEN CAST(o_orderdate AS DATE) - 1 END",
            "FTEPercentage": f"CASE WHEN {_FIFTH} = 1 THEN 1.5 ELSE 0.5 END",
            "Department": "o_orderpriority",
            "ResearcherID": "o_custkey * 2",
            "InstitutionID": "o_custkey",
        },
    ),
    "Degree": (
        "orders",
        {
            "DegreeID": "o_orderkey",
            "Institution": "o_orderpriority",
            "Year": "year(o_orderdate) + 3",
            "Field": "o_orderpriority",
            "ResearcherID": "o_custkey + 20",
        },
    ),
    "Certification": (
        "supplier",
        {"CertificationID": "s_suppkey", "Name": "s_name", "Year": "1900 + s_nationkey", "ResearcherID": "s_suppkey * 20"},
    ),
    "Language": (
        "supplier",
        {"LanguageID": "s_suppkey", "Name": "s_name", "ProficiencyLevel": "s_nationkey", "ResearcherID": "s_suppkey * 16"},
    ),
    "Publication": (
        "part",
        {
            "PublicationID": "p_partkey",
            "EmbargoPeriod": "CAST(DATE '2001-05-20' + p_size AS TIMESTAMP)",
            "AltmetricScore": "p_size - 5",
            "PrePrintServerLink": "p_name",
            "InstitutionID": "p_partkey",
        },
    ),
    "Freezer": (
        "supplier",
        {
            "FreezerID": "s_suppkey",
            "FreezerName": "s_name",
            "LocationID": "s_nationkey + 2",
            "SerialNumber": "CASE WHEN s_nationkey % 2 = 0 THEN 'Unit ' ELSE 'unit' END || CAST(s_nationkey AS STRING)",
            "TemperatureRangeLow": "s_nationkey - 30",
            "TemperatureRangeHigh": "s_nationkey - 200",
            "Capacity": "10",
            "CurrentUtilization": "s_nationkey",
            "BSLLevel": "s_nationkey % 6",
            "LastCalibrationDate": "DATE '2001-01-10'",
            "NextCalibrationDate": "DATE '2001-01-01' + s_nationkey",
            "MaintenanceSchedule": "CASE WHEN s_nationkey < 20 THEN 'weekly ' ELSE 'Daily' END",
            "Status": "CASE WHEN s_nationkey > 3 THEN 'Active' ELSE 'Broken' END",
        },
    ),
    "TemperatureLog": (
        "events",
        {
            "LogID": "event_id",
            "FreezerID": "user_id",
            "ReadingValue": "CAST(event_id % 90 AS INT)",
            "ReadingTime": "ts",
            "SensorID": "event_type",
            "RecordedBy": "user_id * 15",
        },
    ),
    "FreezerCompartment": (
        "part",
        {"CompartmentID": "p_partkey", "FreezerID": "p_size * 3", "CompartmentName": "p_brand", "TemperatureZone": "'cold'"},
    ),
    "TemperatureViolations": ("supplier", {"FreezerID": "s_suppkey * 2", "Location": "s_name", "MaxViolationTemp": "-10"}),
    "Biospecimen": (
        "part",
        {
            "RepositoryID": "p_partkey",
            "AliquotCounts": "p_size - 1",
            "FreezerLocation": "p_name",
            "ChainOfCustodyLogs": "p_type",
            "InstitutionID": "p_partkey",
            "FreezerID": "p_size * 4",
        },
    ),
    "DataSharing": (
        "supplier",
        {
            "DataShareID": "s_suppkey",
            "DUA": "s_name",
            "DeIdentificationMethod": "CASE WHEN s_nationkey < 20 THEN 'K-Anonymity' ELSE 'none' END",
            "InstitutionID": "s_suppkey * 20",
        },
    ),
    "Participant": ("customer", {"ParticipantID": "c_custkey", "Name": "c_name", "InstitutionID": "c_custkey + 10"}),
    "ScreeningLog": ("supplier", {"LogID": "s_suppkey", "ParticipantID": "s_suppkey * 18"}),
    "WithdrawalReason": (
        "supplier",
        {"ReasonID": "s_suppkey", "Description": "s_name", "ParticipantID": "s_suppkey * 20"},
    ),
    "AdverseEventReport": (
        "orders",
        {
            "ReportID": "o_orderkey",
            "Description": "o_orderpriority",
            "SeverityGrade": f"{_FIFTH} + 1",
            "ParticipantID": "o_custkey * 2",
        },
    ),
    "Patent": (
        "part",
        {
            "PatentID": "p_partkey",
            "FilingDate": "DATE '2000-01-01'",
            "LicensingRevenue": "p_size - 10",
            "InstitutionID": "p_partkey",
        },
    ),
    "Project": (
        "orders",
        {
            "ProtocolID": "o_orderkey",
            "PreRegistrationDOI": "o_orderpriority",
            "DSMBOversightFlag": "o_orderstatus = 'F'",
            "InstitutionID": "o_custkey + 3",
        },
    ),
    "Funding": (
        "orders",
        {
            "FundingID": "o_orderkey",
            "GrantNumbers": "o_orderpriority",
            "Disbursements": "CAST(o_totalprice AS DECIMAL(15,2)) - 50000",
            "InstitutionID": "o_custkey",
        },
    ),
    "Regulatory": (
        "orders",
        {
            "RegulatorID": "o_orderkey",
            "IRBApprovalDate": "CAST(o_orderdate AS DATE)",
            "FDAPhase": _FIFTH,
            "InstitutionID": "o_custkey",
        },
    ),
}


def domain_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every declared table, in its declared types."""
    out = {}
    for name, (source, columns) in DOMAIN.items():
        given, _, condition = source.partition(" WHERE ")
        rows = spark.read.parquet(f"{folder}/{given}.parquet")
        chosen = rows.where(condition) if condition else rows
        out[name] = conform(chosen.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()]), TABLES[name])
    return out


# --- the same in DuckDB ----------------------------------------------------------


def _kind(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    return {"int": "INT", "string": "VARCHAR", "date": "DATE", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN"}[
        kind.simpleString()
    ]


def _view(name: str) -> str:
    source, columns = DOMAIN[name]
    cells = [
        f"CAST({columns.get(f.name, 'NULL')} AS {_kind(f.dataType)}) AS {f.name}" for f in TABLES[name].columns
    ]
    return f"t_{name} AS (SELECT {', '.join(cells)} FROM {source})"


def _cell(name: str, column: str) -> str:
    """A part of a key as text."""
    kinds = {f.name: f.dataType for f in TABLES[name].columns}
    folded = f"lower(rtrim({column}))" if isinstance(kinds[column], T.StringType) else column
    return f"coalesce(CAST({folded} AS VARCHAR), 'NULL')"


def _key(name: str, columns) -> str:
    return " || '|' || ".join(_cell(name, c) for c in columns)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def broken_rows(name: str) -> list[tuple[str, str, str]]:
    """rule, condition in DuckDB and detail of every rule that a row alone can break."""
    table, out = TABLES[name], []
    for field in table.columns:
        if not field.nullable:
            out.append((f"{field.name}_required", f"{field.name} IS NULL", "'NULL'"))
        if "limit" in field.metadata:
            size = f"length({field.name})"
            out.append((f"{field.name}_length", f"{size} > {field.metadata['limit']}", f"CAST({size} AS VARCHAR)"))
    for rule, body in table.rules().items():
        # What Spark prints as the rule, and what DuckDB understands of it.
        shown = body.replace("{as_of}", f"timestamp'{REGISTRY_DAY}'")
        test = body.replace("{as_of}", f"TIMESTAMP '{REGISTRY_DAY}'").replace("ORCID RLIKE", "regexp_matches(ORCID,")
        test = test + ")" if "regexp_matches" in test else test
        out.append((rule, f"NOT ({test})", _quoted(shown)))
    return out


def registry_oracle() -> str:
    """Every broken rule of every table, one SELECT per rule."""
    parts = []
    for name, table in TABLES.items():
        key = _key(name, [table.key])
        for rule, test, detail in broken_rows(name):
            parts.append(f"SELECT '{name}', '{rule}', {key}, {detail}, count(*) FROM t_{name} WHERE {test} GROUP BY ALL")
        for columns in [(table.key,), *table.unique]:
            rule = "primary_key" if columns == (table.key,) else "unique_" + "_".join(columns)
            text = _key(name, columns)
            parts.append(
                f"SELECT '{name}', '{rule}', {text}, 'duplicate', count(*) FROM t_{name} GROUP BY ALL HAVING count(*) > 1"
            )
        for column, parent in table.references.items():
            parts.append(
                f"SELECT '{name}', '{column}_parent', CAST({column} AS VARCHAR), 'no parent', count(*) FROM t_{name} "
                f"WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {TABLES[parent].key} FROM t_{parent}) GROUP BY ALL"
            )
    union = "\nUNION ALL ".join(dict.fromkeys(parts))
    views = ",\n".join(_view(name) for name in TABLES)
    return f"""WITH {views},
found(table_name, rule_id, row_key, detail, n) AS ({union})
SELECT table_name, rule_id, row_key, detail, CAST(n AS BIGINT) AS n_rows FROM found
"""
