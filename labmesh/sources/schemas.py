"""Registry of the domain tables: columns, keys, references and row rules.

Names, types, lengths, enumerations and bounds are fixed values of the data
model. Two of them deliberately follow the meaning of the model rather than the
letter of its original declaration: ``Biospecimen.FreezerID`` points at
``Freezer``, and the violation rollup is listed for its schema although it is
always computed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

INT = T.IntegerType()
TEXT = T.StringType()
DATE = T.DateType()
TIME = T.TimestampType()
FLAG = T.BooleanType()


def number(precision: int, scale: int = 2) -> T.DecimalType:
    return T.DecimalType(precision, scale)


def col(name: str, kind: T.DataType = INT, limit: int | None = None) -> T.StructField:
    """A required column; ``limit`` is the longest text it may hold."""
    return T.StructField(name, kind, False, {"limit": limit} if limit else {})


def opt(name: str, kind: T.DataType = INT, limit: int | None = None) -> T.StructField:
    """A nullable column."""
    return T.StructField(name, kind, True, {"limit": limit} if limit else {})


@dataclass(frozen=True)
class Table:
    """One domain table.

    ``checks`` maps a rule name to a SQL predicate that valid rows satisfy or
    leave unknown. ``{as_of}`` in a predicate stands for the evaluation time.
    ``defaults`` apply only to columns absent from a loaded batch.
    """

    name: str
    columns: list[T.StructField]
    key: str
    references: dict[str, str] = field(default_factory=dict)
    unique: list[tuple[str, ...]] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)
    padded: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)
    cascade_from: str | None = None
    generated_key: bool = True

    @property
    def schema(self) -> T.StructType:
        return T.StructType(self.columns)

    def rules(self) -> dict[str, str]:
        """Row rules: the declared checks plus one per enumerated column."""
        out = dict(self.checks)
        for name, values in self.enums.items():
            listed = ", ".join(f"'{v.lower()}'" for v in values)
            out[f"{name}_listed"] = f"lower(rtrim({name})) IN ({listed})"
        return out


INSTITUTION = {"InstitutionID": "Institution"}
RESEARCHER = {"ResearcherID": "Researcher"}
PARTICIPANT = {"ParticipantID": "Participant"}

# Researcher identifiers: four digit groups, the last ending in a digit or X.
ORCID_PATTERN = "^0000-000[1-9]-[0-9]{4}-[0-9]{3}[0-9X]$"

_TABLES = [
    Table(
        "Location",
        [col("LocationID"), col("Address", TEXT, 255), col("SquareFeet", number(10)), col("BSLLabLevel")],
        key="LocationID",
        unique=[("LocationID",)],
        checks={"area_positive": "SquareFeet > 0", "bsl_range": "BSLLabLevel BETWEEN 1 AND 4"},
    ),
    Table(
        "Institution",
        [
            col("InstitutionID"),
            col("LegalName", TEXT, 255),
            col("DateFounded", DATE),
            col("TaxStatus", TEXT, 20),
            col("LocationID"),
            col("Type", TEXT, 20),
        ],
        key="InstitutionID",
        unique=[("InstitutionID",)],
        references={"LocationID": "Location"},
        checks={"founded_in_past": "DateFounded <= {as_of}"},
        enums={
            "TaxStatus": ["Nonprofit", "For-Profit", "Government"],
            "Type": ["Academic", "Corporate", "Government"],
        },
    ),
    Table(
        "CorporateLab",
        [
            col("InstitutionID"),
            col("ParentCompany", TEXT, 100),
            opt("StockTicker", TEXT, 10),
            col("RnDBudget", number(15)),
        ],
        key="InstitutionID",
        references=INSTITUTION,
        checks={"budget_not_negative": "RnDBudget >= 0"},
        cascade_from="Institution",
        generated_key=False,
    ),
    Table(
        "AcademicInstitution",
        [col("InstitutionID"), opt("QSWorldRanking"), col("NumPhdPrograms"), col("IRBApprovalCapacity")],
        key="InstitutionID",
        references=INSTITUTION,
        checks={
            "programs_not_negative": "NumPhdPrograms >= 0",
            "capacity_not_negative": "IRBApprovalCapacity >= 0",
        },
        cascade_from="Institution",
        generated_key=False,
    ),
    Table(
        "GovernmentFacility",
        [col("InstitutionID"), col("SecurityClearLevel", TEXT, 20), col("AgencyAffiliation", TEXT, 50)],
        key="InstitutionID",
        references=INSTITUTION,
        enums={"SecurityClearLevel": ["Confidential", "Secret", "Top Secret"]},
        cascade_from="Institution",
        generated_key=False,
    ),
    Table(
        "Researcher",
        [
            col("ResearcherID"),
            col("NIHHISID", TEXT, 10),
            col("ORCID", TEXT, 19),
            col("VisaStatus", TEXT, 30),
            col("SecurityClearance", TEXT, 30),
            col("COIDisclosure", TEXT),
            col("InstitutionID"),
            opt("IRBRenewalDate", DATE),
            opt("FirstName", TEXT, 80),
            opt("LastName", TEXT, 80),
            opt("Email", TEXT, 255),
        ],
        key="ResearcherID",
        references=INSTITUTION,
        checks={"orcid_shape": f"ORCID RLIKE '{ORCID_PATTERN}'"},
        padded=("NIHHISID", "ORCID"),
    ),
    Table(
        "EmploymentHistory",
        [
            col("ExperienceRecordID"),
            col("StartDate", DATE),
            opt("EndDate", DATE),
            col("FTEPercentage", number(3)),
            col("Department", TEXT, 50),
            col("ResearcherID"),
            opt("InstitutionID"),
        ],
        key="ExperienceRecordID",
        references=RESEARCHER,
        checks={
            "fte_range": "FTEPercentage BETWEEN 0 AND 1",
            "ends_after_start": "EndDate IS NULL OR EndDate > StartDate",
        },
    ),
    Table(
        "Degree",
        [
            col("DegreeID"),
            col("Institution", TEXT, 100),
            col("Year"),
            col("Field", TEXT, 60),
            col("ResearcherID"),
        ],
        key="DegreeID",
        references=RESEARCHER,
        checks={"year_plausible": "Year > 1900 AND Year <= year({as_of})"},
    ),
    Table(
        "Certification",
        [col("CertificationID"), col("Name", TEXT, 100), col("Year"), col("ResearcherID")],
        key="CertificationID",
        references=RESEARCHER,
        checks={"year_plausible": "Year > 1900 AND Year <= year({as_of})"},
    ),
    Table(
        "Language",
        [col("LanguageID"), col("Name", TEXT, 40), col("ProficiencyLevel"), col("ResearcherID")],
        key="LanguageID",
        references=RESEARCHER,
        checks={"proficiency_range": "ProficiencyLevel BETWEEN 1 AND 5"},
    ),
    Table(
        "Publication",
        [
            col("PublicationID"),
            col("EmbargoPeriod", TIME),
            col("AltmetricScore"),
            col("PrePrintServerLink", TEXT, 255),
            col("InstitutionID"),
        ],
        key="PublicationID",
        references=INSTITUTION,
        checks={"score_not_negative": "AltmetricScore >= 0", "embargo_ahead": "EmbargoPeriod > {as_of}"},
    ),
    Table(
        "Freezer",
        [
            col("FreezerID"),
            col("FreezerName", TEXT, 50),
            col("LocationID"),
            opt("Manufacturer", TEXT, 50),
            opt("ModelNumber", TEXT, 30),
            opt("SerialNumber", TEXT, 30),
            col("TemperatureRangeLow", number(5)),
            col("TemperatureRangeHigh", number(5)),
            opt("Capacity"),
            opt("CurrentUtilization"),
            col("BSLLevel"),
            opt("LastCalibrationDate", DATE),
            opt("NextCalibrationDate", DATE),
            opt("MaintenanceSchedule", TEXT, 20),
            opt("Status", TEXT, 20),
        ],
        key="FreezerID",
        references={"LocationID": "Location"},
        unique=[("SerialNumber",)],
        checks={
            "low_bound": "TemperatureRangeLow <= -20",
            "high_bound": "TemperatureRangeHigh >= -196",
            "within_capacity": "CurrentUtilization <= Capacity",
            "bsl_range": "BSLLevel BETWEEN 1 AND 4",
            "calibration_order": "NextCalibrationDate > LastCalibrationDate",
        },
        enums={
            "MaintenanceSchedule": ["Weekly", "Monthly", "Quarterly"],
            "Status": ["Active", "Maintenance", "Decommissioned"],
        },
        defaults={"Status": "'Active'"},
    ),
    Table(
        "TemperatureLog",
        [
            col("LogID"),
            col("FreezerID"),
            col("ReadingValue", number(5)),
            col("ReadingTime", TIME),
            col("SensorID", TEXT, 30),
            opt("IsManualEntry", FLAG),
            opt("RecordedBy"),
        ],
        key="LogID",
        references={"FreezerID": "Freezer", "RecordedBy": "Researcher"},
        defaults={"ReadingTime": "{as_of}", "IsManualEntry": "false"},
    ),
    Table(
        "FreezerCompartment",
        [
            col("CompartmentID"),
            col("FreezerID"),
            col("CompartmentName", TEXT, 20),
            opt("TemperatureZone", TEXT, 20),
        ],
        key="CompartmentID",
        references={"FreezerID": "Freezer"},
        unique=[("FreezerID", "CompartmentName")],
    ),
    Table(
        "TemperatureViolations",
        [
            col("FreezerID"),
            opt("Location", TEXT, 255),
            opt("MaxViolationTemp", number(5)),
            opt("FirstViolation", TIME),
            opt("LastViolation", TIME),
        ],
        key="FreezerID",
        references={"FreezerID": "Freezer"},
        generated_key=False,
    ),
    Table(
        "Biospecimen",
        [
            col("RepositoryID"),
            col("AliquotCounts"),
            col("FreezerLocation", TEXT, 255),
            col("ChainOfCustodyLogs", TEXT),
            col("InstitutionID"),
            col("FreezerID"),
        ],
        key="RepositoryID",
        references={"InstitutionID": "Institution", "FreezerID": "Freezer"},
        checks={"aliquots_positive": "AliquotCounts > 0"},
    ),
    Table(
        "DataSharing",
        [
            col("DataShareID"),
            col("DUA", TEXT, 100),
            col("DeIdentificationMethod", TEXT, 30),
            col("InstitutionID"),
        ],
        key="DataShareID",
        references=INSTITUTION,
        enums={"DeIdentificationMethod": ["k-anonymity", "differential privacy"]},
    ),
    Table(
        "Participant",
        [col("ParticipantID"), col("Name", TEXT, 100), col("InstitutionID")],
        key="ParticipantID",
        references=INSTITUTION,
    ),
    Table("ScreeningLog", [col("LogID"), col("ParticipantID")], key="LogID", references=PARTICIPANT),
    Table(
        "WithdrawalReason",
        [col("ReasonID"), col("Description", TEXT, 255), col("ParticipantID")],
        key="ReasonID",
        references=PARTICIPANT,
    ),
    Table(
        "AdverseEventReport",
        [col("ReportID"), col("Description", TEXT), col("SeverityGrade"), col("ParticipantID")],
        key="ReportID",
        references=PARTICIPANT,
        checks={"grade_range": "SeverityGrade BETWEEN 1 AND 5"},
    ),
    Table(
        "Patent",
        [col("PatentID"), col("FilingDate", DATE), col("LicensingRevenue", number(15)), col("InstitutionID")],
        key="PatentID",
        references=INSTITUTION,
        checks={"revenue_not_negative": "LicensingRevenue >= 0"},
    ),
    Table(
        "Project",
        [
            col("ProtocolID"),
            col("PreRegistrationDOI", TEXT, 50),
            col("DSMBOversightFlag", FLAG),
            col("InstitutionID"),
            opt("StartDate", DATE),
            opt("EndDate", DATE),
            opt("ProjectTitle", TEXT, 100),
            opt("PrincipalInvestigatorID"),
        ],
        key="ProtocolID",
        references=INSTITUTION,
    ),
    Table(
        "Funding",
        [
            col("FundingID"),
            col("GrantNumbers", TEXT, 50),
            col("Disbursements", number(15)),
            col("InstitutionID"),
        ],
        key="FundingID",
        references=INSTITUTION,
        checks={"disbursement_not_negative": "Disbursements >= 0"},
    ),
    Table(
        "Regulatory",
        [
            col("RegulatorID"),
            col("IRBApprovalDate", DATE),
            opt("FDAPhase"),
            opt("ExportRestriction", TEXT, 20),
            col("InstitutionID"),
        ],
        key="RegulatorID",
        references=INSTITUTION,
        checks={"phase_range": "FDAPhase BETWEEN 1 AND 4"},
    ),
]

TABLES: dict[str, Table] = {t.name: t for t in _TABLES}
