"""Views of the given tables as domain tables.

Each function returns the columns that an operator reads. The SQL texts of
``bindings.oracles`` state the same views independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labmesh.operators.lookup import lookup_join
from labmesh.streaming.run import replay

MONEY = "decimal(15,2)"
FIRST_DAY = "2024-01-01"
BATCHES = 5
LONG_AFTER = "2024-06-01 00:00:00"
# Width of released ids: room for keys up to 6 * 10**16 and 9 * 10**13.
GROUPS = 4
DIGITS = 14


class Roles:
    """Domain tables on top of one folder of given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A given table; its schema is read from the files once."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    # --- institutions are customers ---

    def location(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("LocationID"),
            F.col("n_name").alias("Address"),
            F.col("n_regionkey").alias("BSLLabLevel"),
        )

    def institution(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("InstitutionID"),
            F.col("c_name").alias("LegalName"),
            F.col("c_nationkey").alias("LocationID"),
            F.col("c_mktsegment").alias("Type"),
        )

    def funding(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_custkey").alias("InstitutionID"), F.col("o_totalprice").cast(MONEY).alias("Disbursements")
        )

    def regulatory(self) -> DataFrame:
        status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
        return self.raw("orders").select(
            F.col("o_custkey").alias("InstitutionID"),
            F.substring(priority, 1, 1).cast("int").alias("FDAPhase"),
            F.when((status == "F") & priority.startswith("1"), "ITAR")
            .when(status == "O", "EAR99")
            .alias("ExportRestriction"),
            F.to_date("o_orderdate").alias("IRBApprovalDate"),
        )

    def project(self) -> DataFrame:
        """Trials are orders; their institution and lead are the customer."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("ProtocolID"),
            F.concat(F.lit("Trial "), F.col("o_orderkey").cast("string")).alias("ProjectTitle"),
            F.col("o_custkey").alias("InstitutionID"),
            F.col("o_custkey").alias("PrincipalInvestigatorID"),
            F.to_date("o_orderdate").alias("EndDate"),
        )

    def participant(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("ParticipantID"), F.col("o_custkey").alias("InstitutionID")
        )

    def adverse_event(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("ParticipantID"), F.col("l_linenumber").alias("SeverityGrade")
        )

    def withdrawal(self) -> DataFrame:
        returned = self.raw("lineitem").where(F.col("l_returnflag") == "R")
        return returned.select(F.col("l_orderkey").alias("ParticipantID"))

    def publication(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_suppkey").alias("InstitutionID"), F.col("l_quantity").cast("int").alias("AltmetricScore")
        )

    # --- researchers are customers, employers are suppliers ---

    def researcher(self) -> DataFrame:
        """The renewal date is the latest order's, unless that order is pending."""
        latest = (
            self.raw("orders")
            .groupBy("o_custkey")
            .agg(
                F.to_date(F.max("o_orderdate")).alias("__date"),
                F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("__status"),
            )
        )
        name = F.split("c_name", "#")
        return (
            self.raw("customer")
            .join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(
                F.col("c_custkey").alias("ResearcherID"),
                F.substring("c_name", 10, 9).alias("NIHHISID"),
                F.col("c_name").alias("ORCID"),
                F.col("c_mktsegment").alias("SecurityClearance"),
                F.col("c_name").alias("COIDisclosure"),
                F.col("c_nationkey").alias("InstitutionID"),
                F.when(F.col("__status") != "P", F.col("__date")).alias("IRBRenewalDate"),
                name.getItem(0).alias("FirstName"),
                name.getItem(1).alias("LastName"),
                F.concat(name.getItem(1), F.lit("@example.org")).alias("Email"),
            )
        )

    def home_institution(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("InstitutionID"),
            F.col("n_name").alias("LegalName"),
            F.col("n_regionkey").cast("string").alias("Type"),
        )

    def employer(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("InstitutionID"), F.col("s_name").alias("LegalName")
        )

    def employment(self) -> DataFrame:
        """Posts are order lines; an open line is a current post."""
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        lines = lookup_join(
            self.raw("lineitem"),
            orders,
            {"l_orderkey": "o_orderkey"},
            spread_by=["l_partkey", "l_suppkey", "l_shipdate"],
        )
        return lines.select(
            F.col("l_orderkey").alias("ExperienceRecordID"),
            F.col("o_custkey").alias("ResearcherID"),
            F.col("l_suppkey").alias("InstitutionID"),
            F.col("l_returnflag").alias("Department"),
            F.col("l_discount").cast("decimal(3,2)").alias("FTEPercentage"),
            F.to_date("o_orderdate").alias("StartDate"),
            F.when(F.col("l_linestatus") == "F", F.to_date("l_shipdate")).alias("EndDate"),
        )

    def degree(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("DegreeID"),
            F.col("o_custkey").alias("ResearcherID"),
            F.col("o_orderpriority").alias("Field"),
            F.year("o_orderdate").alias("Year"),
        )

    # --- freezers are suppliers, readings are events, specimens are lines ---

    def temperature_log(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("LogID"),
            F.col("user_id").alias("FreezerID"),
            F.col("ts").alias("ReadingTime"),
            F.col("value").alias("ReadingValue"),
        )

    def freezer(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("FreezerID"),
            F.col("s_name").alias("FreezerName"),
            F.col("s_nationkey").alias("LocationID"),
        )

    def specimen(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("ProtocolID"),
            F.col("l_linenumber"),
            F.col("l_partkey"),
            F.col("l_quantity").cast("int").alias("AliquotCounts"),
            F.col("l_partkey").alias("InstitutionID"),
            F.col("l_suppkey").alias("FreezerID"),
        )

    # --- streams ---

    def event_batch(self):
        """Number of the batch that delivers an event: six days each, from FIRST_DAY."""
        day = F.datediff("ts", F.lit(FIRST_DAY)) / 6
        return F.greatest(F.lit(0), F.least(F.lit(BATCHES - 1), F.floor(day).cast("int")))

    def _event_stream(self) -> DataFrame:
        """The events in BATCHES deliveries."""
        return replay(self.raw("events").withColumn("__batch", self.event_batch()), "__batch", BATCHES)

    def readings(self) -> DataFrame:
        """Readings as a stream has them, with the number of their batch."""
        return self.raw("events").select(
            F.col("event_id").alias("LogID"),
            F.col("user_id").alias("FreezerID"),
            F.col("ts").cast("timestamp").alias("ReadingTime"),
            F.col("value").alias("ReadingValue"),
            self.event_batch().alias("Batch"),
        )

    def closing(self, table: DataFrame, **columns) -> DataFrame:
        """The table and, in a batch of its own, a row long after all others, which lets what waits pass."""
        row = self.spark.range(1).select(
            *(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema)
        )
        return table.unionByName(row)

    def reading_stream(self) -> DataFrame:
        return self._event_stream().select(
            F.col("event_id").alias("LogID"),
            F.col("user_id").alias("FreezerID"),
            F.col("ts").cast("timestamp").alias("ReadingTime"),
            F.col("value").alias("ReadingValue"),
        )

    def access_stream(self) -> DataFrame:
        return self._event_stream().select(
            F.col("user_id").alias("UserID"),
            F.col("ts").cast("timestamp").alias("AccessTime"),
            F.col("event_type").alias("Action"),
        )
