"""The registered queries: every operator on whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings.domain import REGISTRY_DAY, domain_tables
from bindings.roles import BATCHES, DIGITS, GROUPS, LONG_AFTER, Roles
from labmesh.functions import asof, keyed
from labmesh.functions.text import valid_orcid
from labmesh.operators import timelines
from labmesh.operators.ordering import assign_keys, number_rows
from labmesh.operators.runs import violation_runs, window_alarms, window_states
from labmesh.operators.violations import violation_rollup
from labmesh.plans import analytics, compliance, custody, deident, institutions, privacy, quality, workload
from labmesh.sources import tables
from labmesh.sources.keyindex import KeyIndex
from labmesh.sources.quarantine import load_batch
from labmesh.sources.schemas import TABLES
from labmesh.sources.scratch import discard, fresh_folder
from labmesh.streaming import access, freezers
from labmesh.streaming.alarms import ENDED, RAISED, reading_alarms
from labmesh.streaming.late import account, deliveries, on_time
from labmesh.streaming.run import MERGED_EARLY, ROCKSDB, replay, run_available
from labmesh.streaming.versions import with_version

SALT = "test-salt"
REPORT_DAY = "2001-08-01 12:00:00"
RENEWAL_DAY = "2001-01-15 12:00:00"
WORKLOAD_DAY = "2000-01-01 12:00:00"
READING_DAY = "2024-01-31 00:00:00"
HOT_READING = 150
SITE = {"site_type": "BUILDING", "containment": 4}
DEGREES = ("URGENT", "HIGH")

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
    REGISTRY[fn.__name__] = lambda spark, folder: fn(Roles(spark, folder))
    return fn


# --- reports -------------------------------------------------------------------


@query
def q1_institution_report(r: Roles) -> DataFrame:
    return institutions.institution_report(
        r.institution(),
        r.location(),
        r.funding(),
        r.regulatory(),
        r.participant(),
        r.adverse_event(),
        REPORT_DAY,
        **SITE,
    )


@query
def q1_positions(r: Roles) -> DataFrame:
    """The report with the place of each institution in its order."""
    return institutions.institution_report(
        r.institution(),
        r.location(),
        r.funding(),
        r.regulatory(),
        r.participant(),
        r.adverse_event(),
        REPORT_DAY,
        position="Position",
        **SITE,
    )


@query
def q1_as_written(r: Roles) -> DataFrame:
    return institutions.institution_report_as_written(
        r.institution(),
        r.location(),
        r.funding(),
        r.regulatory(),
        r.project(),
        r.participant(),
        r.adverse_event(),
        REPORT_DAY,
        **SITE,
    )


@query
def q2_workload(r: Roles) -> DataFrame:
    return workload.workload_report(
        r.researcher(),
        r.employment(),
        r.project(),
        r.degree(),
        r.employer(),
        WORKLOAD_DAY,
        degree_markers=DEGREES,
    )


@query
def q2_positions(r: Roles) -> DataFrame:
    """The report with the place of each researcher in its order."""
    return workload.workload_report(
        r.researcher(),
        r.employment(),
        r.project(),
        r.degree(),
        r.employer(),
        WORKLOAD_DAY,
        degree_markers=DEGREES,
        position="Position",
    )


@query
def q2_distinct_employers(r: Roles) -> DataFrame:
    return workload.distinct_employers(r.employment())


@query
def q2_as_written(r: Roles) -> DataFrame:
    return workload.workload_report_as_written(
        r.researcher(),
        r.employment(),
        r.project(),
        r.degree(),
        r.employer(),
        WORKLOAD_DAY,
        degree_markers=DEGREES,
    )


@query
def q2_best_degree(r: Roles) -> DataFrame:
    return workload.best_degree(r.degree(), *DEGREES)


@query
def q2_active_leads(r: Roles) -> DataFrame:
    return workload.active_leads(r.project(), WORKLOAD_DAY)


@query
def q2_concurrent_posts(r: Roles) -> DataFrame:
    return timelines.concurrent_posts(r.employment())


@query
def q2_concurrent_overlap(r: Roles) -> DataFrame:
    return timelines.concurrent_researchers(r.employment())


@query
def q3_irb_compliance(r: Roles) -> DataFrame:
    return compliance.renewal_report(r.project(), r.researcher(), r.home_institution(), RENEWAL_DAY)


@query
def q3_positions(r: Roles) -> DataFrame:
    """The report with the place of each trial in its order: by urgency, date and key."""
    return compliance.renewal_report(
        r.project(), r.researcher(), r.home_institution(), RENEWAL_DAY, position="Position"
    )


@query
def q3_as_written(r: Roles) -> DataFrame:
    return compliance.renewal_report(
        r.project(), r.researcher(), r.home_institution(), RENEWAL_DAY, mode="as_written"
    )


@query
def q3_by_project_site(r: Roles) -> DataFrame:
    """Site and departments of the trial instead of the investigator's home."""
    site = r.institution()
    posts = r.employment().withColumn("InstitutionID", F.col("ResearcherID"))
    return compliance.renewal_report(
        r.project(), r.researcher(), site, RENEWAL_DAY, employment=posts, institution_via="project"
    )


SPECIMEN_KEY = ["ProtocolID", "l_linenumber", "l_partkey"]


def _affected(r: Roles, scope: str = "freezer") -> DataFrame:
    return custody.affected_freezers(
        r.freezer(), r.location(), r.temperature_log(), READING_DAY, scope=scope, threshold=HOT_READING
    )


@query
def q4_violation_rollup(r: Roles) -> DataFrame:
    return violation_rollup(r.temperature_log(), READING_DAY, threshold=HOT_READING)


@query
def q4_chain_of_custody(r: Roles) -> DataFrame:
    return custody.custody_report(_affected(r), r.specimen(), r.project(), r.researcher(), SPECIMEN_KEY)


@query
def q4_chain_of_custody_by_location(r: Roles) -> DataFrame:
    """Specimens of all freezers at locations with a violation, traced to trial and lead."""
    return custody.custody_report(
        _affected(r, scope="location"), r.specimen(), r.project(), r.researcher(), SPECIMEN_KEY
    )


@query
def q4_location_scope(r: Roles) -> DataFrame:
    return _affected(r, scope="location")


@query
def q4_institution_trace(r: Roles) -> DataFrame:
    """Specimens that name no trial share only an institution with trials."""
    specimen = r.specimen().withColumnRenamed("ProtocolID", "l_orderkey")
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    return custody.custody_report(_affected(r), specimen, r.project(), r.researcher(), key)


@query
def q4_candidate_trials(r: Roles) -> DataFrame:
    return custody.candidate_trials(_affected(r), r.specimen(), r.project(), r.researcher(), SPECIMEN_KEY)


# --- data quality --------------------------------------------------------------

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


@query
def dq_unique(r: Roles) -> DataFrame:
    return quality.duplicate_keys(r.raw("lineitem"), "lineitem", ["l_orderkey", "l_linenumber"])


@query
def dq_fk_orphans(r: Roles) -> DataFrame:
    finished = r.raw("orders").where(F.col("o_orderstatus") == "F")
    return quality.orphans(r.raw("lineitem"), "lineitem", "l_orderkey", finished, "o_orderkey")


@query
def dq_checks(r: Roles) -> DataFrame:
    rules = {
        "discount_range": "l_discount BETWEEN 0 AND 0.08",
        "quantity_positive": "l_quantity > 0",
        "quantity_bound": "l_quantity <= 45",
        "flag_listed": "l_returnflag IN ('A', 'N')",
        "ships_before": "l_shipdate <= {as_of}",
    }
    return quality.broken_checks(r.raw("lineitem"), "lineitem", LINE_KEY, rules, "2001-06-01 00:00:00")


@query
def dq_not_null(r: Roles) -> DataFrame:
    people = r.researcher()
    return quality.missing_values(people, "Researcher", ["ResearcherID"], ["ORCID", "IRBRenewalDate", "Email"])


@query
def dq_text_length(r: Roles) -> DataFrame:
    return quality.overlong_text(r.raw("part"), "part", ["p_partkey"], {"p_name": 9, "p_type": 6, "p_brand": 7})


@query
def dq_cascade_delete(r: Roles) -> DataFrame:
    deleted = r.raw("customer").where(F.col("c_mktsegment") == "BUILDING")
    orders = r.raw("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return quality.cascade_delete(orders, "o_custkey", deleted, "c_custkey", spread_by=["o_orderkey"])


@query
def dq_valid_rows(r: Roles) -> DataFrame:
    rules = {"discount_range": "l_discount BETWEEN 0 AND 0.08", "quantity_bound": "l_quantity <= 45"}
    return quality.valid_rows(r.raw("lineitem").select(*LINE_KEY, "l_quantity", "l_discount"), rules)


@query
def dq_registry(r: Roles) -> DataFrame:
    """Every declared rule of all domain tables in one report."""
    return quality.check_all(domain_tables(r.spark, r.folder), REGISTRY_DAY)


APPEND_DAY = "2000-06-01"


def _arrivals(r: Roles) -> tuple[DataFrame, DataFrame]:
    """Earlier orders as filings, and a batch: later ones, some earlier ones again, and lost institutions."""
    rows = r.raw("orders").select(
        F.col("o_orderkey").alias("RegulatorID"),
        F.col("o_orderdate").cast("date").alias("IRBApprovalDate"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("FDAPhase"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") * 3).otherwise(F.col("o_custkey")).alias("InstitutionID"),
    )
    earlier = rows.where(F.col("IRBApprovalDate") < APPEND_DAY)
    again = earlier.where(F.col("FDAPhase") == 2)
    return earlier, rows.where(F.col("IRBApprovalDate") >= APPEND_DAY).unionByName(again)


@query
def dq_append(r: Roles) -> DataFrame:
    """Keys of a batch that an earlier load has, and institutions that none has, by stored indexes."""
    earlier, batch = _arrivals(r)
    own = KeyIndex.create(earlier, "RegulatorID", fresh_folder(r.spark, "filings-index"), keys_per_bucket=5000)
    parents = KeyIndex.create(
        r.raw("customer").select(F.col("c_custkey").alias("InstitutionID")),
        "InstitutionID",
        fresh_folder(r.spark, "institutions-index"),
        keys_per_bucket=5000,
    )
    return quality.check_append(batch, TABLES["Regulatory"], own, {"InstitutionID": parents})


@query
def load_quarantine(r: Roles) -> DataFrame:
    """Filings of a batch in good rows and bad ones, with the rules that these break."""
    _, batch = _arrivals(r)
    parents = {"InstitutionID": r.raw("customer").select("c_custkey")}
    path = fresh_folder(r.spark, "filings")
    batch = batch.unionByName(batch.where(F.col("FDAPhase") == 1))
    typed = tables.conform(batch, TABLES["Regulatory"])
    good, bad = load_batch(typed, TABLES["Regulatory"], path, REGISTRY_DAY, parents)
    columns = ["RegulatorID", "FDAPhase", "InstitutionID"]
    return good.select(*columns, F.lit("").alias("Rules")).unionByName(
        bad.select(*columns, F.array_join("BrokenRules", ",").alias("Rules"))
    )


def _subtypes(r: Roles) -> dict[str, DataFrame]:
    """Two segments overlap in one subtype table and one segment has none."""
    c = r.raw("customer")
    parent = c.select(
        F.col("c_custkey").alias("InstitutionID"),
        F.col("c_name").alias("LegalName"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Government")
        .when(F.col("c_mktsegment").isin("MACHINERY", "HOUSEHOLD"), "Corporate")
        .otherwise("Academic")
        .alias("Type"),
    )

    def part(segments: list[str], value: str, alias: str) -> DataFrame:
        chosen = c.where(F.col("c_mktsegment").isin(*segments))
        return chosen.select(F.col("c_custkey").alias("InstitutionID"), F.col(value).alias(alias))

    return {
        "institution": parent,
        "academic": part(["FURNITURE", "HOUSEHOLD"], "c_nationkey", "QSWorldRanking"),
        "corporate": part(["MACHINERY", "HOUSEHOLD"], "c_acctbal", "RnDBudget"),
        "government": part(["BUILDING"], "c_name", "AgencyAffiliation"),
    }


@query
def dq_subtype_partition(r: Roles) -> DataFrame:
    return quality.subtype_violations(**_subtypes(r))


@query
def institution_wide(r: Roles) -> DataFrame:
    return quality.institution_wide(**_subtypes(r))


@query
def employment_timeline(r: Roles) -> DataFrame:
    return timelines.employment_timeline(r.employment())


@query
def bsl_validation(r: Roles) -> DataFrame:
    units = r.raw("customer").select(
        F.col("c_custkey").alias("FreezerID"),
        F.col("c_nationkey").alias("LocationID"),
        F.length("c_mktsegment").alias("BSLLevel") - 6,
    )
    units = units.toDF("FreezerID", "LocationID", "BSLLevel")
    return quality.containment_violations(units, r.location())


# --- sources -------------------------------------------------------------------


@query
def schema_evolution(r: Roles) -> DataFrame:
    orders = r.raw("orders")
    old = orders.where(F.col("o_orderdate") < "1998-01-01").select("o_orderkey", "o_custkey")
    new = orders.where(F.col("o_orderdate") >= "1998-01-01").select("o_orderkey", "o_custkey", "o_orderstatus")
    return tables.evolve(old, new)


@query
def defaults_fill(r: Roles) -> DataFrame:
    batch = r.raw("events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("Status")
    )
    return tables.fill_defaults(batch, {"Status": "'Active'", "IsManualEntry": "false"})


@query
def surrogate_keys(r: Roles) -> DataFrame:
    orders = r.raw("orders").select("o_orderkey", "o_custkey")
    return assign_keys(orders, "o_orderkey", "row_id")


@query
def numbered_rows(r: Roles) -> DataFrame:
    """Lines numbered by a text, a date and their key; a third of them have one flag."""
    lines = r.raw("lineitem").select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = [F.desc("l_returnflag"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return number_rows(lines, order, "row_id")


@query
def literal_load(r: Roles) -> DataFrame:
    """Hand-written rows with generated keys, beside the region that each stands for."""
    levels = [("Lab A", 1), ("Lab B", 2), ("Lab C", 3), ("Lab D", 4), ("Lab E", 2)]
    written = tables.literal_rows(r.spark, "Location", ["Address", "BSLLabLevel"], levels)
    regions = r.raw("region").select((F.col("r_regionkey") + 1).alias("LocationID"), "r_name")
    return written.join(regions, "LocationID").select("LocationID", "Address", "BSLLabLevel", "r_name")


@query
def required_tables(r: Roles) -> DataFrame:
    """Which required tables are not there, and how many rows the others have."""
    names = ["customer", "nation", "participant", "trial"]
    missing = tables.missing_tables(r.spark, names, root=r.folder)
    gone = {row["table_name"] for row in missing.collect()}
    counts = [r.raw(n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in names if n not in gone]
    out = missing.withColumn("n_rows", F.lit(None).cast("bigint"))
    for count in counts:
        out = out.unionByName(count)
    return out


@query
def empty_guard(r: Roles) -> DataFrame:
    """A result without rows is an empty table of the stated columns; another passes."""
    nation = r.raw("nation").select("n_nationkey", "n_name")
    nobody = nation.where(F.col("n_nationkey") < 0).withColumn("extra", F.lit(1))
    return tables.or_empty(nobody, nation.schema).unionByName(tables.or_empty(nation, nation.schema))


@query
def catalog_load(r: Roles) -> DataFrame:
    """A table of the catalog in its declared schema; absent columns take their defaults."""
    r.raw("events").select(
        F.col("event_id").alias("LogID"),
        F.col("user_id").alias("FreezerID"),
        (F.col("event_id") % 90).alias("ReadingValue"),
        F.col("event_type").alias("SensorID"),
    ).createOrReplaceTempView("TemperatureLog")
    try:
        loaded = tables.load(r.spark, "TemperatureLog", as_of=READING_DAY)
        return loaded.select("LogID", "FreezerID", "ReadingValue", "ReadingTime", "SensorID", "IsManualEntry")
    finally:
        r.spark.catalog.dropTempView("TemperatureLog")


@query
def append_with_keys(r: Roles) -> DataFrame:
    existing = r.raw("customer").select(F.col("c_custkey").alias("row_id"))
    batch = r.raw("supplier").select("s_suppkey", "s_name")
    return tables.append_with_keys(existing, batch, "row_id", "s_suppkey")


@query
def replaced_table(r: Roles) -> DataFrame:
    """Overwrite sink: write, replace by another result, read back."""
    path = fresh_folder(r.spark, "replaced")
    tables.replace_table(r.raw("customer").select("c_custkey"), path)
    released = r.raw("customer").select("c_custkey", "c_mktsegment")
    tables.replace_table(released, path)
    return r.spark.read.schema(released.schema).parquet(path)


@query
def reading_log_by_day(r: Roles) -> DataFrame:
    """Day-partitioned log; the recency filter reads the days it needs."""
    path = fresh_folder(r.spark, "readings")
    tables.write_log(r.temperature_log(), path)
    since = asof.days_before(READING_DAY, 7)
    log = r.spark.read.parquet(path).where(
        (F.col("ReadingDay") >= F.to_date(since)) & (F.col("ReadingTime") >= since)
    )
    return log.select("LogID", "FreezerID", "ReadingValue")


@query
def first_rows(r: Roles) -> DataFrame:
    return tables.preview(r.raw("customer").select("c_custkey", "c_name").orderBy("c_custkey"))


@query
def orcid_check(r: Roles) -> DataFrame:
    """Order keys written in the shape of researcher identifiers."""
    digits = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    last = F.when(F.col("o_orderstatus") == "P", "X").otherwise(F.substring(digits, 8, 1))
    orcid = F.concat(
        F.lit("0000-000"),
        F.substring("o_orderpriority", 1, 1),
        F.lit("-"),
        F.substring(digits, 1, 4),
        F.when(F.col("o_orderstatus") == "F", "_").otherwise("-"),
        F.substring(digits, 5, 3),
        last,
    )
    return r.raw("orders").select("o_orderkey", orcid.alias("ORCID"), valid_orcid(orcid).alias("valid"))


# --- de-identification ---------------------------------------------------------


WIDE = {"iterations": None, "groups": GROUPS, "digits": DIGITS}


def _ids(r: Roles) -> DataFrame:
    return r.raw("customer").select(F.col("c_custkey").alias("ParticipantID"))


def _people(r: Roles) -> DataFrame:
    return r.raw("customer").select(
        F.col("c_custkey").alias("ParticipantID"),
        F.col("c_name").alias("Name"),
        F.col("c_nationkey").alias("InstitutionID"),
        F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_acctbal").cast("int")).alias("Age"),
    )


@query
def anon_hash(r: Roles) -> DataFrame:
    return deident.add_hash(_ids(r), "ParticipantID", SALT)


@query
def anon_pbkdf2(r: Roles) -> DataFrame:
    return deident.add_stretched_hash(_ids(r), "ParticipantID", SALT)


@query
def anon_pbkdf2_short(r: Roles) -> DataFrame:
    """Few iterations, which SQL can follow."""
    return deident.add_stretched_hash(_ids(r), "ParticipantID", SALT, iterations=4)


@query
def anon_pseudonym(r: Roles) -> DataFrame:
    return deident.add_pseudonym(_ids(r), "ParticipantID", SALT, GROUPS)


@query
def anon_random_id(r: Roles) -> DataFrame:
    return deident.add_random_id(_ids(r), "ParticipantID", SALT, DIGITS)


@query
def anon_jitter(r: Roles) -> DataFrame:
    key = keyed.secret(r.spark, SALT)
    noisy = keyed.jitter(key, F.col("ParticipantID"), F.col("Age"))
    return _people(r).select("ParticipantID", noisy.cast("bigint").alias("Age"))


@query
def anon_publish(r: Roles) -> DataFrame:
    mapping = deident.generate_mapping(_ids(r), SALT, **WIDE)
    return deident.anonymize_participants(_people(r), mapping, SALT)


@query
def anon_incremental(r: Roles) -> DataFrame:
    """Customers of one segment arrive after the others were mapped."""
    earlier = r.raw("customer").where(F.col("c_mktsegment") != "BUILDING")
    stored = deident.generate_mapping(earlier, SALT, id_col="c_custkey", **WIDE)
    return deident.extend_mapping(stored, _ids(r), SALT, **WIDE)


@query
def anon_release(r: Roles) -> DataFrame:
    """Two releases: the second extends the stored mapping by new ids."""
    mapping, target = fresh_folder(r.spark, "mapping"), fresh_folder(r.spark, "released")
    people = _people(r)
    deident.release(people.where(F.col("Age").isNotNull()), mapping, target, SALT, **WIDE)
    released = deident.release(people, mapping, target, SALT, **WIDE)
    # The mapping holds the real keys and must not stay in a scratch folder.
    discard(r.spark, mapping)
    return released


@query
def k_anonymity(r: Roles) -> DataFrame:
    return deident.small_groups(r.raw("customer"), ["c_mktsegment", "c_nationkey"], 10)


@query
def k_anonymity_suppressed(r: Roles) -> DataFrame:
    people = r.raw("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return deident.suppress_small_groups(people, ["c_mktsegment", "c_nationkey"], 10, spread_by=["c_custkey"])


@query
def dp_counts(r: Roles) -> DataFrame:
    return deident.private_totals(r.raw("customer"), ["c_mktsegment"], "c_acctbal", 5000, 1.0, SALT)


DP_LOSS = privacy.Loss(epsilon=2.0, delta=1e-6, most_groups=3, most_rows=2)


@query
def dp_release(r: Roles) -> DataFrame:
    """Orders of a priority and year, of which one customer adds a few; the ledger has room for one release."""
    orders = r.raw("orders").withColumn("year", F.year("o_orderdate"))
    ledger = fresh_folder(r.spark, "ledger")
    return privacy.private_release(
        orders,
        "o_custkey",
        ["o_orderpriority", "year"],
        ["o_orderkey"],
        F.col("o_totalprice"),
        100_000,
        DP_LOSS,
        SALT,
        ledger,
        "orders",
        budget=2.0,
    )


@query
def k_anonymity_generalised(r: Roles) -> DataFrame:
    """Every customer with spans of nation, balance and segment that ten and more share."""
    people = r.raw("customer").select(
        "c_custkey", "c_nationkey", F.floor("c_acctbal").cast("int").alias("balance"), "c_mktsegment"
    )
    return privacy.generalise(people, ["c_nationkey", "balance", "c_mktsegment"], 10, ["c_custkey"])


# --- streams -------------------------------------------------------------------


@query
def stream_violation_windows(r: Roles) -> DataFrame:
    stream = freezers.violation_windows(r.reading_stream(), threshold=HOT_READING)
    return run_available(stream, "violation-windows")


@query
def stream_sliding_stats(r: Roles) -> DataFrame:
    table = run_available(freezers.sliding_stats(r.reading_stream()), "sliding-stats")
    return table.select(
        "FreezerID",
        "WindowStart",
        "WindowEnd",
        "Readings",
        F.round("MeanValue", 6).alias("MeanValue"),
        F.round("Deviation", 6).alias("Deviation"),
    )


@query
def stream_dedup(r: Roles) -> DataFrame:
    """Each reading arrives twice, as two deliveries of one log."""
    stream = r.reading_stream()
    return run_available(freezers.distinct_readings(stream.unionAll(stream)), "dedup")


@query
def stream_enrich(r: Roles) -> DataFrame:
    stream = freezers.with_freezer(r.reading_stream(), r.freezer())
    return run_available(stream.select("LogID", "FreezerID", "FreezerName", "LocationID", "ReadingValue"), "enrich")


@query
def stream_alarm(r: Roles) -> DataFrame:
    states = freezers.states_stream(r.reading_stream(), threshold=100)
    path = fresh_folder(r.spark, "states")
    run_available(states, "states", out=path)
    return run_available(freezers.alarms(path, states, length=3), "alarms")


@query
def stream_access_bursts(r: Roles) -> DataFrame:
    return run_available(access.bursts(r.access_stream(), more_than=2, window="6 hours"), "bursts")


@query
def stream_access_sessions(r: Roles) -> DataFrame:
    return run_available(access.sessions(r.access_stream(), gap="150 minutes"), "sessions", conf=MERGED_EARLY)


@query
def stream_audit_summary(r: Roles) -> DataFrame:
    return run_available(access.audit_summary(r.access_stream()), "audit")


def _reading_alarms(r: Roles) -> DataFrame:
    """Alarms on all readings; a beat of freezer 0 long after them ends the open runs."""
    at_end = r.closing(
        r.readings(), FreezerID=F.lit(0), ReadingTime=F.lit(LONG_AFTER), Batch=F.lit(BATCHES)
    )
    stream = replay(at_end, "Batch", BATCHES + 1)
    return run_available(
        reading_alarms(stream, length=3, threshold=100, quiet="60 days"), "reading-alarms", conf=ROCKSDB
    )


@query
def stream_alarm_readings(r: Roles) -> DataFrame:
    """Runs of three and more violating readings, when they end."""
    ended = _reading_alarms(r).where(F.col("State") == ENDED)
    return ended.select("FreezerID", "Readings", "RunStart", "RunEnd", "PeakValue")


@query
def stream_alarm_raised(r: Roles) -> DataFrame:
    """The third violating reading in a row, when it is there."""
    raised = _reading_alarms(r).where(F.col("State") == RAISED)
    return raised.select("FreezerID", "RunStart", F.col("RunEnd").alias("RaisedAt"), "PeakValue")


@query
def stream_late(r: Roles) -> DataFrame:
    """Every reading once or twice, some a batch or two behind: kept, duplicates and late.

    Readings whose id ends in 7 come one batch later, those that end in 77 two; those
    that end in 5 come twice in a batch, those that end in 3 again in the next one.
    """
    once, log = r.readings(), F.col("LogID")
    behind = F.when(log % 100 == 77, 2).when(log % 10 == 7, 1).otherwise(0)
    again = once.where((log % 10).isin(3, 5)).withColumn("Batch", F.col("Batch") + F.when(log % 10 == 3, 1).otherwise(0))
    sent = once.withColumn("Batch", F.col("Batch") + behind).unionByName(again)
    path = fresh_folder(r.spark, "delivered")
    delivered = deliveries(replay(sent, "Batch", BATCHES + 2), "ReadingTime", "delivered", out=path)
    kept = run_available(freezers.distinct_readings(on_time(delivered, path)), "kept")
    return account(delivered, kept, "LogID")


@query
def stream_enrich_changes(r: Roles) -> DataFrame:
    """Each reading with the setting of its freezer at its time; sign-ups change settings."""
    events = r.raw("events").withColumns({"At": F.col("ts").cast("timestamp"), "Batch": r.event_batch()})
    readings = events.where(F.col("event_type") != "signup").select(
        F.col("user_id").alias("FreezerID"),
        F.col("At").alias("ReadingTime"),
        F.col("event_id").alias("LogID"),
        F.col("value").alias("ReadingValue"),
        "Batch",
    )
    changes = events.where(F.col("event_type") == "signup").select(
        F.col("user_id").alias("FreezerID"),
        F.col("At").alias("ValidFrom"),
        F.col("event_id").alias("ChangeID"),
        F.get_json_object("props", "$.k").cast("int").alias("Setting"),
        "Batch",
    )
    readings = r.closing(readings, FreezerID=F.lit(0), ReadingTime=F.lit(LONG_AFTER), Batch=F.lit(BATCHES))
    changes = r.closing(changes, FreezerID=F.lit(0), ValidFrom=F.lit(LONG_AFTER), Batch=F.lit(BATCHES))
    joined = with_version(
        replay(readings, "Batch", BATCHES + 1, "readings"), replay(changes, "Batch", BATCHES + 1, "changes")
    )
    return run_available(joined, "versions", conf=ROCKSDB)


@query
def alarm_runs(r: Roles) -> DataFrame:
    return violation_runs(r.temperature_log(), length=3, threshold=100)


@query
def alarm_windows(r: Roles) -> DataFrame:
    return window_alarms(window_states(r.temperature_log(), "1 hour", threshold=100), length=3)


# --- analytics -----------------------------------------------------------------


@query
def publication_impact(r: Roles) -> DataFrame:
    return analytics.publication_impact(r.publication())


@query
def adverse_event_histogram(r: Roles) -> DataFrame:
    return analytics.adverse_event_histogram(r.participant(), r.adverse_event())


@query
def funding_efficiency(r: Roles) -> DataFrame:
    papers = r.raw("orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("InstitutionID"))
    patents = (
        r.raw("orders")
        .where(F.col("o_orderpriority") == "1-URGENT")
        .select(F.col("o_custkey").alias("InstitutionID"), F.col("o_totalprice").alias("LicensingRevenue"))
    )
    return analytics.funding_efficiency(r.funding(), papers, patents, r.project())


@query
def coi_match(r: Roles) -> DataFrame:
    """Customer names as disclosures, supplier names as companies.

    The word that all supplier names share, put at the end, plays the part of a
    legal form.
    """
    number = F.split("s_name", "#")[1]
    companies = r.raw("supplier").select(
        F.col("s_suppkey").alias("InstitutionID"),
        F.concat(number, F.lit(" Supplier")).alias("ParentCompany"),
    )
    disclosures = r.raw("customer").select(
        F.col("c_custkey").alias("ResearcherID"), F.col("c_name").alias("COIDisclosure")
    )
    return analytics.conflict_matches(disclosures, companies, ignored=["supplier"])


@query
def coi_match_names(r: Roles) -> DataFrame:
    """Part names of several words as companies, with legal forms in and after them."""
    form = F.element_at(F.array(F.lit(" Inc"), F.lit(" Co Ltd"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int"))
    companies = r.raw("part").select(
        F.col("p_partkey").alias("InstitutionID"),
        F.concat(F.lit("SA "), "p_name", form).alias("ParentCompany"),
    )
    disclosures = r.raw("part").select(
        F.col("p_partkey").alias("ResearcherID"),
        F.concat(
            F.lit("Paid by "),
            F.when(F.col("p_size") % 2 == 0, F.lit("SA ")).otherwise(""),
            "p_name",
            F.lit(", and others"),
        ).alias("COIDisclosure"),
    )
    return analytics.conflict_matches(disclosures, companies)


@query
def trial_features(r: Roles) -> DataFrame:
    trials = r.project().withColumn("StartDate", F.date_sub("EndDate", 100))
    return analytics.trial_features(
        trials, r.regulatory(), r.funding(), r.participant(), r.adverse_event(), r.withdrawal(), REPORT_DAY
    )


@query
def trial_features_known(r: Roles) -> DataFrame:
    """Features at the start of each trial; lines ship on the day of their event."""
    trials = r.project().withColumn("StartDate", F.date_sub("EndDate", 100))
    orders, lines = r.raw("orders"), r.raw("lineitem")
    grants = orders.select(
        F.col("o_custkey").alias("InstitutionID"),
        F.col("o_totalprice").cast("decimal(15,2)").alias("Disbursements"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("AwardDate"),
    )
    events = lines.select(
        F.col("l_orderkey").alias("ParticipantID"),
        F.when(F.col("l_linenumber") < 5, F.col("l_linenumber")).alias("SeverityGrade"),
        F.col("l_shipdate").alias("ReportDate"),
    )
    left = lines.where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("ParticipantID"), F.col("l_shipdate").alias("WithdrawalDate")
    )
    return analytics.trial_features_known(trials, r.regulatory(), grants, r.participant(), events, left)
