"""SQL for DuckDB that states each registered query on the given tables."""

from __future__ import annotations

from bindings.domain import registry_oracle
from bindings.roles import DIGITS, GROUPS
from labmesh.functions.keyed import numeric_factors, readable_factors

ORACLES: dict[str, str] = {}

# Views of the given tables in their domain roles, as common table expressions.
REGULATORY = """
reg AS (
  SELECT o_custkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS phase,
         CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 'ITAR'
              WHEN o_orderstatus = 'O' THEN 'EAR99' END AS export,
         CAST(o_orderdate AS DATE) AS approved
  FROM orders)"""

SITES = """
sites AS (
  SELECT c_custkey AS id, c_name AS LegalName
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE c_mktsegment = 'BUILDING' AND n_regionkey = 4)"""

MONEY = """
money AS (SELECT o_custkey AS id, sum(CAST(o_totalprice AS DECIMAL(15,2))) AS total FROM orders GROUP BY 1)"""

POSTS = """
posts AS (
  SELECT row_number() OVER () AS n, l_orderkey AS rec, o_custkey AS person, l_suppkey AS inst,
         CAST(o_orderdate AS DATE) AS f,
         CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS e,
         CAST(l_discount AS DECIMAL(3,2)) AS fte, l_returnflag AS dept
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

RESEARCHER = """
latest AS (
  SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS d,
         arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s
  FROM orders GROUP BY 1),
people AS (
  SELECT c_custkey AS id, c_name, c_mktsegment, c_nationkey AS home,
         CASE WHEN s <> 'P' THEN d END AS renewal,
         split_part(c_name, '#', 1) || ' ' || split_part(c_name, '#', 2) AS full_name,
         split_part(c_name, '#', 2) || '@example.org' AS email
  FROM customer LEFT JOIN latest ON c_custkey = o_custkey)"""

DEGREE = """
deg AS (
  SELECT o_custkey AS id, o_orderpriority AS field,
         row_number() OVER (
           PARTITION BY o_custkey
           ORDER BY CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 1
                         WHEN o_orderpriority LIKE '%HIGH%' THEN 2 ELSE 3 END,
                    year(o_orderdate) DESC, o_orderkey) AS rn
  FROM orders),
best AS (SELECT id, field FROM deg WHERE rn = 1)"""

ACTIVE = """
act AS (
  SELECT o_custkey AS id, count(*) AS n FROM orders
  WHERE CAST(o_orderdate AS DATE) > DATE '2000-01-01' GROUP BY 1 HAVING count(*) > 3)"""

SEVERITY = """
sev AS (
  SELECT o_custkey AS id, sum(l_linenumber) AS s, count(l_linenumber) AS n
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)"""

ORACLES["q1_institution_report"] = f"""
WITH {REGULATORY}, {SITES}, {MONEY}, {SEVERITY}
SELECT LegalName, total AS TotalFundingReceived, s::DOUBLE / n::DOUBLE AS AverageSeverityGrade
FROM sites JOIN money USING (id) LEFT JOIN sev USING (id)
WHERE id IN (SELECT id FROM reg WHERE phase = 3 AND approved >= DATE '2001-08-01' - INTERVAL 5 YEAR)
  AND id NOT IN (SELECT id FROM reg WHERE export IN ('ITAR', 'EAR'))
"""

ORACLES["q1_as_written"] = f"""
WITH {REGULATORY}, {SITES}, {MONEY},
r AS (SELECT id, count(*) AS n FROM reg
      WHERE phase = 3 AND (export IS NULL OR export NOT IN ('ITAR', 'EAR'))
        AND approved >= TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 5 YEAR GROUP BY 1),
p AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1),
fan AS (SELECT count(*) AS n, sum(l_linenumber) AS s, count(l_linenumber) AS c
        FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)
SELECT LegalName,
       CAST(total * r.n * p.n * (SELECT n FROM fan) AS DECIMAL(38,2)) AS TotalFundingReceived,
       CAST((SELECT s // c FROM fan) AS BIGINT) AS AverageSeverityGrade
FROM sites JOIN money USING (id) JOIN r USING (id) JOIN p USING (id)
"""

ORACLES["q2_workload"] = f"""
WITH {POSTS}, {DEGREE}, {ACTIVE},
load AS (
  SELECT person AS id, count(DISTINCT inst) AS insts, sum(fte) AS fte,
         string_agg(DISTINCT s_name, '; ' ORDER BY s_name) AS names
  FROM posts JOIN supplier ON inst = s_suppkey WHERE e IS NULL GROUP BY 1 HAVING count(DISTINCT inst) > 1)
SELECT c_custkey AS ResearcherID, substr(c_name, 10, 9) AS NIHHISID, c_name AS ORCID,
       c_mktsegment AS SecurityClearance, insts AS InstitutionCount, act.n AS ActiveProjectCount,
       CAST(load.fte AS DECIMAL(38,2)) AS TotalFTE, CAST(load.fte * 100 AS DECIMAL(38,2)) AS TotalFTEPercent,
       best.field AS HighestQualification, names AS Institutions
FROM customer JOIN load ON load.id = c_custkey JOIN act ON act.id = c_custkey LEFT JOIN best ON best.id = c_custkey
"""

ORACLES["q2_as_written"] = f"""
WITH {POSTS}, {DEGREE}, {ACTIVE},
cr AS (
  SELECT c_custkey AS id, count(DISTINCT c_nationkey) AS insts
  FROM customer JOIN posts ON person = c_custkey WHERE e IS NULL GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1)
SELECT c_custkey AS ResearcherID, substr(c_name, 10, 9) AS NIHHISID, c_name AS ORCID,
       c_mktsegment AS QualificationLevel, insts AS InstitutionCount, act.n AS ActiveProjectCount,
       CAST(sum(posts.fte) AS DECIMAL(38,2)) AS TotalFTE, any_value(best.field) AS HighestQualification,
       string_agg(s_name, '; ' ORDER BY s_name) AS Institutions
FROM customer JOIN cr ON cr.id = c_custkey JOIN act ON act.id = c_custkey
JOIN posts ON person = c_custkey JOIN supplier ON inst = s_suppkey LEFT JOIN best ON best.id = c_custkey
WHERE e IS NULL GROUP BY ALL
"""

ORACLES["q2_best_degree"] = f"WITH {DEGREE} SELECT id AS ResearcherID, field AS HighestQualification FROM best"

ORACLES["q2_active_leads"] = f"WITH {ACTIVE} SELECT id AS ResearcherID, n AS ActiveProjectCount FROM act"

OVERLAPS = f"""
{POSTS},
span AS (SELECT n, rec, person, inst, f, coalesce(e, DATE '9999-12-31') AS e FROM posts
         WHERE f < coalesce(e, DATE '9999-12-31')),
hits AS (
  SELECT a.n, a.rec, a.person, a.inst, count(b.n) AS k
  FROM span a LEFT JOIN span b
    ON a.person = b.person AND a.inst <> b.inst AND a.f < b.e AND b.f < a.e
  GROUP BY ALL)"""

ORACLES["q2_concurrent_posts"] = f"""
WITH {OVERLAPS}
SELECT rec AS ExperienceRecordID, person AS ResearcherID, inst AS InstitutionID, k AS ConcurrentElsewhere FROM hits
"""

ORACLES["q2_concurrent_overlap"] = f"""
WITH {OVERLAPS}
SELECT person AS ResearcherID, CAST(sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) AS BIGINT) AS ConcurrentPosts,
       CAST(sum(k) // 2 AS BIGINT) AS OverlappingPairs, max(k) AS MostConcurrent
FROM hits GROUP BY 1 HAVING sum(k) > 0
"""


def _renewals(states: str, site: str, site_name: str, kind: str, extra: str = "", join: str = "") -> str:
    return f"""
WITH {RESEARCHER}, {POSTS}
SELECT {site_name} AS Institution, {kind} AS InstitutionType, full_name AS PrincipalInvestigator, email AS PI_Contact,
       o_orderkey AS ProtocolID, 'Trial ' || o_orderkey AS ProjectTitle, renewal AS IRBRenewalDate,
       {states}{extra}
FROM orders JOIN people ON o_custkey = people.id JOIN {site} {join}
WHERE renewal IS NULL OR renewal <= {{limit}}
"""


SPECIFIED = """
       CASE WHEN renewal IS NULL THEN 'MISSING' WHEN renewal < DATE '2001-01-15' THEN 'PAST DUE'
            ELSE 'DUE WITHIN 30 DAYS' END AS RenewalStatus,
       CASE WHEN renewal IS NULL THEN '⚪ GREY' WHEN renewal < DATE '2001-01-15' THEN '🔴 RED'
            ELSE '🟡 YELLOW' END AS StatusColor"""

AS_WRITTEN = """
       CASE WHEN renewal < TIMESTAMP '2001-01-15 12:00:00' THEN 'PAST DUE'
            WHEN renewal <= TIMESTAMP '2001-02-14 12:00:00' THEN 'DUE WITHIN 30 DAYS'
            ELSE 'UP TO DATE' END AS RenewalStatus,
       CASE WHEN renewal < TIMESTAMP '2001-01-15 12:00:00' THEN '🔴 RED'
            WHEN renewal <= TIMESTAMP '2001-02-14 12:00:00' THEN '🟡 YELLOW'
            ELSE '🟢 GREEN' END AS StatusColor"""

HOME = ("nation ON home = n_nationkey", "n_name", "CAST(n_regionkey AS VARCHAR)")

ORACLES["q3_irb_compliance"] = _renewals(SPECIFIED, *HOME).format(limit="DATE '2001-02-14'")
ORACLES["q3_as_written"] = _renewals(AS_WRITTEN, *HOME).format(limit="TIMESTAMP '2001-02-14 12:00:00'")
ORACLES["q3_by_project_site"] = _renewals(
    SPECIFIED,
    "customer c ON o_custkey = c.c_custkey",
    "c.c_name",
    "c.c_mktsegment",
    extra=", depts AS Department",
    join="""LEFT JOIN (SELECT person, string_agg(DISTINCT dept, '; ' ORDER BY dept) AS depts
                       FROM posts WHERE e IS NULL GROUP BY 1) ON person = o_custkey""",
).format(limit="DATE '2001-02-14'")

ROLLUP = """
roll AS (
  SELECT user_id AS fid, max(value) AS MaxViolationTemp, min(ts) AS FirstViolation, max(ts) AS LastViolation,
         count(*) AS ViolationCount
  FROM events
  WHERE value >= 150 AND ts >= TIMESTAMP '2024-01-24 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00'
  GROUP BY 1)"""

ROLL_COLUMNS = "MaxViolationTemp, FirstViolation, LastViolation, ViolationCount"

ORACLES["q4_violation_rollup"] = f"WITH {ROLLUP} SELECT fid AS FreezerID, {ROLL_COLUMNS} FROM roll"

UNITS = f"""
{ROLLUP},
unit AS (
  SELECT s_suppkey AS FreezerID, s_name AS FreezerName, n_name AS Location, {ROLL_COLUMNS}
  FROM supplier JOIN roll ON s_suppkey = fid JOIN nation ON s_nationkey = n_nationkey)"""

ORACLES["q4_chain_of_custody"] = f"""
WITH {UNITS}, {RESEARCHER}
SELECT FreezerID, FreezerName, Location, {ROLL_COLUMNS}, l_orderkey AS ProtocolID, l_linenumber, l_partkey,
       CAST(l_quantity AS INT) AS AliquotCounts, l_partkey AS InstitutionID,
       'Trial ' || o_orderkey AS ProjectTitle, o_custkey AS PrincipalInvestigatorID,
       full_name AS PrincipalInvestigator, email AS PI_Contact
FROM lineitem JOIN unit ON l_suppkey = FreezerID
LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN people ON o_custkey = id
"""

ORACLES["q4_location_scope"] = f"""
WITH {ROLLUP}
SELECT s_suppkey AS FreezerID, s_name AS FreezerName, s_nationkey AS LocationID, n_name AS Location, {ROLL_COLUMNS}
FROM supplier LEFT JOIN roll ON s_suppkey = fid JOIN nation ON s_nationkey = n_nationkey
WHERE s_nationkey IN (SELECT s_nationkey FROM supplier JOIN roll ON s_suppkey = fid)
"""

ORACLES["q4_institution_trace"] = f"""
WITH {UNITS}, {RESEARCHER},
per AS (SELECT o_custkey AS inst, count(*) AS k, CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS sole
        FROM orders GROUP BY 1)
SELECT FreezerID, FreezerName, Location, {ROLL_COLUMNS}, l_orderkey, l_linenumber, l_partkey,
       CAST(l_quantity AS INT) AS AliquotCounts, l_partkey AS InstitutionID, coalesce(k, 0) AS CandidateTrials,
       sole AS ProtocolID, 'Trial ' || o_orderkey AS ProjectTitle, o_custkey AS PrincipalInvestigatorID,
       full_name AS PrincipalInvestigator, email AS PI_Contact
FROM lineitem JOIN unit ON l_suppkey = FreezerID LEFT JOIN per ON l_partkey = inst
LEFT JOIN orders ON sole = o_orderkey LEFT JOIN people ON o_custkey = id
"""

ORACLES["q4_candidate_trials"] = f"""
WITH {UNITS}, {RESEARCHER},
exposed AS (
  SELECT l_partkey AS inst, count(*) AS AffectedSpecimens, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS AffectedAliquots,
         max(MaxViolationTemp) AS MaxViolationTemp, min(FirstViolation) AS FirstViolation, max(LastViolation) AS LastViolation
  FROM lineitem JOIN unit ON l_suppkey = FreezerID GROUP BY 1)
SELECT o_orderkey AS ProtocolID, 'Trial ' || o_orderkey AS ProjectTitle, o_custkey AS InstitutionID,
       o_custkey AS PrincipalInvestigatorID, AffectedSpecimens, AffectedAliquots, MaxViolationTemp, FirstViolation,
       LastViolation, full_name AS PrincipalInvestigator, email AS PI_Contact
FROM orders JOIN exposed ON o_custkey = inst LEFT JOIN people ON o_custkey = id
"""

# --- data quality --------------------------------------------------------------

ORACLES["dq_unique"] = """
SELECT 'lineitem' AS table_name, 'unique' AS rule_id, l_orderkey || '|' || l_linenumber AS row_key,
       'duplicate' AS detail, count(*) AS n_rows
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
"""

ORACLES["dq_fk_orphans"] = """
SELECT 'lineitem' AS table_name, 'l_orderkey_parent' AS rule_id, CAST(l_orderkey AS VARCHAR) AS row_key,
       'no parent' AS detail, count(*) AS n_rows
FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey
"""


def _rows(table: str, key: str, rules: list[tuple[str, str, str]]) -> str:
    """One branch per rule: name, condition that breaks it, detail."""
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{rule}' AS rule_id, {key} AS row_key, "
        f"CAST({detail} AS VARCHAR) AS detail, CAST(1 AS BIGINT) AS n_rows FROM {{source}} WHERE {test}"
        for rule, test, detail in rules
    )


LINE_KEY = "l_orderkey || '|' || l_linenumber || '|' || l_partkey"

ORACLES["dq_checks"] = _rows(
    "lineitem",
    LINE_KEY,
    [
        ("discount_range", "NOT l_discount BETWEEN 0 AND 0.08::DOUBLE", "'l_discount BETWEEN 0 AND 0.08'"),
        ("quantity_positive", "NOT l_quantity > 0", "'l_quantity > 0'"),
        ("quantity_bound", "NOT l_quantity <= 45", "'l_quantity <= 45'"),
        ("flag_listed", "l_returnflag NOT IN ('A', 'N')", "'l_returnflag IN (''A'', ''N'')'"),
        (
            "ships_before",
            "l_shipdate > TIMESTAMP '2001-06-01 00:00:00'",
            "'l_shipdate <= timestamp''2001-06-01 00:00:00'''",
        ),
    ],
).format(source="lineitem")

ORACLES["dq_not_null"] = f"WITH {RESEARCHER} " + _rows(
    "Researcher",
    "CAST(id AS VARCHAR)",
    [
        ("ORCID_required", "c_name IS NULL", "'NULL'"),
        ("IRBRenewalDate_required", "renewal IS NULL", "'NULL'"),
        ("Email_required", "email IS NULL", "'NULL'"),
    ],
).format(source="people")

ORACLES["dq_registry"] = registry_oracle()

ARRIVALS = """
rows AS (
  SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(substr(o_orderpriority, 1, 1) AS INT) AS phase,
         CASE WHEN o_orderstatus = 'P' THEN o_custkey * 3 ELSE o_custkey END AS inst
  FROM orders),
batch AS (SELECT * FROM rows WHERE d >= DATE '2000-06-01' OR phase = 2)"""

ORACLES["dq_append"] = f"""
WITH {ARRIVALS}
SELECT 'Regulatory' AS table_name, 'primary_key' AS rule_id, CAST(k AS VARCHAR) AS row_key, 'known' AS detail,
       count(*) AS n_rows
FROM batch WHERE d < DATE '2000-06-01' GROUP BY k
UNION ALL
SELECT 'Regulatory', 'InstitutionID_parent', CAST(inst AS VARCHAR), 'no parent', count(*) FROM batch
WHERE inst NOT IN (SELECT c_custkey FROM customer) GROUP BY inst
"""

ORACLES["load_quarantine"] = f"""
WITH {ARRIVALS}, twice AS (SELECT * FROM batch UNION ALL SELECT * FROM batch WHERE phase = 1)
SELECT CAST(k AS INT) AS RegulatorID, phase AS FDAPhase, CAST(inst AS INT) AS InstitutionID,
       concat_ws(',', CASE WHEN inst NOT IN (SELECT c_custkey FROM customer) THEN 'InstitutionID_parent' END,
                 CASE WHEN phase > 4 THEN 'phase_range' END, CASE WHEN phase = 1 THEN 'primary_key' END) AS Rules
FROM twice
"""

ORACLES["dq_text_length"] = _rows(
    "part",
    "CAST(p_partkey AS VARCHAR)",
    [
        ("p_name_length", "length(p_name) > 9", "length(p_name)"),
        ("p_type_length", "length(p_type) > 6", "length(p_type)"),
        ("p_brand_length", "length(p_brand) > 7", "length(p_brand)"),
    ],
).format(source="part")

ORACLES["dq_cascade_delete"] = """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')
"""

ORACLES["dq_valid_rows"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount FROM lineitem
WHERE l_discount BETWEEN 0 AND 0.08::DOUBLE AND l_quantity <= 45
"""

SUBTYPES = """
parent AS (
  SELECT c_custkey AS id, c_name, c_nationkey, c_acctbal, c_mktsegment AS seg,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'Government'
              WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN 'Corporate' ELSE 'Academic' END AS Type
  FROM customer),
held AS (
  SELECT *, seg IN ('FURNITURE', 'HOUSEHOLD') AS a, seg IN ('MACHINERY', 'HOUSEHOLD') AS c, seg = 'BUILDING' AS g
  FROM parent)"""

ORACLES["dq_subtype_partition"] = f"""
WITH {SUBTYPES}
SELECT 'Institution' AS table_name,
       CASE WHEN NOT (a OR c OR g) THEN 'subtype_missing' WHEN a AND c THEN 'subtypes_overlap'
            ELSE 'subtype_disagrees' END AS rule_id,
       CAST(id AS VARCHAR) AS row_key,
       concat_ws(',', CASE WHEN a THEN 'Academic' END, CASE WHEN c THEN 'Corporate' END,
                 CASE WHEN g THEN 'Government' END) AS detail,
       CAST(1 AS BIGINT) AS n_rows
FROM held
WHERE a::INT + c::INT + g::INT <> 1
   OR Type <> CASE WHEN a THEN 'Academic' WHEN c THEN 'Corporate' ELSE 'Government' END
"""

ORACLES["institution_wide"] = f"""
WITH {SUBTYPES}
SELECT id AS InstitutionID, c_name AS LegalName, Type, CASE WHEN a THEN c_nationkey END AS QSWorldRanking,
       CASE WHEN c THEN c_acctbal END AS RnDBudget, CASE WHEN g THEN c_name END AS AgencyAffiliation
FROM held
"""

ORACLES["employment_timeline"] = f"""
WITH {POSTS},
d AS (SELECT person, f, count(*) AS n, max(coalesce(e, DATE '9999-12-31')) AS e FROM posts GROUP BY 1, 2),
w AS (SELECT *, max(e) OVER (PARTITION BY person ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM d)
SELECT person AS ResearcherID, f AS StartDate, n AS PostsStarted, prev AS PreviousEnd,
       CAST(date_diff('day', prev, f) AS INT) AS GapDays,
       CASE WHEN date_diff('day', prev, f) > 1 THEN 'GAP' WHEN date_diff('day', prev, f) < 0 THEN 'OVERLAP'
            WHEN prev IS NOT NULL THEN 'CONTINUOUS' END AS Transition
FROM w
"""

ORACLES["bsl_validation"] = """
SELECT c_custkey AS FreezerID, c_nationkey AS LocationID, CAST(length(c_mktsegment) - 6 AS INT) AS BSLLevel,
       n_regionkey AS BSLLabLevel
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE length(c_mktsegment) - 6 > n_regionkey
"""

# --- sources -------------------------------------------------------------------

ORACLES["schema_evolution"] = """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_orderstatus END AS o_orderstatus
FROM orders
"""

ORACLES["defaults_fill"] = """
SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS Status, false AS IsManualEntry FROM events
"""

ORACLES["surrogate_keys"] = """
SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS row_id FROM orders
"""

ORACLES["append_with_keys"] = """
SELECT s_suppkey, s_name, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey) AS row_id
FROM supplier
"""

ORACLES["replaced_table"] = "SELECT c_custkey, c_mktsegment FROM customer"

ORACLES["reading_log_by_day"] = """
SELECT event_id AS LogID, user_id AS FreezerID, value AS ReadingValue FROM events
WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'
"""

ORACLES["first_rows"] = "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 3"

ORACLES["orcid_check"] = """
WITH o AS (
  SELECT o_orderkey,
         '0000-000' || substr(o_orderpriority, 1, 1) || '-' || substr(lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), 1, 4)
         || CASE WHEN o_orderstatus = 'F' THEN '_' ELSE '-' END
         || substr(lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), 5, 3)
         || CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE substr(lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), 8, 1) END AS ORCID
  FROM orders)
SELECT o_orderkey, ORCID, regexp_matches(ORCID, '^0000-000[1-9]-[0-9]{4}-[0-9]{3}[0-9X]$') AS valid FROM o
"""

# --- de-identification ---------------------------------------------------------


def _draw(text: str) -> str:
    """The number that a keyed hash of ``text`` draws."""
    return f"CAST('0x' || substr(sha256('test-salt' || {text}), 1, 8) AS BIGINT)"


def _mix(prefix: str, a: int, b: int, purpose: str) -> str:
    """CTEs from ``ids(id)`` to ``<prefix>8(id, l, r)`` in eight rounds."""
    wide = "CAST('0x' || substr(sha256('test-salt' || {}), 1, 15) AS BIGINT)"
    out = [f"{prefix}0 AS (SELECT id, id // {b} AS l, id % {b} AS r FROM ids)"]
    for i in range(8):
        left, right = "l", "r"
        if i % 2 == 0:
            hashed = wide.format(f"':{purpose}:{i}:' || r")
            left = f"(l + {hashed}) % {a} AS l"
        else:
            hashed = wide.format(f"':{purpose}:{i}:' || l")
            right = f"(r + {hashed}) % {b} AS r"
        out.append(f"{prefix}{i + 1} AS (SELECT id, {left}, {right} FROM {prefix}{i})")
    return ", ".join(out)


def _mapping(source: str) -> str:
    """CTEs ending in ``mapping`` for the ids that ``source`` selects, at the stated widths."""
    width = 2 + 3 * GROUPS
    forms = 10**width
    image = f"(p8.l * {readable_factors(GROUPS)[1]} + p8.r)"
    digits = f"lpad(CAST({image} % {forms} AS VARCHAR), {width}, '0')"
    parts = [f"substr({digits}, 1, 2)", *(f"substr({digits}, {3 + 3 * g}, 3)" for g in range(GROUPS))]
    return f"""
ids AS ({source}), {_mix("p", *readable_factors(GROUPS), "pseudonym")}, {_mix("n", *numeric_factors(DIGITS), "random")},
mapping AS (
  SELECT p8.id AS original_id,
         'P-' || chr(CAST(65 + {image} // {26 * forms} AS INT)) || chr(CAST(65 + ({image} // {forms}) % 26 AS INT)) || '-'
         || {" || '-' || ".join(parts)} AS pseudonym,
         sha256('test-salt' || p8.id) AS hashed_id,
         {10 ** (DIGITS - 1)} + n8.l * {numeric_factors(DIGITS)[1]} + n8.r AS random_id
  FROM p8 JOIN n8 ON p8.id = n8.id)"""


ALL_IDS = "SELECT c_custkey AS id FROM customer"
JITTERED = f"CAST(trunc(c_acctbal) AS INT) + {_draw(chr(39) + 'j' + chr(39) + ' || c_custkey')} % 5 - 2"
AGE = f"CASE WHEN c_mktsegment <> 'FURNITURE' THEN {JITTERED} END"

ORACLES["anon_hash"] = """
SELECT c_custkey AS ParticipantID, sha256('test-salt' || c_custkey) AS hashed_id FROM customer
"""
ORACLES["anon_pbkdf2_short"] = """
WITH RECURSIVE keys AS (
  SELECT id, CAST(xor(k, CAST(unhex(repeat('36', 64)) AS BIT)) AS BLOB) AS inner_key,
         CAST(xor(k, CAST(unhex(repeat('5c', 64)) AS BIT)) AS BLOB) AS outer_key
  FROM (SELECT c_custkey AS id, CAST(encode(CAST(c_custkey AS VARCHAR))
          || unhex(repeat('00', 64 - length(CAST(c_custkey AS VARCHAR)))) AS BIT) AS k FROM customer)),
rounds AS (
  SELECT id, 1 AS n, u, CAST(u AS BIT) AS total, inner_key, outer_key FROM (
    SELECT *, unhex(sha256(outer_key || unhex(sha256(inner_key || encode('test-salt') || unhex('00000001'))))) AS u
    FROM keys)
  UNION ALL
  SELECT id, n + 1, v, xor(total, CAST(v AS BIT)), inner_key, outer_key FROM (
    SELECT *, unhex(sha256(outer_key || unhex(sha256(inner_key || u)))) AS v FROM rounds WHERE n < 4))
SELECT id AS ParticipantID, lower(hex(CAST(total AS BLOB))) AS hashed_id FROM rounds WHERE n = 4
"""
ORACLES["anon_pseudonym"] = f"""
WITH {_mapping(ALL_IDS)} SELECT original_id AS ParticipantID, pseudonym FROM mapping
"""
ORACLES["anon_random_id"] = f"""
WITH {_mapping(ALL_IDS)} SELECT original_id AS ParticipantID, random_id FROM mapping
"""
ORACLES["anon_jitter"] = f"SELECT c_custkey AS ParticipantID, CAST({AGE} AS BIGINT) AS Age FROM customer"
ORACLES["anon_publish"] = f"""
WITH {_mapping(ALL_IDS)}
SELECT c_nationkey AS InstitutionID, CAST({AGE} AS INT) AS Age, pseudonym, hashed_id, random_id
FROM customer JOIN mapping ON c_custkey = original_id
"""
ORACLES["anon_release"] = ORACLES["anon_publish"]
ORACLES["anon_incremental"] = f"""
WITH {_mapping("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'")} SELECT * FROM mapping
"""

ORACLES["k_anonymity"] = """
SELECT c_mktsegment, c_nationkey, count(*) AS GroupSize FROM customer GROUP BY 1, 2 HAVING count(*) < 10
"""
ORACLES["k_anonymity_suppressed"] = """
SELECT c_custkey, c_mktsegment, c_nationkey FROM customer
QUALIFY count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) >= 10
"""


def _laplace(scale: str, label: str) -> str:
    draw = _draw(f"'|{label}|' || c_mktsegment")
    u = f"(({draw}::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE - 0.5::DOUBLE)"
    return f"(-{scale}::DOUBLE * sign({u}) * ln(1 - 2 * abs({u})))"


ORACLES["dp_counts"] = f"""
WITH g AS (
  SELECT c_mktsegment, count(*) AS n,
         sum(CAST(least(greatest(c_acctbal, 0), 5000) AS DECIMAL(15,2)))::DOUBLE AS s
  FROM customer GROUP BY 1)
SELECT c_mktsegment, round(n + {_laplace("2.0", "count")}, 4) AS NoisyCount,
       round(s + {_laplace("10000.0", "sum")}, 4) AS NoisySum
FROM g
"""

# --- streams: windows that the watermark has passed -----------------------------

MARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"

ORACLES["stream_violation_windows"] = f"""
SELECT user_id AS FreezerID, time_bucket(INTERVAL 1 HOUR, ts) AS WindowStart,
       time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS WindowEnd, max(value) AS MaxViolationTemp,
       min(ts) AS FirstViolation, max(ts) AS LastViolation, count(*) AS ViolationCount
FROM events WHERE value >= 150 GROUP BY 1, 2, 3 HAVING WindowEnd <= {MARK}
"""

ORACLES["stream_sliding_stats"] = f"""
WITH e AS (
  SELECT user_id, value, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS s
  FROM events, (SELECT unnest(range(6)) AS k))
SELECT user_id AS FreezerID, s AS WindowStart, s + INTERVAL 6 HOUR AS WindowEnd, count(*) AS Readings,
       round(avg(value), 6) AS MeanValue, round(stddev_samp(value), 6) AS Deviation
FROM e GROUP BY 1, 2, 3 HAVING s + INTERVAL 6 HOUR <= {MARK}
"""

ORACLES["stream_dedup"] = """
SELECT event_id AS LogID, user_id AS FreezerID, ts AS ReadingTime, value AS ReadingValue FROM events
"""

ORACLES["stream_enrich"] = """
SELECT event_id AS LogID, user_id AS FreezerID, s_name AS FreezerName, s_nationkey AS LocationID, value AS ReadingValue
FROM events LEFT JOIN supplier ON user_id = s_suppkey
"""


def _alarms(closed: str) -> str:
    return f"""
WITH w AS (
  SELECT user_id AS fid, time_bucket(INTERVAL 1 HOUR, ts) AS s, max(value) AS peak, min(value) >= 100 AS bad
  FROM events GROUP BY 1, 2),
r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY fid ORDER BY s) AS run
      FROM w WHERE {closed}),
p AS (SELECT fid, s, row_number() OVER (PARTITION BY fid, run ORDER BY s) AS pos,
             min(s) OVER (PARTITION BY fid, run ORDER BY s) AS first_s,
             max(peak) OVER (PARTITION BY fid, run ORDER BY s) AS top
      FROM r WHERE bad)
SELECT fid AS FreezerID, first_s AS FirstWindow, s AS AlarmWindow, top AS PeakValue FROM p WHERE pos = 3
"""


ORACLES["stream_alarm"] = _alarms(f"s + INTERVAL 1 HOUR <= {MARK}")
ORACLES["alarm_windows"] = _alarms("true")

ORACLES["alarm_runs"] = """
WITH m AS (SELECT user_id AS fid, ts, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2),
r AS (SELECT *, sum(CASE WHEN lo < 100 THEN 1 ELSE 0 END) OVER (PARTITION BY fid ORDER BY ts) AS run FROM m)
SELECT fid AS FreezerID, CAST(sum(n) AS BIGINT) AS Readings, min(ts) AS RunStart, max(ts) AS RunEnd, max(hi) AS PeakValue
FROM r WHERE lo >= 100 GROUP BY fid, run HAVING sum(n) >= 3
"""

ORACLES["stream_access_bursts"] = f"""
SELECT user_id AS UserID, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS WindowStart,
       time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS WindowEnd, count(*) AS Accesses
FROM events GROUP BY 1, 2, 3 HAVING count(*) > 2 AND WindowEnd <= {MARK}
"""

ORACLES["stream_access_sessions"] = f"""
WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 150 MINUTE
                          THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM s)
SELECT user_id AS UserID, min(ts) AS FirstAccess, max(ts) AS LastAccess, count(*) AS Accesses
FROM g GROUP BY user_id, sid HAVING max(ts) + INTERVAL 150 MINUTE <= {MARK}
"""

ORACLES["stream_alarm_readings"] = ORACLES["alarm_runs"]

ORACLES["stream_alarm_raised"] = """
WITH m AS (SELECT user_id AS fid, ts, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2),
r AS (SELECT *, sum(CASE WHEN lo < 100 THEN 1 ELSE 0 END) OVER (PARTITION BY fid ORDER BY ts) AS run FROM m),
p AS (SELECT fid, ts, n, sum(n) OVER w AS so_far, min(ts) OVER w AS first, max(hi) OVER w AS peak
      FROM r WHERE lo >= 100 WINDOW w AS (PARTITION BY fid, run ORDER BY ts))
SELECT fid AS FreezerID, first AS RunStart, ts AS RaisedAt, peak AS PeakValue FROM p
WHERE so_far >= 3 AND so_far - n < 3
"""

BATCH = "greatest(0, least(4, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 6))"

ORACLES["stream_late"] = f"""
WITH once AS (SELECT event_id AS id, ts, {BATCH} AS b FROM events),
sent AS (
  SELECT id, ts, b + CASE WHEN id % 100 = 77 THEN 2 WHEN id % 10 = 7 THEN 1 ELSE 0 END AS b FROM once
  UNION ALL
  SELECT id, ts, b + CASE WHEN id % 10 = 3 THEN 1 ELSE 0 END FROM once WHERE id % 10 IN (3, 5)),
latest AS (SELECT n, (SELECT max(ts) FROM sent WHERE b < n) - INTERVAL 10 MINUTE AS mark FROM range(7) t(n)),
marked AS (SELECT id, coalesce(ts <= mark, false) AS late FROM sent JOIN latest ON b = n),
per AS (SELECT id, count(*) AS d, count(*) FILTER (late) AS l FROM marked GROUP BY 1)
SELECT id AS LogID, d AS Delivered, CASE WHEN d > l THEN 1 ELSE 0 END::BIGINT AS Kept,
       greatest(d - l - 1, 0) AS Duplicates, l AS Late
FROM per
"""

ORACLES["stream_enrich_changes"] = """
WITH c AS (SELECT user_id, ts, event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'signup')
SELECT e.user_id AS FreezerID, e.ts AS ReadingTime, e.event_id AS LogID, e.value AS ReadingValue,
       c.ts AS ValidFrom, c.event_id AS ChangeID, c.k AS Setting
FROM events e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts
WHERE e.event_type <> 'signup'
"""

ORACLES["stream_audit_summary"] = f"""
SELECT user_id AS UserID, event_type AS Action, date_trunc('day', ts) AS WindowStart, count(*) AS Accesses
FROM events GROUP BY 1, 2, 3 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {MARK}
"""

# --- analytics -----------------------------------------------------------------

ORACLES["publication_impact"] = """
WITH s AS (SELECT l_suppkey AS id, count(*) AS n, avg(CAST(l_quantity AS INT)) AS m, max(CAST(l_quantity AS INT)) AS best
           FROM lineitem GROUP BY 1)
SELECT id AS InstitutionID, n AS Publications, m AS MeanScore, best AS BestScore, rank() OVER (ORDER BY best DESC) AS ImpactRank
FROM s
"""

ORACLES["adverse_event_histogram"] = """
SELECT o_custkey AS InstitutionID,
       count(*) FILTER (l_linenumber = 1) AS Grade1, count(*) FILTER (l_linenumber = 2) AS Grade2,
       count(*) FILTER (l_linenumber = 3) AS Grade3, count(*) FILTER (l_linenumber = 4) AS Grade4,
       count(*) FILTER (l_linenumber = 5) AS Grade5, count(*) AS Events,
       count(*) FILTER (l_linenumber >= 3)::DOUBLE / count(*)::DOUBLE AS SevereShare
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
"""

ORACLES["funding_efficiency"] = """
WITH g AS (
  SELECT o_custkey AS id, sum(CAST(o_totalprice AS DECIMAL(15,2))) AS f,
         count(*) FILTER (o_orderstatus = 'F') AS pub, count(*) FILTER (o_orderpriority = '1-URGENT') AS pat,
         count(*) AS prj,
         coalesce(sum(CAST(o_totalprice AS DECIMAL(15,2))) FILTER (o_orderpriority = '1-URGENT'), 0) AS rev
  FROM orders GROUP BY 1)
SELECT id AS InstitutionID, f AS Funding, pub AS Publications, pat AS Patents, prj AS Projects,
       CAST(rev AS DECIMAL(38,2)) AS Revenue,
       pub::DOUBLE * 1000000.0::DOUBLE / f::DOUBLE AS PublicationsPerMillion,
       pat::DOUBLE * 1000000.0::DOUBLE / f::DOUBLE AS PatentsPerMillion,
       prj::DOUBLE * 1000000.0::DOUBLE / f::DOUBLE AS ProjectsPerMillion,
       rev::DOUBLE / f::DOUBLE AS RevenueRatio
FROM g
"""

ORACLES["coi_match"] = """
SELECT c_custkey AS ResearcherID, split_part(s_name, '#', 2) AS Company, count(*) AS Companies,
       min(s_suppkey) AS FirstInstitutionID
FROM customer JOIN supplier ON split_part(c_name, '#', 2) = split_part(s_name, '#', 2) GROUP BY 1, 2
"""

ORACLES["coi_match_names"] = """
WITH c AS (SELECT p_name, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1)
SELECT p_partkey AS ResearcherID, 'sa ' || lower(p_name) AS Company, n AS Companies, first AS FirstInstitutionID
FROM part JOIN c USING (p_name) WHERE p_size % 2 = 0
"""

ORACLES["trial_features"] = f"""
WITH {REGULATORY}, {SEVERITY},
f AS (SELECT id, count(*) AS Filings, max(phase) AS HighestPhase, count(export) AS RestrictedFilings,
             max(approved) FILTER (approved <= DATE '2001-08-01') AS approved FROM reg GROUP BY 1),
m AS (SELECT o_custkey AS id, count(*) AS Grants, sum(CAST(o_totalprice AS DECIMAL(15,2))) AS Funding FROM orders GROUP BY 1),
w AS (SELECT o_custkey AS id, count(*) FILTER (l_returnflag = 'R') AS Withdrawals
      FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT o_orderkey AS ProtocolID, o_custkey AS InstitutionID, CAST(100 AS INT) AS PlannedDays,
       CAST(date_diff('day', CAST(o_orderdate AS DATE) - 100, DATE '2001-08-01') AS INT) AS ElapsedDays,
       CAST(date_diff('day', approved, DATE '2001-08-01') AS INT) AS DaysSinceApproval,
       Filings, CAST(HighestPhase AS BIGINT) AS HighestPhase, RestrictedFilings, Grants, Funding,
       coalesce(sev.n, 0) AS SeverityCount, coalesce(sev.s::DOUBLE / sev.n::DOUBLE, 0.0::DOUBLE) AS MeanSeverity,
       Grants AS Participants, Withdrawals, Grants AS LeadProjects
FROM orders LEFT JOIN f ON f.id = o_custkey LEFT JOIN m ON m.id = o_custkey LEFT JOIN sev ON sev.id = o_custkey
LEFT JOIN w ON w.id = o_custkey
"""

ORACLES["trial_features_known"] = f"""
WITH {REGULATORY},
t AS (SELECT o_orderkey AS id, o_custkey AS site, CAST(o_orderdate AS DATE) - 100 AS d FROM orders),
days AS (SELECT DISTINCT site, d FROM t),
f AS (SELECT site, d, count(reg.id) AS n, max(phase) AS phase, count(export) AS export, max(approved) AS approved
      FROM days LEFT JOIN reg ON reg.id = site AND approved <= d GROUP BY 1, 2),
m AS (SELECT site, d, count(o_orderkey) AS n, coalesce(sum(CAST(o_totalprice AS DECIMAL(15,2))), 0) AS total
      FROM days LEFT JOIN orders ON o_custkey = site AND CAST(o_orderdate AS DATE) <= d AND o_orderstatus <> 'P'
      GROUP BY 1, 2),
e AS (SELECT o_custkey AS site, CAST(l_shipdate AS DATE) AS d, CASE WHEN l_linenumber < 5 THEN l_linenumber END AS g,
             l_returnflag = 'R' AS gone
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT days.site, days.d, count(g) AS n, sum(g) AS total, count(*) FILTER (gone) AS gone
      FROM days LEFT JOIN e ON e.site = days.site AND e.d <= days.d GROUP BY 1, 2),
l AS (SELECT days.site, days.d, count(*) AS n FROM days JOIN t ON t.site = days.site AND t.d <= days.d GROUP BY 1, 2)
SELECT t.id AS ProtocolID, t.site AS InstitutionID, t.d AS KnownAt, CAST(100 AS INT) AS PlannedDays,
       CAST(date_diff('day', f.approved, t.d) AS INT) AS DaysSinceApproval, f.n AS Filings, f.phase AS HighestPhase,
       f.export AS RestrictedFilings, m.n AS Grants, CAST(m.total AS DECIMAL(38,2)) AS Funding, s.n AS SeverityCount,
       CASE WHEN s.n > 0 THEN s.total::DOUBLE / s.n::DOUBLE END AS MeanSeverity, s.gone AS Withdrawals, l.n AS LeadProjects
FROM t JOIN f USING (site, d) JOIN m USING (site, d) JOIN s USING (site, d) JOIN l USING (site, d)
"""

# --- positions and sources -------------------------------------------------------


def _positions(report: str, order: str) -> str:
    """A report with the place of its rows in an order; `order` may use the report's columns."""
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS Position FROM ({report})"


ORACLES["q1_positions"] = f"""
WITH numbered AS ({_positions(
    ORACLES["q1_institution_report"].replace("SELECT LegalName, total", "SELECT id, LegalName, total"),
    "TotalFundingReceived DESC, id",
)})
SELECT * EXCLUDE (id) FROM numbered
"""
ORACLES["q2_positions"] = _positions(
    ORACLES["q2_workload"], "ActiveProjectCount DESC, TotalFTE DESC, ResearcherID"
)
ORACLES["q3_positions"] = _positions(
    ORACLES["q3_irb_compliance"],
    """CASE RenewalStatus WHEN 'PAST DUE' THEN 0 WHEN 'DUE WITHIN 30 DAYS' THEN 1 ELSE 2 END,
    IRBRenewalDate NULLS FIRST, ProtocolID""",
)

ORACLES["q2_distinct_employers"] = f"""
WITH {POSTS}
SELECT person AS ResearcherID, count(DISTINCT inst) AS Institutions, count(DISTINCT dept) AS Departments, count(*) AS Posts
FROM posts WHERE e IS NULL GROUP BY 1
"""

ORACLES["q4_chain_of_custody_by_location"] = f"""
WITH {ROLLUP}, {RESEARCHER},
unit AS (
  SELECT s_suppkey AS FreezerID, s_name AS FreezerName, n_name AS Location, {ROLL_COLUMNS}
  FROM supplier LEFT JOIN roll ON s_suppkey = fid JOIN nation ON s_nationkey = n_nationkey
  WHERE s_nationkey IN (SELECT s_nationkey FROM supplier JOIN roll ON s_suppkey = fid))
SELECT FreezerID, FreezerName, Location, {ROLL_COLUMNS}, l_orderkey AS ProtocolID, l_linenumber, l_partkey,
       CAST(l_quantity AS INT) AS AliquotCounts, l_partkey AS InstitutionID,
       'Trial ' || o_orderkey AS ProjectTitle, o_custkey AS PrincipalInvestigatorID,
       full_name AS PrincipalInvestigator, email AS PI_Contact
FROM lineitem JOIN unit ON l_suppkey = FreezerID
LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN people ON o_custkey = id
"""

ORACLES["numbered_rows"] = """
SELECT l_returnflag, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
       row_number() OVER (ORDER BY l_returnflag DESC, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id
FROM lineitem
"""
ORACLES["literal_load"] = """
SELECT CAST(LocationID AS INT) AS LocationID, Address, CAST(BSLLabLevel AS INT) AS BSLLabLevel, r_name
FROM (VALUES (1, 'Lab A', 1), (2, 'Lab B', 2), (3, 'Lab C', 3), (4, 'Lab D', 4), (5, 'Lab E', 2))
     AS v(LocationID, Address, BSLLabLevel)
JOIN region ON r_regionkey + 1 = LocationID
"""
ORACLES["required_tables"] = """
SELECT 'customer' AS table_name, count(*) AS n_rows FROM customer UNION ALL SELECT 'nation', count(*) FROM nation
UNION ALL SELECT 'participant', NULL UNION ALL SELECT 'trial', NULL
"""
ORACLES["empty_guard"] = "SELECT n_nationkey, n_name FROM nation"
ORACLES["catalog_load"] = """
SELECT CAST(event_id AS INT) AS LogID, CAST(user_id AS INT) AS FreezerID, CAST(event_id % 90 AS DECIMAL(5,2)) AS ReadingValue,
       TIMESTAMP '2024-01-31 00:00:00' AS ReadingTime, event_type AS SensorID, false AS IsManualEntry
FROM events
"""

# --- privacy ---------------------------------------------------------------------


def _long(text: str) -> str:
    """The number below 2**60 that a keyed hash of ``text`` draws."""
    return f"CAST('0x' || substr(sha256('test-salt' || {text}), 1, 15) AS BIGINT)"


def _geometric(side: str, scale: str, text: str) -> str:
    draw = _long(f"'{side}' || {text}")
    return f"CAST(floor(-ln(({draw}::DOUBLE + 0.5::DOUBLE) / 1152921504606846976::DOUBLE) * {scale}::DOUBLE) AS BIGINT)"


def _discrete(label: str, scale: str) -> str:
    text = f"'{label}' || 'orders' || '|' || o_orderpriority || '|' || yr"
    return f"{_geometric('first', scale, text)} - {_geometric('second', scale, text)}"


# Two epsilon, three groups and two rows: counts have scale 6, sums 600,000; the
# threshold is 2 + 6 ln(1 / (2 * 1e-6 / 3)), rounded up.
ORACLES["dp_release"] = f"""
WITH o AS (SELECT *, CAST(year(o_orderdate) AS VARCHAR) AS yr FROM orders),
h AS (SELECT *, {_long("'row' || '|' || o_custkey || '|' || o_orderpriority || '|' || yr || '|' || o_orderkey")} AS hr,
             {_long("'group' || '|' || o_custkey || '|' || o_orderpriority || '|' || yr")} AS hg FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, yr ORDER BY hr, o_orderkey) AS a,
             dense_rank() OVER (PARTITION BY o_custkey ORDER BY hg, o_orderpriority, yr) AS b FROM h),
g AS (SELECT o_orderpriority, yr, count(*) AS n,
             CAST(sum(least(greatest(CAST(trunc(o_totalprice) AS BIGINT), 0), 100000)) AS BIGINT) AS s
      FROM n WHERE a <= 2 AND b <= 3 GROUP BY 1, 2),
noisy AS (SELECT o_orderpriority, CAST(yr AS INT) AS year, n + {_discrete("count", "6.0")} AS NoisyCount,
                 s + {_discrete("sum", "600000.0")} AS NoisySum FROM g)
SELECT * FROM noisy WHERE NoisyCount >= 88
"""


def _generalised(levels: int, k: int) -> str:
    """Parts of customers, cut level by level; columns take turns."""
    dims = ["nation", "balance", "segment"]
    out = [
        """p0 AS (
  SELECT c_custkey, c_nationkey, CAST(floor(c_acctbal) AS INT) AS b, c_mktsegment, CAST(c_nationkey AS BIGINT) AS nation,
         CAST(floor(c_acctbal) AS BIGINT) AS balance, dense_rank() OVER (ORDER BY c_mktsegment) AS segment,
         1::HUGEINT AS part FROM customer)"""
    ]
    for level in range(levels):
        order = [dims[(level + i) % 3] for i in range(3)]
        tall = " UNION ALL ".join(f"SELECT part, {i} AS r, {d} AS code FROM p{level}" for i, d in enumerate(order))
        pick = " ".join(f"WHEN r = {i} THEN {d}" for i, d in enumerate(order))
        out.append(f"""s{level} AS (
  SELECT part, r, min(code) AS low, max(code) - min(code) + 1 AS width, count(*) AS total FROM ({tall})
  GROUP BY 1, 2 HAVING max(code) > min(code) AND count(*) >= {2 * k}),
h{level} AS (
  SELECT part, r, low, width, total, ((code - low) * 256) // width AS bin, count(*) AS n
  FROM ({tall}) JOIN s{level} USING (part, r) GROUP BY ALL),
e{level} AS (SELECT *, sum(n) OVER (PARTITION BY part, r ORDER BY bin) AS below FROM h{level}),
c{level} AS (
  SELECT part, r, low, width, bin AS edge FROM e{level} WHERE below >= {k} AND total - below >= {k}
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY r, 2 * below > total, abs(2 * below - total), bin) = 1),
p{level + 1} AS (
  SELECT p{level}.* EXCLUDE (part),
         CASE WHEN r IS NULL THEN part
              ELSE part * 2 + CASE WHEN ((CASE {pick} END - low) * 256) // width > edge THEN 1 ELSE 0 END END AS part
  FROM p{level} LEFT JOIN c{level} USING (part))""")
    span = "CASE WHEN min({0}) = max({0}) THEN CAST(min({0}) AS VARCHAR) ELSE min({0}) || '..' || max({0}) END AS {1}"
    return f"""
WITH {", ".join(out)},
g AS (SELECT part, count(*) AS GroupSize, {span.format("c_nationkey", "c_nationkey")},
             {span.format("b", "balance")}, {span.format("c_mktsegment", "c_mktsegment")}
      FROM p{levels} GROUP BY part)
SELECT c_custkey, g.c_nationkey, g.balance, g.c_mktsegment, GroupSize FROM p{levels} JOIN g USING (part)
"""


ORACLES["k_anonymity_generalised"] = _generalised(14, 10)
