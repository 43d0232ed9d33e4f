"""Declared constraints as jobs that return violations.

Every job returns ``table_name, rule_id, row_key, detail, n_rows``.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labmesh.functions import asof, text
from labmesh.operators.lookup import lookup_join
from labmesh.sources.keyindex import KeyIndex
from labmesh.sources.schemas import TABLES, Table


def _key_text(keys: list[str]) -> Column:
    """The key of a row as text, with NULL spelled out."""
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])


def _report(df: DataFrame, table: str, rule: Column, keys: list[str], detail: Column, rows: Column) -> DataFrame:
    return df.select(
        F.lit(table).alias("table_name"),
        rule.alias("rule_id"),
        _key_text(keys).alias("row_key"),
        detail.cast("string").alias("detail"),
        rows.cast("bigint").alias("n_rows"),
    )


def duplicate_keys(df: DataFrame, table: str, keys: list[str], rule: str = "unique") -> DataFrame:
    """Key values held by several rows.

    NULLs count as equal, and so do texts that differ in case only.
    """
    texts = [k for k in keys if isinstance(df.schema[k].dataType, T.StringType)]
    df = df.select(*[text.folded(F.col(k)).alias(k) if k in texts else F.col(k) for k in keys])
    groups = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return _report(groups, table, F.lit(rule), keys, F.lit("duplicate"), F.col("n"))


def orphans(
    child: DataFrame, table: str, column: str, parent: DataFrame, parent_key: str, rule: str | None = None
) -> DataFrame:
    """Referenced values without a parent row, with the number of rows.

    Child rows shrink to one row per value before the shuffle.
    """
    values = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    known = parent.select(F.col(parent_key).alias(column))
    lost = values.join(known, column, "left_anti")
    return _report(lost, table, F.lit(rule or f"{column}_parent"), [column], F.lit("no parent"), F.col("n"))


def _explode_rules(df: DataFrame, table: str, keys: list[str], broken: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per rule a row breaks, from a single pass over the table."""
    hits = F.array(
        *[
            F.when(test, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))
            for rule, (test, detail) in broken.items()
        ]
    )
    found = df.withColumn("__hit", F.explode(F.filter(hits, lambda h: h.isNotNull())))
    return _report(found, table, F.col("__hit.rule"), keys, F.col("__hit.detail"), F.lit(1))


def _check_tests(rules: dict[str, str], as_of: asof.AsOf | None) -> dict[str, tuple[Column, Column]]:
    now = "current_timestamp()" if as_of is None else asof.sql_literal(as_of)
    bodies = {rule: body.replace("{as_of}", now) for rule, body in rules.items()}
    return {rule: (~F.expr(body), F.lit(body)) for rule, body in bodies.items()}


def _null_tests(columns: list[str]) -> dict[str, tuple[Column, Column]]:
    return {f"{c}_required": (F.col(c).isNull(), F.lit("NULL")) for c in columns}


def _length_tests(limits: dict[str, int]) -> dict[str, tuple[Column, Column]]:
    return {f"{c}_length": (F.length(c) > n, F.length(c)) for c, n in limits.items()}


def broken_checks(
    df: DataFrame, table: str, keys: list[str], rules: dict[str, str], as_of: asof.AsOf | None = None
) -> DataFrame:
    """Rows for which a rule is false. An unknown outcome passes."""
    return _explode_rules(df, table, keys, _check_tests(rules, as_of))


def missing_values(df: DataFrame, table: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with NULL in a required column."""
    return _explode_rules(df, table, keys, _null_tests(columns))


def overlong_text(df: DataFrame, table: str, keys: list[str], limits: dict[str, int]) -> DataFrame:
    """Rows whose text exceeds its declared length."""
    return _explode_rules(df, table, keys, _length_tests(limits))


def cascade_delete(
    child: DataFrame, column: str, deleted: DataFrame, deleted_key: str, spread_by: list[str]
) -> DataFrame:
    """Child rows that survive the deletion of their parents."""
    gone = deleted.select(F.col(deleted_key).alias(column)).distinct()
    return lookup_join(child, gone, column, spread_by, how="left_anti")


def cascade(tables: dict[str, DataFrame], parent: str, deleted: DataFrame) -> dict[str, DataFrame]:
    """The parent table and those that the registry deletes along, without the deleted rows.

    ``deleted`` holds keys of the parent in the column of its key.
    """
    key = TABLES[parent].key
    out = {parent: cascade_delete(tables[parent], key, deleted, key, [key])}
    for name, table in TABLES.items():
        if table.cascade_from == parent and name in tables:
            column = next(c for c, target in table.references.items() if target == parent)
            out[name] = cascade_delete(tables[name], column, deleted, key, [table.key])
    return out


def row_tests(table: Table, as_of: asof.AsOf) -> dict[str, tuple[Column, Column]]:
    """Per rule that a row alone can break: whether it does, and the detail to report."""
    required = [f.name for f in table.columns if not f.nullable]
    limits = {f.name: f.metadata["limit"] for f in table.columns if "limit" in f.metadata}
    return _null_tests(required) | _length_tests(limits) | _check_tests(table.rules(), as_of)


def check_table(df: DataFrame, table: Table, as_of: asof.AsOf) -> list[DataFrame]:
    """All checks of one table that need no other table.

    Every row rule is tested in the same pass.
    """
    key, tests = [table.key], row_tests(table, as_of)
    out = [duplicate_keys(df, table.name, key, "primary_key"), _explode_rules(df, table.name, key, tests)]
    # A unique constraint on the primary key repeats the first check.
    out += [duplicate_keys(df, table.name, list(u), "unique_" + "_".join(u)) for u in table.unique if list(u) != key]
    return out


class Entry(NamedTuple):
    """What a line of the registry check is about; lines carry its number."""

    table_name: str
    kind: str
    rule_id: str
    target: str


def _entries(df: DataFrame, table: Table, as_of: asof.AsOf, given: set[str], known: list[Entry]) -> DataFrame:
    """What one scan of a table has to say: rules that rows break, keys, and referenced values.

    The entries are added to those that are ``known``; rows name them by number.
    """
    tests = row_tests(table, as_of)
    texts = {f.name for f in table.columns if isinstance(f.dataType, T.StringType)}

    def entry(kind: str, rule: str, target: str, value: Column, detail: Column) -> Column:
        known.append(Entry(table.name, kind, rule, target))
        return F.struct(
            F.lit(len(known) - 1).alias("entry"), value.alias("row_key"), detail.cast("string").alias("detail")
        )

    def key(columns: tuple[str, ...]) -> Column:
        cells = [text.folded(F.col(c)) if c in texts else F.col(c) for c in columns]
        return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("NULL")) for c in cells])

    own = F.col("__own")
    found = [F.when(test, entry(ROW, rule, table.name, own, detail)) for rule, (test, detail) in tests.items()]
    found.append(entry(KEY, "primary_key", table.name, own, F.lit("duplicate")))
    # A unique constraint on the primary key repeats that check.
    for columns in table.unique:
        if columns != (table.key,):
            found.append(entry(KEY, "unique_" + "_".join(columns), table.name, key(columns), F.lit("duplicate")))
    for column, parent in table.references.items():
        if parent in given:
            value = F.col(column).cast("string")
            found.append(F.when(value.isNotNull(), entry(REFERENCE, f"{column}_parent", parent, value, F.lit("no parent"))))
    rows = df.withColumn("__own", key((table.key,))).select(F.explode(F.array(*found)).alias("e"))
    return rows.where(F.col("e").isNotNull()).select("e.*")


def check_append(
    batch: DataFrame, table: Table, earlier: KeyIndex, parents: dict[str, KeyIndex]
) -> DataFrame:
    """Keys and references that a batch would break if it were appended.

    Keys must be new to the table and single in the batch, references must have a
    parent, which may come in the same batch if the table refers to itself. Neither the
    table nor its parents are read, only their indexes, and of these the filters and
    the buckets that may hold a key of the batch.
    """
    counted = batch.where(F.col(table.key).isNotNull()).groupBy(table.key).agg(F.count("*").alias("n"))
    twice = counted.where(F.col("n") > 1)
    out = [_report(twice, table.name, F.lit("primary_key"), [table.key], F.lit("duplicate"), F.col("n"))]
    held = counted.join(earlier.held(batch, table.key), table.key, "left_semi")
    out.append(_report(held, table.name, F.lit("primary_key"), [table.key], F.lit("known"), F.col("n")))
    for column, index in parents.items():
        named = batch.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        lost = named.join(index.held(batch, column), column, "left_anti")
        if table.references.get(column) == table.name:
            lost = lost.join(batch.select(F.col(table.key).alias(column)), column, "left_anti")
        out.append(_report(lost, table.name, F.lit(f"{column}_parent"), [column], F.lit("no parent"), F.col("n")))
    return reduce(DataFrame.unionByName, out)


ROW, KEY, REFERENCE = "row", "key", "reference"


def check_all(tables: dict[str, DataFrame], as_of: asof.AsOf) -> DataFrame:
    """Violations of every rule of the given tables, from one scan of each.

    A line states how many rows of one key break a rule, hold a key that must be
    unique, or name a parent that is not there. Referenced values meet the keys of
    their parents by (table, value), where a value has at most one line per referring
    column. References to a table that is not given are not checked.
    """
    known: list[Entry] = []
    parts = [_entries(df, TABLES[name], as_of, set(tables), known) for name, df in tables.items()]

    def held(field: str) -> Column:
        return F.element_at(F.array(*[F.lit(getattr(e, field)) for e in known]), F.col("entry") + 1)

    # All tables count in one aggregation; equal lines count together before they shuffle.
    counted = reduce(DataFrame.unionByName, parts).groupBy("entry", "row_key", "detail").agg(F.count("*").alias("n_rows"))
    # A key that is there once is good, and only keys that others may refer to are looked up.
    sought = {e.target for e in known if e.kind == REFERENCE}
    idle = [n for n, e in enumerate(known) if e.kind == KEY and not (e.rule_id == "primary_key" and e.target in sought)]
    named = counted.where(~(F.col("entry").isin(idle) & (F.col("n_rows") == 1))).withColumns(
        {field: held(field) for field in Entry._fields}
    )
    is_key = (F.col("kind") == KEY) & (F.col("rule_id") == "primary_key")
    there = F.max(is_key.cast("int")).over(Window.partitionBy("target", "row_key"))
    broken = (
        (F.col("kind") == ROW)
        | ((F.col("kind") == KEY) & (F.col("n_rows") > 1))
        | ((F.col("kind") == REFERENCE) & (F.col("there") == 0))
    )
    return named.withColumn("there", there).where(broken).select("table_name", "rule_id", "row_key", "detail", "n_rows")


def require_none(violations: DataFrame) -> None:
    """Raise an error that names the broken rules and how many rows break each."""
    totals = violations.groupBy("table_name", "rule_id").agg(F.sum("n_rows").alias("n"))
    # One row per rule of the registry, so the list is short.
    found = totals.orderBy("table_name", "rule_id").collect()
    if found:
        raise ValueError("; ".join(f"{r.table_name}.{r.rule_id}: {r.n}" for r in found))


def valid_rows(df: DataFrame, rules: dict[str, str], as_of: asof.AsOf | None = None) -> DataFrame:
    """Rows that break none of the row rules."""
    now = "current_timestamp()" if as_of is None else asof.sql_literal(as_of)
    tests = [F.coalesce(F.expr(body.replace("{as_of}", now)), F.lit(True)) for body in rules.values()]
    return df.where(reduce(Column.__and__, tests))


# --- rules of the entity model -------------------------------------------------


def institution_wide(
    institution: DataFrame, academic: DataFrame, corporate: DataFrame, government: DataFrame
) -> DataFrame:
    """One row per institution with the attributes of its subtype."""
    return (
        institution.join(academic, "InstitutionID", "left")
        .join(corporate, "InstitutionID", "left")
        .join(government, "InstitutionID", "left")
    )


def subtype_violations(
    institution: DataFrame, academic: DataFrame, corporate: DataFrame, government: DataFrame
) -> DataFrame:
    """Institutions without exactly the one subtype their type names.

    The four key sets meet in one aggregation.
    """
    def tagged(df: DataFrame, tag: str) -> DataFrame:
        return df.select("InstitutionID", F.lit(tag).alias("tag"), F.lit(None).cast("string").alias("Type"))

    parents = institution.select("InstitutionID", F.lit("Parent").alias("tag"), "Type")
    parts = [tagged(academic, "Academic"), tagged(corporate, "Corporate"), tagged(government, "Government")]
    merged = reduce(DataFrame.unionByName, [parents, *parts])

    def held(tag: str) -> Column:
        return F.max(F.when(F.col("tag") == tag, 1).otherwise(0))

    groups = merged.groupBy("InstitutionID").agg(
        F.max("Type").alias("Type"),
        held("Parent").alias("p"),
        held("Academic").alias("a"),
        held("Corporate").alias("c"),
        held("Government").alias("g"),
    )
    n = F.col("a") + F.col("c") + F.col("g")
    only = F.when(F.col("a") == 1, "Academic").when(F.col("c") == 1, "Corporate").otherwise("Government")
    rule = (
        F.when(F.col("p") == 0, "subtype_without_parent")
        .when(n == 0, "subtype_missing")
        .when(n > 1, "subtypes_overlap")
        .when(~F.col("Type").eqNullSafe(only), "subtype_disagrees")
    )
    held_text = F.concat_ws(
        ",",
        F.when(F.col("a") == 1, F.lit("Academic")),
        F.when(F.col("c") == 1, F.lit("Corporate")),
        F.when(F.col("g") == 1, F.lit("Government")),
    )
    broken = groups.withColumn("rule", rule).where(F.col("rule").isNotNull())
    return _report(broken, "Institution", F.col("rule"), ["InstitutionID"], held_text, F.lit(1))


def containment_violations(freezer: DataFrame, location: DataFrame) -> DataFrame:
    """Freezers that need a higher containment level than their location has."""
    labs = location.select("LocationID", "BSLLabLevel")
    units = freezer.select("FreezerID", "LocationID", "BSLLevel")
    joined = lookup_join(units, labs, "LocationID", spread_by=["FreezerID"])
    return joined.where(F.col("BSLLevel") > F.col("BSLLabLevel")).select(
        "FreezerID", "LocationID", "BSLLevel", "BSLLabLevel"
    )
