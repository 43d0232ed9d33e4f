"""Loading a batch with its declared rules: good rows in, bad rows apart or none at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labmesh.functions import asof, text
from labmesh.operators.lookup import lookup_join
from labmesh.plans.quality import row_tests
from labmesh.sources.keyindex import KeyIndex
from labmesh.sources.schemas import Table

BROKEN = "BrokenRules"
REJECTED = "Rejected"


class Rejected(ValueError):
    """A batch that was not loaded; names the rules and how many rows break each."""


def _with_flag(rows: DataFrame, keys: DataFrame, columns: list[str], flag: str, spread_by: list[str]) -> DataFrame:
    """The rows with a flag that is true where their key is in a table of distinct keys."""
    marked = keys.select(*columns, F.lit(True).alias(flag))
    return lookup_join(rows, marked, columns, spread_by, how="left", null_safe=True)


def mark_broken(
    batch: DataFrame,
    table: Table,
    as_of: asof.AsOf,
    parents: dict[str, DataFrame | KeyIndex],
    earlier: KeyIndex | None = None,
) -> DataFrame:
    """The batch with ``BrokenRules``: every rule that a row breaks, by name.

    Row rules are tested in one pass. All rows of a key that the batch has twice, or
    that ``earlier`` has, break `primary_key`; texts compare folded, and NULLs as
    equal. ``parents`` maps column names to the table of keys, or their index, that the
    column refers to; a NULL reference breaks nothing here.
    """
    spread = [c for c in batch.columns if c != table.key] or [table.key]
    rules = [F.when(test, F.lit(rule)) for rule, (test, _) in row_tests(table, as_of).items()]
    rows, flags = batch, []
    texts = {f.name for f in table.columns if isinstance(f.dataType, T.StringType)}

    def folded(column: str) -> Column:
        return text.folded(F.col(column)) if column in texts else F.col(column)

    unique = [(table.key,), *[u for u in table.unique if u != (table.key,)]]
    for number, columns in enumerate(unique):
        names = [f"__u{number}_{k}" for k in range(len(columns))]
        rows = rows.withColumns({n: folded(c) for n, c in zip(names, columns)})
        twice = rows.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1")
        rows = _with_flag(rows, twice, names, f"__twice{number}", spread)
        rule = "primary_key" if number == 0 else "unique_" + "_".join(columns)
        flags.append((rule, F.col(f"__twice{number}")))
    if earlier is not None:
        rows = _with_flag(rows, earlier.held(batch, table.key), [table.key], "__earlier", spread)
        flags[0] = ("primary_key", flags[0][1] | F.col("__earlier"))
    for number, (column, parent) in enumerate(parents.items()):
        if isinstance(parent, KeyIndex):
            known = parent.held(batch, column)
        else:
            known = parent.select(F.col(parent.columns[0]).alias(column)).distinct()
        rows = _with_flag(rows, known, [column], f"__known{number}", spread)
        lost = F.col(column).isNotNull() & F.col(f"__known{number}").isNull()
        rules.append(F.when(lost, F.lit(f"{column}_parent")))
    rules += [F.when(F.coalesce(test, F.lit(False)), F.lit(rule)) for rule, test in flags]
    broken = F.array_sort(F.filter(F.array(*rules), lambda r: r.isNotNull()))
    return rows.withColumn(BROKEN, broken).select(*[F.col(f"`{c}`") for c in batch.columns], BROKEN)


def load_batch(
    batch: DataFrame,
    table: Table,
    path: str,
    as_of: asof.AsOf,
    parents: dict[str, DataFrame | KeyIndex],
    earlier: KeyIndex | None = None,
    mode: str = "quarantine",
) -> tuple[DataFrame, DataFrame]:
    """Writes a batch in one pass, good and bad rows into folders of their own; returns both.

    ``mode="fail"`` raises `Rejected` if any row is bad; what was written then is below
    ``path`` for inspection and belongs to no table. Rows in are good plus bad ones.
    """
    if mode not in ("quarantine", "fail"):
        raise ValueError("mode is quarantine or fail")
    marked = mark_broken(batch, table, as_of, parents, earlier)
    marked = marked.withColumn(REJECTED, F.size(BROKEN) > 0)
    marked.write.mode("overwrite").partitionBy(REJECTED).parquet(path)
    written = batch.sparkSession.read.schema(marked.schema).parquet(path)
    bad = written.where(F.col(REJECTED)).drop(REJECTED)
    good = written.where(~F.col(REJECTED)).drop(REJECTED, BROKEN)
    if mode == "fail":
        # One line per rule of the table.
        found = bad.select(F.explode(BROKEN).alias("rule")).groupBy("rule").count().orderBy("rule").collect()
        if found:
            raise Rejected("; ".join(f"{table.name}.{r['rule']}: {r['count']}" for r in found))
    return good, bad
