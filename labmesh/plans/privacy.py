"""Releases with a stated privacy loss, and tables in which nobody stands alone.

Noise and choices are drawn from keyed hashes: a repeated release carries the same
noise, and averaging repeats does not remove it. The key must stay secret.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labmesh.functions import keyed
from labmesh.operators.lookup import lookup_join
from labmesh.operators.ordering import number_rows
from labmesh.sources.scratch import fresh_folder

# --- differential privacy -----------------------------------------------------------


class BudgetSpent(ValueError):
    """A release that would spend more than the budget."""


LEDGER = "release string, epsilon double, delta double"


def spend(spark: SparkSession, ledger: str, release: str, epsilon: float, delta: float, budget: float) -> None:
    """Enters a release into the stored ledger, or refuses it.

    A release that is in the ledger with the same loss costs nothing again, since it
    carries the same noise. The entry is written before the sum is read, so that two
    releases at once can both be refused but never both pass; a refused one is taken
    back by an entry of opposite sign.
    """
    if not epsilon > 0 or delta < 0:
        raise ValueError("epsilon must be positive and delta not negative")
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)

    def entered() -> dict[str, tuple[float, float]]:
        """Loss by release; refused ones cancel out."""
        rows = spark.read.schema(LEDGER).parquet(ledger).groupBy("release")
        # One line per release of the budget's owner.
        sums = rows.agg(F.sum("epsilon").alias("epsilon"), F.sum("delta").alias("delta")).collect()
        return {r["release"]: (r["epsilon"], r["delta"]) for r in sums if r["epsilon"] > 1e-12}

    def enter(sign: int) -> None:
        entry = [(release, sign * epsilon, sign * delta)]
        spark.createDataFrame(entry, LEDGER).coalesce(1).write.mode("append").parquet(ledger)

    known = entered().get(release)
    if known is not None:
        if abs(known[0] - epsilon) > 1e-9 or abs(known[1] - delta) > 1e-15:
            raise BudgetSpent(f"{release} was released with another loss")
        return
    enter(1)
    total = sum(loss for loss, _ in entered().values())
    if total > budget * (1 + 1e-9):
        enter(-1)
        raise BudgetSpent(f"{release} needs {epsilon}, which brings {total:g} of {budget:g}")


def bounded_contributions(
    rows: DataFrame, person: str, groups: list[str], row_id: list[str], salt: str, most_groups: int, most_rows: int
) -> DataFrame:
    """At most ``most_rows`` rows of a person in a group, in at most ``most_groups`` groups.

    Which ones is a keyed draw, the same in every run. ``row_id`` tells the rows of a
    person in a group apart. Both limits cut where the rows are read as well: a person
    with most of the rows shuffles a few. Rows without a person are left out.
    """
    key = keyed.secret(rows.sparkSession, salt)

    def text(columns: list[str]) -> list[Column]:
        return [F.concat(F.lit("|"), F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))) for c in columns]

    known = rows.where(F.col(person).isNotNull()).withColumns(
        {
            "__row": keyed.keyed_long(key, F.lit("row"), *text([person, *groups, *row_id])),
            "__group": keyed.keyed_long(key, F.lit("group"), *text([person, *groups])),
        }
    )
    few = Window.partitionBy(person, *groups).orderBy("__row", *row_id)
    kept = known.withColumn("__n", F.row_number().over(few)).where(F.col("__n") <= most_rows)
    # Groups of a person are drawn with their first row each.
    some = Window.partitionBy(person).orderBy("__group", *groups)
    drawn = (
        known.select(person, *groups, "__group")
        .distinct()
        .withColumn("__g", F.row_number().over(some))
        .where(F.col("__g") <= most_groups)
        .select(*[F.col(c).alias(f"__d{k}") for k, c in enumerate([person, *groups])])
    )
    same = reduce(
        Column.__and__, [F.col(c).eqNullSafe(F.col(f"__d{k}")) for k, c in enumerate([person, *groups])]
    )
    return kept.join(drawn, same, "left_semi").drop("__row", "__group", "__n")


def discrete_laplace(key: Column, scale: float, *parts: Column) -> Column:
    """Whole-number noise: the difference of two geometric draws with ratio exp(-1/scale)."""

    def geometric(side: str) -> Column:
        u = (keyed.keyed_long(key, F.lit(side), *parts).cast("double") + 0.5) / F.lit(float(2**60))
        return F.floor(-F.ln(u) * F.lit(float(scale)))

    return (geometric("first") - geometric("second")).cast("bigint")


@dataclass(frozen=True)
class Loss:
    """What a release may cost and how much one person may add to it."""

    epsilon: float
    delta: float
    most_groups: int = 3
    most_rows: int = 2

    @property
    def count_scale(self) -> float:
        """Noise of a count, which takes half of epsilon."""
        return 2 * self.most_groups * self.most_rows / self.epsilon

    def sum_scale(self, bound: int) -> float:
        return 2 * self.most_groups * self.most_rows * bound / self.epsilon

    @property
    def threshold(self) -> int:
        """Counts below it are not shown: a group of one person passes with delta at most."""
        share = self.delta / self.most_groups
        return math.ceil(self.most_rows + self.count_scale * math.log(1 / (2 * share)))


def private_release(
    rows: DataFrame,
    person: str,
    groups: list[str],
    row_id: list[str],
    value: Column,
    bound: int,
    loss: Loss,
    salt: str,
    ledger: str,
    release: str,
    budget: float,
) -> DataFrame:
    """Noisy count and sum per group, after the loss is entered in the ledger.

    One person's share is bounded first: some groups, some rows in each, values as whole
    numbers in 0..``bound``. Counts and sums get discrete Laplace noise for half of
    epsilon each. Only groups that have rows are seen, so those whose noisy count is
    below the threshold of delta are left out. Refused releases raise `BudgetSpent`.
    """
    spark = rows.sparkSession
    spend(spark, ledger, release, loss.epsilon, loss.delta, budget)
    key = keyed.secret(spark, salt)
    whole = F.least(F.greatest(F.coalesce(value, F.lit(0)).cast("bigint"), F.lit(0)), F.lit(bound))
    valued = rows.withColumn("__value", whole)
    kept = bounded_contributions(valued, person, groups, row_id, salt, loss.most_groups, loss.most_rows)
    totals = kept.groupBy(*groups).agg(F.count("*").alias("__n"), F.sum("__value").alias("__s"))
    named = [F.concat(F.lit("|"), F.coalesce(F.col(g).cast("string"), F.lit("\u0000"))) for g in groups]
    parts = [F.lit(release), *named]
    return totals.select(
        *groups,
        (F.col("__n") + discrete_laplace(key, loss.count_scale, F.lit("count"), *parts)).alias("NoisyCount"),
        (F.col("__s") + discrete_laplace(key, loss.sum_scale(bound), F.lit("sum"), *parts)).alias("NoisySum"),
    ).where(F.col("NoisyCount") >= loss.threshold)


# --- k-anonymity by generalisation ----------------------------------------------------

BINS = 256


def _codes(cells: DataFrame, column: str) -> DataFrame:
    """A whole number per value of a quasi-identifier, in its order; NULL comes first."""
    if isinstance(cells.schema[column].dataType, T.IntegralType):
        values = cells.select(column).distinct()
        lowest = F.coalesce(values.agg(F.min(column)).scalar() - 1, F.lit(0))
        return values.select(F.col(column).alias(f"__v_{column}"), F.coalesce(F.col(column), lowest).cast("bigint").alias(f"__c_{column}"))
    numbered = number_rows(cells.select(column).distinct(), [F.asc_nulls_first(column)], f"__c_{column}")
    return numbered.withColumnRenamed(column, f"__v_{column}")


def generalised_cells(cells: DataFrame, columns: list[str], k: int, bins: int = BINS) -> DataFrame:
    """The cells (codes ``__c_*`` and number ``__n``) with a ``__part`` of at least ``k`` rows each.

    Parts are cut in two, level by level. A level tries the columns in turn, the next one
    first in the next level, and takes the first that leaves ``k`` rows on both sides. A cut is at the
    edge of one of ``bins`` equal bins of the part's span: the last edge with at most
    half of the rows below, or the first one above if none has enough.
    A part without such a cut is done. Only histograms, one row per part, column and
    bin, are compared; nothing is collected but whether a part was cut.
    """
    spark = cells.sparkSession
    state = cells.withColumn("__part", F.lit(1).cast("decimal(38,0)")).withColumn("__open", F.lit(True))
    turn = 0
    while True:
        path = fresh_folder(spark, "generalise")
        state.write.parquet(path)
        state = spark.read.parquet(path)
        if turn and state.where("__open").isEmpty():
            return state.drop("__open")
        order = [columns[(turn + i) % len(columns)] for i in range(len(columns))]
        state = _cut(state, order, k, bins)
        turn += 1


def _cut(state: DataFrame, order: list[str], k: int, bins: int) -> DataFrame:
    """Open parts cut once: twice the number for the lower side, one more for the upper."""
    codes = [F.struct(F.lit(i).alias("rank"), F.col(f"__c_{c}").alias("code")) for i, c in enumerate(order)]
    values = state.where("__open").select("__part", "__n", F.explode(F.array(*codes)).alias("d")).select("__part", "__n", "d.*")
    spans = values.groupBy("__part", "rank").agg(
        F.min("code").alias("low"), (F.max("code") - F.min("code") + 1).alias("width"), F.sum("__n").alias("all")
    )
    spans = spans.where((F.col("width") > 1) & (F.col("all") >= 2 * k))
    slot = F.expr(f"CAST((code - low) * {bins}BD div width AS BIGINT)")
    histogram = values.join(spans, ["__part", "rank"]).groupBy("__part", "rank", "low", "width", "all", slot.alias("bin")).agg(F.sum("__n").alias("n"))
    upto = Window.partitionBy("__part", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = histogram.withColumn("below", F.sum("n").over(upto)).where((F.col("below") >= k) & (F.col("all") - F.col("below") >= k))
    # Nearest to the middle from below first, then from above.
    middle = F.struct((2 * F.col("below") > F.col("all")).cast("int"), F.abs(2 * F.col("below") - F.col("all")), "bin")
    best = edges.groupBy("__part", "rank").agg(F.min_by(F.struct("bin", "low", "width"), middle).alias("edge"))
    chosen = best.groupBy("__part").agg(F.min_by(F.struct("rank", "edge"), "rank").alias("cut"))
    joined = state.join(chosen, "__part", "left")
    own = reduce(
        lambda other, i: F.when(F.col("cut.rank") == i, F.col(f"__c_{order[i]}")).otherwise(other),
        range(len(order)),
        F.lit(None).cast("bigint"),
    )
    place = joined.withColumn("code", own).withColumns({"low": F.col("cut.edge.low"), "width": F.col("cut.edge.width")})
    upper = F.expr(f"CAST((code - low) * {bins}BD div width AS BIGINT)") > F.col("cut.edge.bin")
    cut = F.col("cut").isNotNull()
    part = F.when(cut, F.col("__part") * 2 + upper.cast("int")).otherwise(F.col("__part"))
    return place.select(
        *[c for c in state.columns if c not in ("__part", "__open")],
        part.cast("decimal(38,0)").alias("__part"),
        (F.col("__open") & cut).alias("__open"),
    )


def generalise(
    rows: DataFrame, quasi_identifiers: list[str], k: int, spread_by: list[str], bins: int = BINS
) -> DataFrame:
    """All rows, with each quasi-identifier as the span of a group of at least ``k`` rows.

    Spans are texts such as ``3..17``, or one value where all have it; NULL is the lowest
    value and shows as ``*``. ``GroupSize`` is the number of rows that share the spans
    with this one. A table with fewer than ``k`` rows can't be released and gives none.
    """
    columns = quasi_identifiers
    cells = rows.groupBy(*columns).agg(F.count("*").alias("__n"))
    coded = cells
    for column in columns:
        codes = _codes(cells, column)
        coded = coded.join(codes, F.col(column).eqNullSafe(F.col(f"__v_{column}"))).drop(f"__v_{column}")
    parts = generalised_cells(coded, columns, k, bins)

    def shown(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("*"))

    def span(column: str) -> Column:
        first, last = F.min_by(column, f"__c_{column}"), F.max_by(column, f"__c_{column}")
        one = first.eqNullSafe(last)
        return F.when(one, shown(first)).otherwise(F.concat(shown(first), F.lit(".."), shown(last)))

    groups = parts.groupBy("__part").agg(
        F.sum("__n").alias("GroupSize"), *[span(c).alias(f"__s_{c}") for c in columns]
    )
    spans = parts.select("__part", *columns).join(groups.where(F.col("GroupSize") >= k), "__part").drop("__part")
    placed = lookup_join(rows, spans, columns, spread_by, null_safe=True)
    return placed.select(
        *[(F.col(f"__s_{c}").alias(c) if c in columns else F.col(f"`{c}`")) for c in rows.columns], "GroupSize"
    )
