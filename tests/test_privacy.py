"""Private releases and generalisation."""

from __future__ import annotations

import collections
import math

import pytest
from pyspark.sql import functions as F

from labmesh.functions import keyed
from labmesh.plans import privacy
from tests.conftest import rows_of

SALT = "a-salt"


def test_the_ledger_refuses_what_is_beyond_the_budget(spark, tmp_path):
    ledger = str(tmp_path / "ledger")

    def spend(name, epsilon):
        privacy.spend(spark, ledger, name, epsilon, 1e-6, 2.0)

    spend("a", 1.0)
    spend("a", 1.0)  # the same release again costs nothing
    with pytest.raises(privacy.BudgetSpent, match="b needs 1.5"):
        spend("b", 1.5)
    spend("c", 1.0)
    with pytest.raises(privacy.BudgetSpent):
        spend("d", 0.001)
    with pytest.raises(privacy.BudgetSpent, match="another loss"):
        spend("a", 0.5)
    with pytest.raises(ValueError):
        spend("e", 0.0)


def test_one_person_adds_a_bounded_share(spark):
    """A person with nearly all rows, rows without a person, rows that are equal."""
    rows = [(1, g, n) for g in range(50) for n in range(40)] + [(2, 0, 0), (2, 0, 0), (2, 0, 0), (None, 0, 1)]
    df = spark.createDataFrame(rows, "person int, g int, n int")
    kept = privacy.bounded_contributions(df, "person", ["g"], ["n"], SALT, most_groups=3, most_rows=2)
    found = rows_of(kept)
    count = collections.Counter((r[0], r[1]) for r in found)
    assert kept.columns == df.columns
    assert set(count.values()) == {2} and sum(p == 1 for p, _ in count) == 3 and count[2, 0] == 2
    again = privacy.bounded_contributions(df.repartition(5), "person", ["g"], ["n"], SALT, 3, 2)
    assert rows_of(again) == found
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3


def test_noise_is_whole_and_has_its_scale(spark):
    key = keyed.secret(spark, SALT)
    scale = 5.0
    noise = privacy.discrete_laplace(key, scale, F.col("id"))
    values = [r[0] for r in spark.range(20_000).select(noise.alias("n")).collect()]
    assert all(isinstance(v, int) for v in values)
    ratio = math.exp(-1 / scale)
    deviation = math.sqrt(2 * ratio) / (1 - ratio)
    assert abs(sum(values) / len(values)) < 5 * deviation / math.sqrt(len(values))
    assert abs(math.sqrt(sum(v * v for v in values) / len(values)) / deviation - 1) < 0.05
    zero = (1 - ratio) / (1 + ratio)
    assert abs(values.count(0) / len(values) - zero) < 5 * math.sqrt(zero / len(values))


def test_rare_groups_are_not_shown(spark, tmp_path):
    rows = [(p, "common", 10) for p in range(400)] + [(1000, "rare", 10)]
    df = spark.createDataFrame(rows, "person int, g string, v int").withColumn("id", F.monotonically_increasing_id())
    loss = privacy.Loss(epsilon=2.0, delta=1e-6, most_groups=1, most_rows=1)
    args = (df, "person", ["g"], ["id"], F.col("v"), 20, loss, SALT, str(tmp_path / "l"))
    found = rows_of(privacy.private_release(*args, "first", budget=2.0))
    assert [r[0] for r in found] == ["common"]
    assert abs(found[0][1] - 400) < 40 and abs(found[0][2] - 4000) < 800
    assert rows_of(privacy.private_release(*args, "first", budget=2.0)) == found
    with pytest.raises(privacy.BudgetSpent):
        privacy.private_release(*args, "second", budget=2.0)


PEOPLE = "id int, age int, zip string, note string"


def spans_hold(value, span, text):
    if span == "*" or value is None:
        return value is None and (span == "*" or span.startswith("*.."))
    low, _, high = span.partition("..")
    high = high or low
    if text:
        return (low == "*" or low <= value) and value <= high
    return (low == "*" or int(low) <= value) and value <= int(high)


@pytest.mark.parametrize("k", [2, 5, 17])
def test_everybody_stays_in_a_group_of_k(spark, k):
    rows = [(i, (i * 37) % 71 if i % 19 else None, f"Z{(i * i) % 23}" if i % 31 else None, "x") for i in range(300)]
    # A third of all share one combination.
    rows += [(1000 + i, 33, "Z5", "hot") for i in range(150)]
    out = privacy.generalise(spark.createDataFrame(rows, PEOPLE), ["age", "zip"], k, ["id"])
    assert out.columns == ["id", "age", "zip", "note", "GroupSize"]
    found = {r["id"]: r for r in out.collect()}
    assert len(found) == len(rows)
    groups = collections.Counter((r["age"], r["zip"]) for r in found.values())
    assert min(groups.values()) >= k and len(groups) > 450 / (12 * k)
    for i, age, zip_, _ in rows:
        assert spans_hold(age, found[i]["age"], False) and spans_hold(zip_, found[i]["zip"], True)
        assert found[i]["GroupSize"] <= groups[found[i]["age"], found[i]["zip"]]


def test_what_cannot_be_cut_stays_whole(spark):
    same = spark.createDataFrame([(i, 5, "a", "x") for i in range(9)], PEOPLE)
    assert {(r["age"], r["zip"], r["GroupSize"]) for r in privacy.generalise(same, ["age", "zip"], 3, ["id"]).collect()} == {("5", "a", 9)}
    few = spark.createDataFrame([(1, 5, "a", "x"), (2, 6, "b", "x")], PEOPLE)
    assert privacy.generalise(few, ["age", "zip"], 3, ["id"]).collect() == []
    assert privacy.generalise(few.limit(0), ["age", "zip"], 3, ["id"]).collect() == []
    unknown = spark.createDataFrame([(i, None, None, "x") for i in range(4)], PEOPLE)
    assert {r["age"] for r in privacy.generalise(unknown, ["age", "zip"], 2, ["id"]).collect()} == {"*"}
