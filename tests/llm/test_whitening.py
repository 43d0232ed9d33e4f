"""Whitening against numpy's eigenvalues and plain integers."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest

from labmesh.llm.queries import REGISTRY
from labmesh.llm.whitening import eigenvalues_above, leading_eigenpairs, whiten

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, n string, whitened int"


def table(spark, *rows):
    """Rows of (vec_id, embedding) with columns that clash with results."""
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)


def expected(given, components=8):
    """Per vector and component what plain arithmetic gives, by position."""
    whole = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in given]
    n, sums = len(whole), [sum(c) for c in zip(*whole)]
    deviation = [sum((n * x - s) ** 2 for x, s in zip(row, sums)) for row in whole]
    centred = np.array([[(n * x - s) / n for x, s in zip(row, sums)] for row in whole])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, deviation, centred @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("seed", range(6))
def test_counts_of_shifted_matrices(seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((30, 30))
    matrix = a + a.T
    if seed == 5:
        matrix = np.kron(np.eye(15), [[0, 1], [1, 0]])
    values = np.linalg.eigvalsh(matrix)
    for shift in [*(values[:-1] + np.diff(values) / 2), -100, 100]:
        if np.abs(values - shift).min() > 1e-9:
            assert eigenvalues_above(matrix, shift) == (values > shift).sum()


@pytest.mark.parametrize(
    "spectrum",
    [
        [9, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1],
        [5, 5, 5, 3, 3, 2, 1.0000001, 1, 0.1, 0.1],
        [5, 5 - 1e-9, 5 - 1e-8, 3, 3 - 1e-6, 2, 1, 1, 1, 1, 1, 1],
        [4, 2, 0, 0, 0],
        [1e-30, 1e-31, 0],
        [7],
        [2] * 20,
    ],
)
def test_leading_eigenpairs(spectrum):
    rng = np.random.default_rng(len(spectrum))
    turn = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))[0]
    matrix = turn @ np.diag(spectrum) @ turn.T
    matrix = (matrix + matrix.T) / 2
    values, axes = leading_eigenpairs(matrix, 8)
    want = [v for v in sorted(spectrum, reverse=True) if v > 0][:8]
    norm = max(spectrum)
    assert np.allclose(values, want, rtol=0, atol=1e-13 * norm)
    assert np.abs(matrix @ axes - axes * values).max() < 1e-12 * norm
    assert np.abs(axes.T @ axes - np.eye(len(want))).max() < 1e-12


def test_nothing_to_find():
    assert leading_eigenpairs(np.zeros((3, 3)), 8)[0].size == 0


def check(rows, ids, given, components=8):
    n, deviation, whitened, explained = expected(given, components)
    rows = rows.sort_values(["vec_id", "component"])
    found = rows["whitened"].to_numpy().reshape(len(given), -1)
    order = np.argsort(ids, kind="stable")
    want = whitened[order]
    signs = np.sign((found * want).sum(axis=0))
    assert np.abs(found * signs - want).max() < 1e-8
    assert (rows["n"] == n).all()
    assert [int(d) for d in rows["deviation"][:: found.shape[1]]] == [deviation[k] for k in order]
    assert np.allclose(rows["explained"].to_numpy().reshape(len(given), -1), explained, rtol=1e-10)
    assert rows["identity_error"].nunique() == 1 and rows["identity_error"].max() < 1e-9


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no given tables")
def test_query(spark):
    given = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    rows = REGISTRY["op11_whitening"](spark, FOLDER).toPandas()
    check(rows, given["vec_id"].to_numpy(), [list(v) for v in given["embedding"]])


def test_rows_without_a_vector_and_clashing_columns(spark):
    rng = np.random.default_rng(0)
    good = [(k, rng.standard_normal(5).tolist()) for k in range(40)]
    bad = [
        (100, None),
        (101, [1.0, None, 1.0, 1.0, 1.0]),
        (102, [1.0, float("nan"), 1.0, 1.0, 1.0]),
        (103, [1.0, float("inf"), 1.0, 1.0, 1.0]),
        (104, []),
        (105, [1.0, 2.0]),
    ]
    rows = whiten(table(spark, *good, *bad)).toPandas()
    assert sorted(rows["vec_id"].unique()) == list(range(40)) and rows["component"].max() == 5
    check(rows, np.arange(40), [v for _, v in good])


def test_repeated_and_missing_ids_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [3.0, 1.0]), (None, [3.0, 1.0])]
    found = whiten(table(spark, *rows)).toPandas()
    assert len(found) == 8 and (found["n"] == 4).all() and found["vec_id"].isna().sum() == 4


def test_too_little_for_a_component(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)]):
        found = whiten(table(spark, *rows))
        assert found.columns[:2] == ["vec_id", "component"] and found.collect() == []


def test_rank_bounds_the_components(spark):
    rows = [(k, [float(k), 2.0 * k, 7.0]) for k in range(9)]
    assert whiten(table(spark, *rows)).select("component").distinct().count() == 1


def test_large_entries_are_exact(spark):
    rows = [(1, [3e9, 1.0]), (2, [-3e9, 2.0]), (3, [1e9, 5.0])]
    check(whiten(table(spark, *rows), components=1).toPandas(), np.arange(3), [v for _, v in rows], 1)
    huge = whiten(table(spark, (1, [3e38, 1.0]), (2, [-3e38, 2.0])), components=1).toPandas()
    assert huge["deviation"].isna().all() and np.allclose(np.abs(huge["whitened"]), 1)
