"""Shapes that the physical plans must not have."""

from __future__ import annotations

import os

import pytest

from bindings.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
BATCH = [n for n in REGISTRY if not n.startswith("stream")]

# These end in a scalar or in totals of blocks or ranges, which are single rows or few.
SINGLE = {
    "q1_as_written",
    "q1_positions",
    "q2_positions",
    "q3_positions",
    "numbered_rows",
    "required_tables",
    "surrogate_keys",
    "append_with_keys",
    "publication_impact",
    "coi_match",
    "coi_match_names",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no given tables")


@pytest.mark.parametrize("name", BATCH)
def test_no_row_product_and_no_single_task(spark, name):
    plan = REGISTRY[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert ("SinglePartition" in plan) <= (name in SINGLE)
    assert "BatchEvalPython" not in plan
    assert ("ArrowEvalPython" in plan) <= name.startswith("anon_pbkdf2")
