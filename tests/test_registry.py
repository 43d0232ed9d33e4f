"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from bindings.oracles import ORACLES
from bindings.queries import REGISTRY as QUERIES
from labmesh.operators import lookup
from tools.compare import TABLES, bag

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no given tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_keys():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLES) == {"anon_pbkdf2"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    ours = QUERIES[name](spark, FOLDER).toPandas()
    theirs = db.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert bag(ours) == bag(theirs)


LARGE = [
    "q2_workload",
    "q3_irb_compliance",
    "q3_by_project_site",
    "q4_chain_of_custody",
    "q4_institution_trace",
    "q4_candidate_trials",
    "q4_location_scope",
    "dq_cascade_delete",
    "k_anonymity_suppressed",
    "coi_match",
    "publication_impact",
    "trial_features",
]


@pytest.mark.parametrize("name", LARGE)
def test_path_for_large_tables(spark, db, name, monkeypatch):
    """With no side counting as small, lookup joins split hot keys."""
    monkeypatch.setattr(lookup, "ROWS_PER_TASK", 20)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = QUERIES[name](spark, FOLDER)
        assert "__salt" in df._jdf.queryExecution().toString()
        assert bag(df.toPandas()) == bag(db.execute(ORACLES[name]).df())
    finally:
        for key in settings:
            spark.conf.unset(key)
