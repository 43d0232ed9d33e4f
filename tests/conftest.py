from __future__ import annotations

import os
import sys
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labmesh.sources.schemas import TABLES  # noqa: E402

AS_OF = "2025-07-05 12:00:00"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(folder / "shared"))
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _typed(value, kind):
    """Text to the date, time or number that a column holds."""
    if value is None:
        return None
    if isinstance(kind, T.DateType):
        return date.fromisoformat(value)
    if isinstance(kind, T.TimestampType):
        return datetime.fromisoformat(value + "+00:00" if "+" not in value else value)
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value))
    return value


@pytest.fixture(scope="session")
def make(spark):
    """Build a domain table from dicts; columns left out are NULL."""

    def build(name: str, *rows: dict):
        fields = TABLES[name].columns
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
        data = [tuple(_typed(r.get(f.name), f.dataType) for f in fields) for r in rows]
        unknown = {k for r in rows for k in r} - {f.name for f in fields}
        assert not unknown, unknown
        return spark.createDataFrame(data, schema)

    return build


def rows_of(df, *columns):
    """Rows as tuples, in a fixed order."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
