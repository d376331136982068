"""Every registered query against its SQL twin on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as registered
from lexmill.plans.oracle_sql import oracle_sql
from lexmill.plans.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    yield connection
    connection.close()


def bag(frame):
    def plain(value):
        if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
            return None
        value = value.item() if hasattr(value, "item") else value
        return int(value) if isinstance(value, float) and value.is_integer() else value

    columns = sorted(frame.columns)
    return columns, Counter(tuple(map(plain, row)) for row in frame[columns].itertuples(index=False))


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(oracle_sql())
    assert set(QUERIES) <= set(registered.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    ours = bag(registered.queries()[name](spark, str(SF_DIR)).toPandas())
    twin = bag(database.execute(registered.oracle_sql()[name]).df())
    assert ours == twin


def test_entry(spark):
    assert registered.entry(spark).count() > 0
