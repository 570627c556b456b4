import glob
import os

import duckdb
import pytest

import __spark_entry__
from tracewright.plans import registry

SF = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 9) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        found.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return found


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    found = sorted(tuple(map(plain, r)) for r in got.collect())
    expected = sorted(tuple(map(plain, r)) for r in want.project(", ".join(f'"{c}"' for c in got.columns)).fetchall())
    assert found == expected and found


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
