"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest
from compare import duck, duck_rows, spark_rows

import __spark_entry__ as entry_point
from claimscope.checks import registry

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES = registry.queries()
ORACLES = registry.oracle_sql()
# no group passes the size limits of these reports on the smallest tables
MAY_BE_EMPTY = {"report_storm_control", "summary_storm_environment", "summary_top_storms", "semi_join_major_events"}
DUCK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    names, rows = spark_rows(df)
    want_names, want_rows, want_types = duck_rows(con, ORACLES[name])
    assert names == want_names
    assert {c: DUCK_TYPES[t] for c, t in df.dtypes} == want_types
    assert rows == want_rows
    assert rows or name in MAY_BE_EMPTY


def test_entry(spark):
    assert entry_point.entry(spark).columns[0] == "yearOfLoss"
