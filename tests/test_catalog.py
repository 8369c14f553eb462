"""Every registered query against its SQL at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools_check import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF).toPandas()
    assert compare(got, duck.execute(contract.oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql()) - {"merged_grid", "merged_grid_anc"}))
def test_query_without_sql_has_rows(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0
