import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry
from bundlewise.plans import catalog, oracles
from check_oracles import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_statement():
    assert set(catalog.queries()) == set(oracles.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries()) and set(oracles.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_statement(spark, con, name):
    assert compare(spark, con, SF, catalog.queries()[name], oracles.oracle_sql()[name]) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"trace_id", "category", "root_cause"} <= set(df.columns)
