"""Every registered query at the smallest scale, against its SQL twin."""

import __spark_entry__ as entry
import pytest
from check import compare, duck

from shelfwise.catalog import load

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(load()[0]))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(df.columns) == len(set(df.columns)) and not df.isEmpty()
    else:
        assert compare(con, sql, df) is None


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.total_orders == 1500


def test_all_columns_are_examined(spark):
    few, every = (entry.queries()[n](spark, FOLDER).collect() for n in ("issue_near_dups_lev", "issue_near_dups_lev_all"))
    assert "name" in {r.column for r in every} - {r.column for r in few} and set(few) < set(every)
