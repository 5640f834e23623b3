"""Every named query against its SQL equivalent, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of
from tidemill import plans
from tidemill.tables import SCHEMAS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in SCHEMAS:
        c.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    got = df.collect()
    assert name in entry.oracle_sql(), "every query so far has SQL to compare with"
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, cur.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_type", "n", "total", "window_start", "window_end", "mean"]
    assert df.count() > 0


def test_no_query_name_without_function():
    assert set(entry.oracle_sql()) <= set(entry.queries())
