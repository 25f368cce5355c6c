"""Every query equals its SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from readloom.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cur = con.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    ours = Counter(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert ours == Counter(tuple(str(r[names.index(c)]) for c in columns) for r in cur.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "reconstructed_sequence" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
