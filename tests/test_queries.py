"""Every query of the catalog against its SQL, on the smallest tables."""

import os
from glob import glob

import duckdb
import pytest

from sparkloom.plans import catalog


@pytest.fixture(scope="module")
def con(tables):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob(f"{tables}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, tables, con, name):
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = catalog.QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    got = sorted(tuple(map(repr, r)) for r in df.select(*columns).collect())
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached  # a query leaves nothing in the cache
    result = con.execute(catalog.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(repr(r[i]) for i in at) for r in result.fetchall())


def test_every_query_has_sql():
    assert set(catalog.SQL) == set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
