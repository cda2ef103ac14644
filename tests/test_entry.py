"""The queries on the smallest tables against their SQL."""

import glob
import math
import os
from decimal import Decimal

import pytest

import __spark_entry__
from millrace.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(columns, found):
    """Sorted rows, columns in order of name, numbers as rounded floats."""

    def plain(x):
        if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool):
            return None if math.isnan(x) else round(float(x), 6)
        return x if x is None else str(x)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query(spark, name):
    import duckdb

    with duckdb.connect() as con:
        for path in glob.glob(f"{FOLDER}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
        con.execute(plans.ORACLE_SQL[name])
        columns, want = [c[0] for c in con.description], con.fetchall()
    got = plans.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
