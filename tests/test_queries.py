"""Every registered query against the same query as SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from workload.oracle import oracle_sql
from workload.queries import REGISTRY

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(REGISTRY) == set(oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, FOLDER).toArrow()
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.column_names)
    assert columns == sorted(want.columns)

    def order(row):
        return tuple((value is None, "" if value is None else value) for value in row)

    left = sorted(zip(*[got[c].to_pylist() for c in columns]), key=order)
    place = [list(want.columns).index(c) for c in columns]
    right = sorted((tuple(row[i] for i in place) for row in want.fetchall()), key=order)
    assert left == right
    assert left


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
