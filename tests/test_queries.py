"""Registered queries against their SQL twins on the smallest tables."""

import glob
import os

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from paddock.plans import all_queries

# Minutes each: training without a twin of its rows, and the longest run. test_learning, test_parts and
# test_sparse train with the same options on small tables.
SLOW = {
    "train_gbdt", "train_dart", "train_multiclass", "train_goss", "train_categorical", "train_regression_l1", "train_lambdarank", "train_position_bias", "quantised_gradients",
    "monotone", "linear_leaves", "early_stopping", "train_or_load",
}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(all_queries.QUERIES) - SLOW))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SMALL)
    order = sorted(df.columns)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    assert got == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
