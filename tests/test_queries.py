"""Registered queries against their SQL twins on the smallest scale."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import TABLES, compare  # noqa: E402

import __spark_entry__  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
# Model fits take the time; they are covered by invariants in test_measures.
SLOW = ("u", "b1", "e1_", "e2_", "e3_", "a15_report", "a10_pca", "v1_")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES and not n.startswith(SLOW)])
def test_equals_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], FOLDER).startswith("ok")
    spark.catalog.clearCache()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["section", "metric", "value"] and df.count() > 0
    spark.catalog.clearCache()
