"""Table pairs the queries work on, and the same pairs as SQL.

A pair divides one whole table by key hash: every row is on exactly one side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablemirror.operators.sample import split
from tablemirror.plans.registry import table
from tablemirror.schema import CATEGORICAL, NUMERICAL, ORDINAL, TableMeta, TablePair
from tablemirror.session import written

SEED = 7

LINEITEM = TableMeta({
    "l_quantity": NUMERICAL, "l_extendedprice": NUMERICAL, "l_discount": NUMERICAL, "l_tax": NUMERICAL,
    "l_linenumber": ORDINAL, "l_returnflag": CATEGORICAL, "l_linestatus": CATEGORICAL})
ORDERS = TableMeta({"o_totalprice": NUMERICAL, "o_orderstatus": CATEGORICAL, "o_orderpriority": ORDINAL})
PART = TableMeta({"p_size": NUMERICAL, "p_retailprice": NUMERICAL, "p_brand": CATEGORICAL, "p_type": CATEGORICAL})
EVENTS = TableMeta({"value": NUMERICAL, "event_type": CATEGORICAL})

TABLES = {"lineitem": (LINEITEM, "l_orderkey"), "orders": (ORDERS, "o_orderkey"), "part": (PART, "p_partkey"),
          "events": (EVENTS, "event_id")}


def sides(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Real and fake rows of a table with all their columns."""
    return split(table(spark, folder, name), [TABLES[name][1]], 0.5, SEED)


def pair(spark: SparkSession, folder: str, name: str) -> TablePair:
    meta = TABLES[name][0]
    real, fake = sides(spark, folder, name)
    return TablePair(real.select(*meta.columns), fake.select(*meta.columns), meta)


def kept_pair(spark: SparkSession, folder: str, name: str) -> TablePair:
    """``pair`` written once, for queries whose jobs would each divide the table by its key hashes again."""
    both = pair(spark, folder, name)
    return TablePair(written(both.real), written(both.fake), both.meta)


# ---------------------------------------------------------------- SQL

def h_sql(seed: int, stream: str, *key: str) -> str:
    parts = ", ".join(f"coalesce(strlen(CAST({k} AS VARCHAR)) || ':' || CAST({k} AS VARCHAR), '-')" for k in key)
    return f"md5(concat_ws('|', '{seed}', '{stream}', {parts}))"


def u_sql(seed: int, stream: str, *key: str) -> str:
    return f"(CAST('0x' || substr({h_sql(seed, stream, *key)}, 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def sides_sql(name: str) -> str:
    """CTEs ``rl`` and ``fk``."""
    u = u_sql(SEED, "split", TABLES[name][1])
    return f"rl AS (SELECT * FROM {name} WHERE {u} < 0.5), fk AS (SELECT * FROM {name} WHERE {u} >= 0.5)"


def long_sql(source: str, columns, dtype: str, keep: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keep}'{c}' AS name, CAST({c} AS {dtype}) AS value FROM {source}" for c in columns)
