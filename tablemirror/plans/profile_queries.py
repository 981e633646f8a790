"""Profiling, cleaning and column encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemirror.operators import clean, profile
from tablemirror.operators.stats import align_tables
from tablemirror.plans.fixtures import LINEITEM, long_sql, sides, sides_sql
from tablemirror.plans.registry import query, rounded, table
from tablemirror.schema import TableMeta, TablePair, kinds_from_types

NUM, DISC = LINEITEM.numericals, LINEITEM.discretes


def _distinct_sql(columns):
    return " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS distinct_values FROM lineitem" for c in columns)


KINDS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("p1_kind_by_cardinality", f"""
SELECT name, distinct_values,
       CASE WHEN name NOT IN ('l_returnflag', 'l_linestatus') AND distinct_values > 20 THEN 'numerical'
            ELSE 'categorical' END AS kind
FROM ({_distinct_sql(KINDS)})""")
def p1(spark, sf):
    return profile.infer_kinds(table(spark, sf, "lineitem").select(*KINDS), unique_thresh=20)


@query("p2_kind_by_type", """
SELECT 'o_orderkey' AS name, 'numerical' AS kind, count(o_orderkey) AS present FROM orders UNION ALL
SELECT 'o_totalprice', 'numerical', count(o_totalprice) FROM orders UNION ALL
SELECT 'o_orderstatus', 'categorical', count(o_orderstatus) FROM orders UNION ALL
SELECT 'o_orderpriority', 'categorical', count(o_orderpriority) FROM orders""")
def p2(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    kinds = spark.createDataFrame(list(kinds_from_types(df).items()), "name string, kind string")
    present = profile.long_form(df.agg(*[F.count(c).alias(c) for c in df.columns]), df.columns, "bigint")
    return kinds.join(present.withColumnRenamed("value", "present"), "name")


@query("p3_vocabulary", f"""
SELECT name, value, cnt, row_number() OVER (PARTITION BY name ORDER BY cnt DESC, value) - 1 AS rank
FROM (SELECT name, value, count(*) AS cnt FROM ({long_sql('lineitem', DISC, 'VARCHAR')}) GROUP BY ALL)""")
def p3_vocabulary(spark, sf):
    return profile.vocabulary(table(spark, sf, "lineitem"), DISC)


def _meta_sql():
    parts = []
    for i, (c, k) in enumerate(LINEITEM.kinds.items()):
        if k == "numerical":
            parts.append(f"SELECT '{c}' AS name, {i} AS position, '{k}' AS kind, CAST(min({c}) AS DOUBLE) AS \"min\", CAST(max({c}) AS DOUBLE) AS \"max\", NULL::BIGINT AS size FROM lineitem")
        else:
            parts.append(f"SELECT '{c}', {i}, '{k}', NULL, NULL, count(DISTINCT {c}) FROM lineitem")
    return " UNION ALL ".join(parts)


@query("p3_column_metadata", _meta_sql())
def p3_metadata(spark, sf):
    return profile.column_metadata(table(spark, sf, "lineitem"), LINEITEM)


@query("p4_column_indices", """
SELECT 'ordinal' AS kind, 4 AS position, count(DISTINCT l_linenumber) AS size FROM lineitem UNION ALL
SELECT 'categorical', 5, count(DISTINCT l_returnflag) FROM lineitem UNION ALL
SELECT 'categorical', 6, count(DISTINCT l_linestatus) FROM lineitem""")
def p4(spark, sf):
    categorical, ordinal = profile.column_indices(LINEITEM)
    rows = [("categorical", i) for i in categorical] + [("ordinal", i) for i in ordinal]
    sizes = profile.column_metadata(table(spark, sf, "lineitem"), LINEITEM).select("position", "size")
    return spark.createDataFrame(rows, "kind string, position int").join(sizes, "position")


def _stats_sql():
    parts = []
    for c, k in LINEITEM.kinds.items():
        if k == "numerical":
            parts.append(f"SELECT '{c}' AS name, '{k}' AS kind, CAST(min({c}) AS DOUBLE) AS \"min\", CAST(max({c}) AS DOUBLE) AS \"max\", NULL::BIGINT AS size, round(avg({c}), 6) AS mean FROM lineitem")
        else:
            parts.append(f"SELECT '{c}', '{k}', NULL, NULL, count(DISTINCT {c}), NULL FROM lineitem")
    return " UNION ALL ".join(parts)


@query("p5_encoder_statistics", _stats_sql())
def p5(spark, sf):
    return rounded(profile.encoder_statistics(table(spark, sf, "lineitem"), LINEITEM))


# ---------------------------------------------------------------- cleaning

@query("c1_impute_categorical", """
SELECT o_orderkey, coalesce(nullif(o_orderpriority, '2-HIGH'), '[NAN]') AS o_orderpriority FROM orders""")
def c1(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("2-HIGH")).alias("o_orderpriority"))
    return clean.impute_categorical(df, ["o_orderpriority"])


@query("c2_impute_numerical", """
SELECT o_orderkey, round(coalesce(x, (SELECT avg(CASE WHEN o_totalprice <= 250000 THEN o_totalprice END) FROM orders)), 4) AS o_totalprice
FROM (SELECT o_orderkey, CASE WHEN o_totalprice <= 250000 THEN o_totalprice END AS x FROM orders)""")
def c2(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") <= 250000, F.col("o_totalprice")).alias("o_totalprice"))
    return rounded(clean.impute_numerical(df, ["o_totalprice"]), 4)


FIRST = """firsts AS (SELECT o_orderpriority AS value, min(o_orderkey) AS f FROM orders GROUP BY 1),
codes AS (SELECT value, row_number() OVER (ORDER BY f, value) - 1 AS code FROM firsts)"""


@query("c3_factorize_first_appearance", f"""
WITH {FIRST} SELECT o_orderkey, code AS o_orderpriority FROM orders JOIN codes ON o_orderpriority = value""")
def c3(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return clean.factorize(df, "o_orderpriority", order_by="o_orderkey")[0]


@query("c3_factorize_frequency", """
WITH codes AS (SELECT p_brand AS value, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS code FROM part GROUP BY p_brand)
SELECT p_partkey, code AS p_brand FROM part JOIN codes ON p_brand = value""")
def c3_frequency(spark, sf):
    return clean.factorize(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand")[0]


@query("c4_decode_codes", "SELECT o_orderkey, o_orderpriority FROM orders")
def c4(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    coded, mapping = clean.factorize(df, "o_orderpriority", order_by="o_orderkey")
    return clean.decode_codes(coded, "o_orderpriority", mapping)


@query("c5_shared_target", f"""
WITH {sides_sql('orders')}, codes AS (
  SELECT o_orderpriority AS value, row_number() OVER (ORDER BY min(o_orderkey), o_orderpriority) - 1 AS code
  FROM rl WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderpriority)
SELECT o_orderkey, code AS o_orderpriority FROM fk LEFT JOIN codes ON o_orderpriority = value""")
def c5(spark, sf):
    real, fake = sides(spark, sf, "orders")
    chosen = ["o_orderkey", "o_orderpriority"]
    # The last label never occurs on the real side, so fake rows with it get NULL.
    both = TablePair(real.select(*chosen).filter(F.col("o_orderpriority") != "5-LOW"), fake.select(*chosen), TableMeta({}))
    return clean.shared_target(both, "o_orderpriority", order_by="o_orderkey")[1]


@query("c6_numeric_encoding", f"""
WITH {sides_sql('orders')}
SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS "o_orderstatus_F",
  CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END AS "o_orderstatus_O",
  CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END AS "o_orderstatus_P" FROM fk""")
def c6(spark, sf):
    real, fake = sides(spark, sf, "orders")
    meta = TableMeta({"o_totalprice": "numerical", "o_orderstatus": "categorical"})
    return clean.numeric_encoding(TablePair(real, fake, meta), keep=["o_orderkey"])[1]


@query("c7_zscore", """
SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders), 6) AS o_totalprice
FROM orders""")
def c7(spark, sf):
    return rounded(clean.zscore(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]))


@query("c8_projection", """
SELECT 0 AS missing, o_orderkey, o_orderstatus FROM orders""")
def c8(spark, sf):
    return clean.project(table(spark, sf, "orders"), ["o_orderstatus", "o_orderkey", "o_totalprice", "missing"], drop=["o_totalprice"])


@query("c9_mask_diagonal", f"""
WITH c AS ({' UNION ALL '.join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS value FROM lineitem" for a in NUM for b in NUM)})
SELECT col_a, col_b, round(value, 6) AS value FROM c WHERE col_a <> col_b""")
def c9(spark, sf):
    from tablemirror.operators.assoc import association_matrix
    matrix = association_matrix(table(spark, sf, "lineitem"), LINEITEM.without(*DISC))
    return rounded(matrix.filter(F.col("col_a") != F.col("col_b")))


@query("s9_align_tables", f"""
WITH {sides_sql('part')}
SELECT p_partkey, p_size, p_retailprice FROM fk""")
def s9(spark, sf):
    real, fake = sides(spark, sf, "part")
    untyped = fake.select(F.col("p_partkey").cast("string").alias("k"), F.col("p_name").alias("n"),
                          F.col("p_size").cast("string").alias("s"), F.col("p_retailprice").cast("string").alias("p"))
    known = real.select("p_partkey", "p_size", "p_retailprice")
    return align_tables(known, untyped.drop("n"))[1]


