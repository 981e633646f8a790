"""Column encoders and whole-table encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemirror.operators import encode
from tablemirror.plans.fixtures import LINEITEM, ORDERS, sides, sides_sql
from tablemirror.plans.registry import query, rounded, scratch, table
from tablemirror.schema import TableMeta

NUM = LINEITEM.numericals
ENDS = "ends AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)"


def _round_trip(spark, sf, encoders, columns):
    """``name, rows, mean_error, inside``: how far decode(encode(x)) is from x."""
    df = table(spark, sf, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"]
    coded = df.select(*columns, *[e.encode(key).alias(f"_{e.column}") for e in encoders])
    aggs = []
    for e in encoders:
        back = e.decode(F.col(f"_{e.column}"))
        aggs += [F.avg(F.abs(back - F.col(e.column))).alias(f"error_{e.column}"),
                 F.avg((F.abs(F.element_at(f"_{e.column}", 1)) < 0.99).cast("double")).alias(f"inside_{e.column}")]
    row = coded.agg(*aggs, F.count(F.lit(1)).alias("n"))
    return rounded(row.select(F.inline(F.array(*[F.struct(
        F.lit(e.column).alias("name"), F.lit(sum(w for w, _ in e.layout)).alias("width"), F.col("n").alias("rows"),
        F.col(f"error_{e.column}").alias("mean_error"), F.col(f"inside_{e.column}").alias("inside"))
        for e in encoders]))), 4)


@query("e1_bayesian_mixture")
def e1(spark, sf):
    df = table(spark, sf, "lineitem")
    return _round_trip(spark, sf, encode.fit_mixture(df, NUM, True), NUM)


@query("e2_gaussian_mixture")
def e2(spark, sf):
    df = table(spark, sf, "lineitem")
    return _round_trip(spark, sf, encode.fit_mixture(df, NUM, False), NUM)


@query("e3_kmeans_bins")
def e3(spark, sf):
    df = table(spark, sf, "lineitem")
    return _round_trip(spark, sf, encode.fit_kmeans_bins(df, NUM), NUM)


@query("e4_uniform_bins", """
WITH ends AS (SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS w FROM events),
b AS (SELECT event_id, CAST(least(floor((value - lo) / w), 9) AS INTEGER) AS bin, lo, w FROM events, ends)
SELECT event_id, bin, round(lo + (bin + 0.5) * w, 6) AS midpoint FROM b""")
def e4(spark, sf):
    df = table(spark, sf, "events")
    (e,) = encode.fit_uniform_bins(df, ["value"])
    code = e.bin(F.col("value"))
    return rounded(df.select("event_id", code.alias("bin"), e.midpoint(code).alias("midpoint")))


@query("e5_power_transform_fixed", """
SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 0.5) - 1) / 0.5
  ELSE -(pow(1 - c_acctbal, 1.5) - 1) / 1.5 END, 6) AS t FROM customer""")
def e5_fixed(spark, sf):
    return rounded(table(spark, sf, "customer").select("c_custkey", encode.yeo_johnson(F.col("c_acctbal"), 0.5).alias("t")))


@query("e5_power_transform_fit")
def e5(spark, sf):
    df = table(spark, sf, "events").join(table(spark, sf, "customer"), F.col("user_id") == F.col("c_custkey"), "left")
    encoders = encode.fit_power(df, ["value", "c_acctbal"])
    coded = df.select("value", "c_acctbal", *[e.encode().alias(f"_{e.column}") for e in encoders])
    row = coded.agg(*[a for e in encoders for a in (
        F.max(F.abs(e.decode(F.col(f"_{e.column}")) - F.col(e.column))).alias(f"error_{e.column}"),
        F.avg(F.element_at(f"_{e.column}", 1)).alias(f"mean_{e.column}"),
        F.stddev_pop(F.element_at(f"_{e.column}", 1)).alias(f"sd_{e.column}"))])
    return rounded(row.select(F.inline(F.array(*[F.struct(
        F.lit(e.column).alias("name"), F.lit(e.lam).alias("power"), F.col(f"error_{e.column}").alias("max_error"),
        F.col(f"mean_{e.column}").alias("mean"), F.col(f"sd_{e.column}").alias("sd")) for e in encoders]))), 3)


@query("e6_minmax", f"""
WITH {ENDS} SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo) * 2 - 1, 6) AS scaled, round(o_totalprice, 4) AS decoded FROM orders, ends""")
def e6(spark, sf):
    df = table(spark, sf, "orders")
    (e,) = encode.fit_minmax(df, ["o_totalprice"])
    out = df.select("o_orderkey", e.encode().alias("v")).select(
        "o_orderkey", F.element_at("v", 1).alias("scaled"), e.decode(F.col("v")).alias("decoded"))
    return rounded(out, decoded=4)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("e7_one_hot", "SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN o_orderpriority = '{p}' THEN 1.0 ELSE 0.0 END AS hot_{i}" for i, p in enumerate(PRIORITIES))
    + ", o_orderpriority AS decoded FROM orders")
def e7(spark, sf):
    df = table(spark, sf, "orders")
    (e,) = encode.fit_one_hot(df, ["o_orderpriority"])
    coded = df.select("o_orderkey", e.encode().alias("v"))
    return coded.select("o_orderkey", *[F.element_at("v", i + 1).alias(f"hot_{i}") for i in range(len(e.values))],
                        e.decode(F.col("v")).alias("decoded"))


@query("e8_ordinal", """
SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code, c_mktsegment AS decoded FROM customer""")
def e8(spark, sf):
    df = table(spark, sf, "customer")
    (e,) = encode.fit_ordinal(df, ["c_mktsegment"])
    coded = df.select("c_custkey", e.encode().alias("v"))
    return coded.select("c_custkey", F.element_at("v", 1).cast("bigint").alias("code"), e.decode(F.col("v")).alias("decoded"))


# A given vocabulary, as metadata carries it: its order is the code, values outside it code to nothing.
GIVEN_PRIORITIES = ["5-LOW", "1-URGENT", "3-MEDIUM", "2-HIGH"]


@query("e7_one_hot_given_vocabulary", "SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN o_orderpriority = '{p}' THEN 1.0 ELSE 0.0 END AS hot_{i}" for i, p in enumerate(GIVEN_PRIORITIES)) + " FROM orders")
def e7_given(spark, sf):
    df = table(spark, sf, "orders")
    (e,) = encode.fit_one_hot(df, ["o_orderpriority"], TableMeta(ORDERS.kinds, {"o_orderpriority": GIVEN_PRIORITIES}).vocabularies)
    coded = df.select("o_orderkey", e.encode().alias("v"))
    return coded.select("o_orderkey", *[F.element_at("v", i + 1).alias(f"hot_{i}") for i in range(len(e.values))])


@query("e8_ordinal_given_vocabulary", "SELECT o_orderkey, CAST(CASE o_orderpriority " + " ".join(
    f"WHEN '{p}' THEN {i}" for i, p in enumerate(GIVEN_PRIORITIES)) + " END AS BIGINT) AS code, "
    "dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS status FROM orders")
def e8_given(spark, sf):
    df = table(spark, sf, "orders")
    meta = TableMeta(ORDERS.kinds, {"o_orderpriority": GIVEN_PRIORITIES})
    given, fitted = encode.fit_ordinal(df, ["o_orderpriority", "o_orderstatus"], meta.vocabularies)
    return df.select("o_orderkey", F.element_at(given.encode(), 1).cast("bigint").alias("code"),
                     F.element_at(fitted.encode(), 1).cast("bigint").alias("status"))


@query("e8_ordinal_large_vocabulary", """
SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) - 1 AS p_name, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand FROM part""")
def e8_join(spark, sf):
    return encode.ordinal_codes(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), ["p_name", "p_brand"])


@query("e8_ordinal_integers", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_size) - 1 AS code, dense_rank() OVER (ORDER BY p_size) - 1 AS p_size FROM part")
def e8_integers(spark, sf):
    """Both ways of coding integers above 9, which as text would be out of order."""
    df = table(spark, sf, "part")
    (e,) = encode.fit_ordinal(df, ["p_size"])
    coded = df.select("p_partkey", "p_size", F.element_at(e.encode(), 1).cast("bigint").alias("code"))
    return encode.ordinal_codes(coded, ["p_size"]).select("p_partkey", "code", "p_size")


@query("e9_padded_matrix", f"""
WITH {ENDS}, c AS (SELECT o_orderkey, o_totalprice,
  dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS st, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS pr FROM orders)
SELECT o_orderkey, round((o_totalprice - (lo - 1e-3)) / ((hi + 1e-3) - (lo - 1e-3)) * 2 - 1, 6) AS v0,
  round((st + 1e-3) / (2 + 2e-3) * 2 - 1, 6) AS v1, round((pr + 1e-3) / (4 + 2e-3) * 2 - 1, 6) AS v2,
  0.0 AS padding, 16 AS cells, round(o_totalprice, 4) AS o_totalprice, CAST(st AS DOUBLE) AS o_orderstatus, CAST(pr AS DOUBLE) AS o_orderpriority
FROM c, ends""")
def e9(spark, sf):
    df = table(spark, sf, "orders")
    codes = {e.column: e for e in encode.fit_ordinal(df, ORDERS.discretes)}
    bounds = encode.padded_bounds(df, ORDERS, {c: len(e.values) for c, e in codes.items()})
    columns = {c: codes[c].code(F.col(c)) if c in codes else F.col(c) for c in ORDERS.columns}
    coded = df.select("o_orderkey", encode.padded_encode(columns, bounds).alias("v"))
    decoded = encode.padded_decode(F.col("v"), bounds, ORDERS.discretes)
    out = coded.select("o_orderkey", *[F.element_at("v", i + 1).alias(f"v{i}") for i in range(3)],
                       F.aggregate(F.slice("v", 4, 13), F.lit(0.0), lambda a, x: a + F.abs(x)).alias("padding"),
                       F.size("v").alias("cells"), *[c.alias(n) for n, c in decoded.items()])
    return rounded(out, o_totalprice=4)


@query("e10_table_encoding", f"""
WITH {ENDS}
SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo) * 2 - 1, 6) AS c0,
  CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS c1, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END AS c2,
  CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END AS c3, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS c4
FROM orders, ends""")
def e10(spark, sf):
    df = table(spark, sf, "orders")
    fitted = encode.fit_table(df, ORDERS, {"numerical": "minmax_norm"})
    coded = fitted.encode(df, ["o_orderkey"], keep=["o_orderkey"])
    return rounded(coded.select("o_orderkey", *[F.element_at("encoded", i + 1).alias(f"c{i}") for i in range(fitted.width)]))


@query("e10_table_decoding", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, o_orderstatus, o_orderpriority FROM orders")
def e10_decode(spark, sf):
    df = table(spark, sf, "orders")
    fitted = encode.fit_table(df, ORDERS, {"numerical": "minmax_norm"})
    return rounded(fitted.decode(fitted.encode(df, ["o_orderkey"], keep=["o_orderkey"]), keep=["o_orderkey"]), 4)


@query("e11_nearest_observed", f"""
WITH {sides_sql('orders')}, f AS (SELECT o_orderkey, o_totalprice + 0.4 AS v FROM fk), r AS (SELECT DISTINCT o_totalprice AS v FROM rl),
below AS (SELECT f.o_orderkey, f.v, r.v AS lo FROM f ASOF LEFT JOIN r ON f.v >= r.v),
nearest AS (SELECT b.o_orderkey, b.v, b.lo, r.v AS hi FROM below b ASOF LEFT JOIN r ON b.v <= r.v)
SELECT o_orderkey, CASE WHEN lo IS NULL OR (hi - v) < (v - lo) THEN coalesce(hi, lo) ELSE lo END AS o_totalprice FROM nearest""")
def e11(spark, sf):
    real, fake = sides(spark, sf, "orders")
    moved = fake.select("o_orderkey", (F.col("o_totalprice") + 0.4).alias("o_totalprice"))
    return encode.snap_to_observed(moved, real.select("o_totalprice"), ["o_totalprice"]).select("o_orderkey", "o_totalprice")


@query("e13_saved_encoders", f"""
WITH {ENDS} SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo) * 2 - 1, 6) AS scaled FROM orders, ends""")
def e13(spark, sf):
    df = table(spark, sf, "orders")
    path = scratch(spark, "encoders")
    encode.fit_table(df, ORDERS, {"numerical": "minmax_norm"}).save(spark, path)
    loaded = encode.TableEncoder.load(spark, path)
    coded = loaded.encode(df, ["o_orderkey"], keep=["o_orderkey"])
    return rounded(coded.select("o_orderkey", F.element_at("encoded", 1).alias("scaled")))
