"""Real against fake: associations, statistics, distances, rows, components, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemirror.functions.scores import pairwise_rows
from tablemirror.operators import assoc, nearest, pca, rankpair, stats
from tablemirror.operators import report as reports
from tablemirror.operators.sample import equal_length
from tablemirror.plans.fixtures import LINEITEM, ORDERS, PART, SEED, h_sql, kept_pair, long_sql, pair, sides, sides_sql, u_sql
from tablemirror.plans.registry import query, rounded, table
from tablemirror.schema import TableMeta, TablePair

NUM, DISC = LINEITEM.numericals, LINEITEM.discretes


# ---------------------------------------------------------------- SQL of the measures

def corr_sql(source, columns):
    return " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS value FROM {source}"
                              for a in columns for b in columns if a != b)


def eta_sql(source, nominal, numeric):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS nominal, '{x}' AS numeric, sqrt(sum(n * (g - m) * (g - m)) / max(t)) AS value FROM "
        f"(SELECT {c} AS k, count({x}) AS n, avg({x}) AS g FROM {source} GROUP BY {c}), (SELECT avg({x}) AS m, var_pop({x}) * count({x}) AS t FROM {source})"
        for c in nominal for x in numeric)


def entropy_sql(source, by):
    return f"(SELECT ln(sum(c)) - sum(c * ln(c)) / sum(c) FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM {source} GROUP BY {by}))"


def theil_sql(source, columns):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, ({entropy_sql(source, a)} + {entropy_sql(source, b)} - {entropy_sql(source, f'{a}, {b}')}) / {entropy_sql(source, a)} AS value"
        for a in columns for b in columns if a != b)


def cramer_sql(source, columns, corrected):
    parts = []
    for a in columns:
        for b in columns:
            if a == b:
                continue
            base = (f"(SELECT sum(CAST(c AS DOUBLE) * c / (CAST(na AS DOUBLE) * nb)) - 1 AS phi2, max(n) AS n, max(ka) AS ka, max(kb) AS kb FROM "
                    f"(SELECT {a} AS a, {b} AS b, count(*) AS c FROM {source} GROUP BY ALL) "
                    f"JOIN (SELECT {a} AS a, count(*) AS na FROM {source} GROUP BY ALL) USING (a) JOIN (SELECT {b} AS b, count(*) AS nb FROM {source} GROUP BY ALL) USING (b), "
                    f"(SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT {a}) AS DOUBLE) AS ka, CAST(count(DISTINCT {b}) AS DOUBLE) AS kb FROM {source}))")
            if corrected:
                value = ("sqrt(greatest(0, phi2 - (ka - 1) * (kb - 1) / (n - 1)) / (least(ka - (ka - 1) * (ka - 1) / (n - 1), kb - (kb - 1) * (kb - 1) / (n - 1)) - 1))")
            else:
                value = "sqrt(greatest(0, phi2) / (least(ka, kb) - 1))"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {value} AS value FROM {base}")
    return " UNION ALL ".join(parts)


def assoc_sql(source, meta):
    eta = eta_sql(source, meta.discretes, meta.numericals)
    return " UNION ALL ".join(filter(None, [
        " UNION ALL ".join(f"SELECT '{c}' AS col_a, '{c}' AS col_b, 1.0 AS value" for c in meta.columns),
        corr_sql(source, meta.numericals), theil_sql(source, meta.discretes),
        f"SELECT nominal, numeric, value FROM ({eta})", f"SELECT numeric, nominal, value FROM ({eta})"]))


def diff_sql(meta):
    return (f"ar AS ({assoc_sql('rl', meta)}), af AS ({assoc_sql('fk', meta)}), "
            "d AS (SELECT col_a, col_b, ar.value AS \"real\", af.value AS fake, abs(ar.value - af.value) AS diff FROM ar JOIN af USING (col_a, col_b))")


# ---------------------------------------------------------------- associations

@query("a1_numeric_association", f"SELECT col_a, col_b, round(value, 6) AS value FROM ({corr_sql('lineitem', NUM)})")
def a1(spark, sf):
    return rounded(assoc.numeric_association(table(spark, sf, "lineitem"), NUM))


@query("a2_correlation_ratio", f"SELECT nominal, numeric, round(value, 6) AS value FROM ({eta_sql('lineitem', DISC, NUM)})")
def a2(spark, sf):
    return rounded(assoc.correlation_ratio(table(spark, sf, "lineitem"), DISC, NUM))


@query("a3_theils_u", f"SELECT col_a, col_b, round(value, 6) AS value FROM ({theil_sql('lineitem', DISC)})")
def a3(spark, sf):
    return rounded(assoc.theils_u(table(spark, sf, "lineitem"), DISC))


@query("a3_cramers_v_corrected", f"SELECT col_a, col_b, round(value, 6) AS value FROM ({cramer_sql('part', ['p_brand', 'p_type', 'p_size'], True)})")
def a3_cramer(spark, sf):
    return rounded(assoc.cramers_v(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"]))


@query("a3_cramers_v_plain", f"SELECT col_a, col_b, round(value, 6) AS value FROM ({cramer_sql('lineitem', DISC, False)})")
def a3_plain(spark, sf):
    return rounded(assoc.cramers_v(table(spark, sf, "lineitem"), DISC, bias_correction=False))


@query("a4_association_matrix", f"SELECT col_a, col_b, round(value, 6) AS value FROM ({assoc_sql('lineitem', LINEITEM)})")
def a4(spark, sf):
    return rounded(assoc.association_matrix(table(spark, sf, "lineitem"), LINEITEM))


@query("a5_association_distance", f"""
WITH {sides_sql('lineitem')}, {diff_sql(LINEITEM)},
m AS (SELECT avg(diff * diff) AS mse, avg(diff) AS mae, 1 - sum("real" * fake) / sqrt(sum("real" * "real") * sum(fake * fake)) AS cosine,
  corr("real", fake) FILTER (col_a <> col_b) AS pearsonr FROM d)
SELECT 'rmse' AS metric, round(sqrt(mse), 6) AS value FROM m UNION ALL SELECT 'mae', round(mae, 6) FROM m UNION ALL SELECT 'mse', round(mse, 6) FROM m
UNION ALL SELECT 'cosine', round(cosine, 6) FROM m UNION ALL SELECT 'pearsonr', round(pearsonr, 6) FROM m""")
def a5(spark, sf):
    return rounded(assoc.association_distance(assoc.association_difference(pair(spark, sf, "lineitem"))))


@query("a5_association_row_distance", f"""
WITH {sides_sql('lineitem')}, {diff_sql(LINEITEM)}
SELECT a.col_a AS row_a, b.col_a AS row_b, round(sqrt(sum((a."real" - b.fake) * (a."real" - b.fake))), 6) AS euclidean
FROM d a JOIN d b ON a.col_b = b.col_b GROUP BY ALL""")
def a5_rows(spark, sf):
    return rounded(assoc.association_row_distance(assoc.association_difference(pair(spark, sf, "lineitem"))))


PAIRWISE = f"""
WITH {sides_sql('lineitem')}, ar AS ({corr_sql('rl', NUM)}), af AS ({corr_sql('fk', NUM)})
SELECT ar.col_a AS row_a, af.col_a AS row_b, round(sqrt(sum((ar.value - af.value) * (ar.value - af.value))), 6) AS euclidean,
  round(sum(ar.value * af.value) / sqrt(sum(ar.value * ar.value) * sum(af.value * af.value)), 4) AS cosine_similarity
FROM ar JOIN af USING (col_b) GROUP BY ALL"""


@query("m11_m16_pairwise_rows", PAIRWISE)
def m11(spark, sf):
    both = pair(spark, sf, "lineitem")
    real, fake = assoc.numeric_association(both.real, NUM), assoc.numeric_association(both.fake, NUM)
    return rounded(pairwise_rows(real, fake, "col_a", "col_b", "value"), cosine_similarity=4)


# ---------------------------------------------------------------- rank pairing

def even_sql(name, key):
    return (f"{sides_sql(name)}, sz AS (SELECT least((SELECT count(*) FROM rl), (SELECT count(*) FROM fk)) AS n), "
            f"er AS (SELECT * FROM rl QUALIFY row_number() OVER (ORDER BY {h_sql(SEED, 'equal', key)}) <= (SELECT n FROM sz)), "
            f"ef AS (SELECT * FROM fk QUALIFY row_number() OVER (ORDER BY {h_sql(SEED, 'equal', key)}) <= (SELECT n FROM sz))")


def even_pair(spark, sf, name, key, meta=None, blank=None):
    real, fake = sides(spark, sf, name)
    if blank:
        real, fake = real.withColumns(blank), fake.withColumns(blank)
    meta = meta or ({"orders": ORDERS, "part": PART}[name] if name in ("orders", "part") else TableMeta({"value": "numerical", "event_type": "categorical"}))
    keyed = TableMeta({key: "ordinal", **meta.kinds})
    even = equal_length(TablePair(real, fake, keyed), [key], SEED)
    return TablePair(even.real.select(*meta.columns), even.fake.select(*meta.columns), meta)


def ranked_sql(meta):
    def paired(c):
        return (f"(SELECT x, y FROM (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) AS i FROM er) "
                f"JOIN (SELECT {c} AS y, row_number() OVER (ORDER BY {c}) AS i FROM ef) USING (i))")
    parts = [f"SELECT '{c}' AS name, corr(x, y) AS value FROM {paired(c)}" for c in meta.numericals]
    parts += [f"SELECT '{c}' AS name, ({entropy_sql(paired(c), 'x')} + {entropy_sql(paired(c), 'y')} - {entropy_sql(paired(c), 'x, y')}) / {entropy_sql(paired(c), 'x')} AS value"
              for c in meta.discretes]
    return " UNION ALL ".join(parts)


@query("a6_rank_paired_columns", f"WITH {even_sql('orders', 'o_orderkey')} SELECT name, round(value, 6) AS value FROM ({ranked_sql(ORDERS)})")
def a6(spark, sf):
    return rounded(rankpair.column_correlations(even_pair(spark, sf, "orders", "o_orderkey")))


@query("a6_rank_paired_mean", f"WITH {even_sql('part', 'p_partkey')} SELECT round(avg(value), 6) AS value FROM ({ranked_sql(PART)})")
def a6_mean(spark, sf):
    return rounded(rankpair.mean_column_correlation(even_pair(spark, sf, "part", "p_partkey")))


@query("a6_rank_paired_cramers_v")
def a6_cramer(spark, sf):
    return rounded(rankpair.column_correlations(even_pair(spark, sf, "orders", "o_orderkey"), nominal="cramer"))


# Integers as categories sort as integers; missing values sort last, numbers pair where both are known, a missing
# category is a category of its own. The blanks are a rule on the key; every row takes part.
INTEGERS = TableMeta({"o_custkey": "categorical", "o_totalprice": "numerical"})
BLANKS = {"o_totalprice": (10, 3), "o_orderpriority": (7, 2), "o_custkey": (11, 6)}
WITH_BLANKS = TableMeta({"o_totalprice": "numerical", "o_orderpriority": "categorical", "o_custkey": "categorical"})


def _blanked_even_sql():
    cols = ", ".join(f"CASE WHEN o_orderkey % {m} = {r} THEN NULL ELSE {c} END AS {c}" for c, (m, r) in BLANKS.items())
    u, h = u_sql(SEED, "split", "o_orderkey"), h_sql(SEED, "equal", "o_orderkey")
    return (f"o AS (SELECT o_orderkey, {cols} FROM orders), rl AS (SELECT * FROM o WHERE {u} < 0.5), fk AS (SELECT * FROM o WHERE {u} >= 0.5), "
            "sz AS (SELECT least((SELECT count(*) FROM rl), (SELECT count(*) FROM fk)) AS n), "
            f"er AS (SELECT * FROM rl QUALIFY row_number() OVER (ORDER BY {h}) <= (SELECT n FROM sz)), "
            f"ef AS (SELECT * FROM fk QUALIFY row_number() OVER (ORDER BY {h}) <= (SELECT n FROM sz))")


@query("a6_rank_paired_integers", f"WITH {even_sql('orders', 'o_orderkey')} SELECT name, round(value, 6) AS value FROM ({ranked_sql(INTEGERS)})")
def a6_integers(spark, sf):
    return rounded(rankpair.column_correlations(even_pair(spark, sf, "orders", "o_orderkey", INTEGERS)))


@query("a6_rank_paired_nulls", f"WITH {_blanked_even_sql()} SELECT name, round(value, 6) AS value FROM ({ranked_sql(WITH_BLANKS)})")
def a6_nulls(spark, sf):
    blank = {c: F.when(F.col("o_orderkey") % m == r, F.lit(None)).otherwise(F.col(c)) for c, (m, r) in BLANKS.items()}
    return rounded(rankpair.column_correlations(even_pair(spark, sf, "orders", "o_orderkey", WITH_BLANKS, blank)))


# ---------------------------------------------------------------- statistics

STAT_SQL = {"min": "min({c})", "max": "max({c})", "mean": "avg({c})", "median": "median({c})", "std": "stddev_samp({c})", "var": "var_samp({c})"}
DIGITS = {"var_real": 1, "var_fake": 1, "sum_diff": 1, "mean_real": 4, "mean_fake": 4, "std_real": 4, "std_fake": 4,
          "median_real": 4, "median_fake": 4}


def stats_sql(meta, rounded_=True):
    parts = []
    for c in meta.numericals:
        cells = []
        for s, f in STAT_SQL.items():
            for o, src in (("real", "rl"), ("fake", "fk")):
                e = f"(SELECT CAST({f.format(c=c)} AS DOUBLE) FROM {src})"
                cells.append(f"{e} AS {s}_{o}")
        parts.append(f"SELECT '{c}' AS name, {', '.join(cells)}")
    inner = " UNION ALL ".join(parts)
    total = " + ".join(f"abs({s}_real - {s}_fake)" for s in STAT_SQL)
    if not rounded_:
        return inner
    out = ", ".join(f"round({s}_{o}, {DIGITS.get(f'{s}_{o}', 6)}) AS {s}_{o}" for s in STAT_SQL for o in ("real", "fake"))
    return f"SELECT name, {out}, round({total}, 1) AS sum_diff FROM ({inner})"


@query("a7_numeric_statistics", f"WITH {sides_sql('lineitem')} {stats_sql(LINEITEM)}")
def a7(spark, sf):
    return rounded(stats.numeric_statistics(pair(spark, sf, "lineitem")), 6, **DIGITS)


def top_sql(source, origin, columns):
    return (f"SELECT name, count(*) AS unique_{origin}, arg_min(value, -cnt * 1000000 + rk) AS top_{origin}, max(cnt) AS freq_{origin} FROM "
            f"(SELECT *, row_number() OVER (PARTITION BY name ORDER BY value) AS rk FROM (SELECT name, value, count(*) AS cnt FROM ({long_sql(source, columns, 'VARCHAR')}) GROUP BY ALL)) GROUP BY name")


@query("a8_categorical_statistics", f"""
WITH {sides_sql('lineitem')} SELECT *, freq_real - freq_fake AS freq_diff FROM ({top_sql('rl', 'real', DISC)}) JOIN ({top_sql('fk', 'fake', DISC)}) USING (name)""")
def a8(spark, sf):
    return stats.categorical_statistics(pair(spark, sf, "lineitem"))


def similarity_sql(meta):
    nums = " UNION ALL ".join(f"SELECT {s}_real AS r, {s}_fake AS f FROM n" for s in STAT_SQL)
    fitted = [c for c in meta.discretes if c not in meta.vocabularies]
    codes = f"SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) - 1 AS code FROM (SELECT DISTINCT name, value FROM ({long_sql('rl', fitted, 'VARCHAR')}))"
    if meta.vocabularies:
        codes += " UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', '{v}', {i}" for c, vs in meta.vocabularies.items() for i, v in enumerate(vs))
    ranks = "(SELECT rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS a, rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2.0 AS b FROM {})"
    p, q = len(meta.numericals), len(meta.discretes)
    return f"""n AS ({stats_sql(meta, False)}), nv AS ({nums}), codes AS ({codes}),
c AS (SELECT * FROM ({top_sql('rl', 'real', meta.discretes)}) JOIN ({top_sql('fk', 'fake', meta.discretes)}) USING (name)),
cv AS (SELECT CAST(unique_real AS DOUBLE) AS r, CAST(unique_fake AS DOUBLE) AS f FROM c UNION ALL SELECT freq_real, freq_fake FROM c
  UNION ALL SELECT a.code, b.code FROM c JOIN codes a ON a.name = c.name AND a.value = top_real JOIN codes b ON b.name = c.name AND b.value = top_fake),
sim AS (SELECT ({p} * (SELECT corr(a, b) FROM {ranks.format('nv')}) + {q} * (SELECT corr(a, b) FROM {ranks.format('cv')})) / {p + q} AS value)"""


@query("a9_statistical_similarity", f"WITH {sides_sql('lineitem')}, {similarity_sql(LINEITEM)} SELECT round(value, 6) AS value FROM sim")
def a9(spark, sf):
    return rounded(stats.statistical_similarity(pair(spark, sf, "lineitem")))


GIVEN_FLAGS = TableMeta(LINEITEM.kinds, {"l_returnflag": ["N", "R", "A"], "l_linestatus": ["O", "F"]})


@query("a9_statistical_similarity_given_vocabulary", f"WITH {sides_sql('lineitem')}, {similarity_sql(GIVEN_FLAGS)} SELECT round(value, 6) AS value FROM sim")
def a9_given(spark, sf):
    both = pair(spark, sf, "lineitem")
    return rounded(stats.statistical_similarity(TablePair(both.real, both.fake, GIVEN_FLAGS)))


@query("a9_statistical_similarity_mape", f"""
WITH {sides_sql('lineitem')}, {similarity_sql(LINEITEM)}
SELECT round((4 * (1 - (SELECT avg(abs((r - f) / r)) FROM nv WHERE r <> 0)) + 3 * (1 - (SELECT avg(abs((r - f) / r)) FROM cv WHERE r <> 0))) / 7, 6) AS value""")
def a9_mape(spark, sf):
    return rounded(stats.statistical_similarity(pair(spark, sf, "lineitem"), method="mape"))


# ---------------------------------------------------------------- components

def cov_sql(source, exprs):
    names = list(exprs)
    return " UNION ALL ".join(f"SELECT '{names[i]}' AS col_a, '{names[j]}' AS col_b, covar_samp({exprs[names[i]]}, {exprs[names[j]]}) AS value FROM {source}"
                              for i in range(len(names)) for j in range(i, len(names)))


ORDER_CODES = {"o_orderpriority_1": "CAST(o_orderpriority = '1-URGENT' AS DOUBLE)", "o_orderstatus_F": "CAST(o_orderstatus = 'F' AS DOUBLE)",
               "o_totalprice": "o_totalprice"}


@query("a10_covariance", f"SELECT col_a, col_b, round(value, 3) AS value FROM ({cov_sql('orders', ORDER_CODES)})")
def a10_covariance(spark, sf):
    df = table(spark, sf, "orders").select(
        (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("o_orderpriority_1"),
        (F.col("o_orderstatus") == "F").cast("double").alias("o_orderstatus_F"), "o_totalprice")
    return rounded(pca.covariance_long(df, list(ORDER_CODES)), 3)


@query("a10_pca_variances")
def a10(spark, sf):
    return rounded(pca.pca_variances(pair(spark, sf, "lineitem")), 5, real=4, fake=4)


@query("a10_pca_similarity")
def a10_similarity(spark, sf):
    return rounded(pca.pca_similarity(pair(spark, sf, "lineitem")))


@query("a10_pca_embeddings")
def a10_embeddings(spark, sf):
    df = table(spark, sf, "embeddings")
    dims = df.select(F.size("embedding")).first()[0]
    wide = df.select(*[F.element_at("embedding", i + 1).cast("double").alias(f"e{i}") for i in range(dims)])
    meta = TableMeta({c: "numerical" for c in wide.columns})
    values = pca.explained_variance(wide, meta, 5)
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "component int, variance double"), 5)


# ---------------------------------------------------------------- distances

CODES = ", ".join(f"dense_rank() OVER (ORDER BY {c}) AS k_{c}" for c in ORDERS.discretes)
RECORD = """
WITH {sides}, c AS (SELECT o_orderkey, o_totalprice, {codes} FROM orders),
r AS (SELECT c.* FROM c JOIN rl USING (o_orderkey)), s AS (SELECT stddev_pop(o_totalprice) + 1e-6 AS sd, count(*) // 2 AS n FROM rl),
f AS (SELECT c.* FROM c JOIN fk USING (o_orderkey) QUALIFY row_number() OVER (ORDER BY {h}) <= (SELECT n FROM s)),
b AS (SELECT f.o_orderkey, min(pow((r.o_totalprice - f.o_totalprice) / 2 / sd, 2) + CAST(r.k_o_orderstatus {op} f.k_o_orderstatus AS INTEGER)
  + CAST(r.k_o_orderpriority {op} f.k_o_orderpriority AS INTEGER)) AS d FROM f, r, s GROUP BY f.o_orderkey)
SELECT round(avg(sqrt(d)), 6) AS record_distance FROM b"""


def _keyed_orders(spark, sf):
    real, fake = sides(spark, sf, "orders")
    keep = ["o_orderkey", *ORDERS.columns]
    return TablePair(real.select(*keep), fake.select(*keep), ORDERS)


@query("a11_record_distance", RECORD.format(sides=sides_sql("orders"), codes=CODES, h=h_sql(SEED, "record", "o_orderkey"), op=">"))
def a11(spark, sf):
    return rounded(nearest.record_distance(reports.coded(_keyed_orders(spark, sf)), key=["o_orderkey"], seed=SEED))


@query("a11_record_distance_any", RECORD.format(sides=sides_sql("orders"), codes=CODES, h=h_sql(SEED, "record", "o_orderkey"), op="<>"))
def a11_any(spark, sf):
    return rounded(nearest.record_distance(_keyed_orders(spark, sf), mismatch="any", key=["o_orderkey"], seed=SEED))


# Orders with missing values: a rule on the key blanks prices, statuses and priorities; every row takes part.
GAPS = {"o_totalprice": (10, 3), "o_orderstatus": (9, 4), "o_orderpriority": (7, 2)}
GAPPED = ", ".join(f"CASE WHEN o_orderkey % {m} = {r} THEN NULL ELSE {c} END AS {c}" for c, (m, r) in GAPS.items())
RECORD_GAPS = """
WITH o AS (SELECT o_orderkey, {gapped} FROM orders), rl AS (SELECT * FROM o WHERE {u} < 0.5), fk AS (SELECT * FROM o WHERE {u} >= 0.5),
c AS (SELECT o_orderkey, o_totalprice, {codes} FROM o),
r AS (SELECT c.* FROM c JOIN rl USING (o_orderkey)),
s AS (SELECT stddev_pop(o_totalprice) + 1e-6 AS sd, avg(o_totalprice) AS m, (SELECT count(*) FROM rl) // 2 AS n FROM rl),
f AS (SELECT c.* FROM c JOIN fk USING (o_orderkey) QUALIFY row_number() OVER (ORDER BY {h}) <= (SELECT n FROM s)),
b AS (SELECT f.o_orderkey, min(pow((coalesce(r.o_totalprice, m) - coalesce(f.o_totalprice, m)) / 2 / sd, 2)
  + CAST((r.o_totalprice IS NULL) <> (f.o_totalprice IS NULL) AS INTEGER)
  + CAST({cmp_status} AS INTEGER) + CAST({cmp_priority} AS INTEGER)) AS d FROM f, r, s GROUP BY f.o_orderkey)
SELECT round(avg(sqrt(d)), 6) AS record_distance FROM b"""
GAP_CODES = ", ".join(f"CASE WHEN {c} IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) END AS k_{c}"
                      for c in ORDERS.discretes)
GAP_NAMES = ", ".join(f"{c} AS k_{c}" for c in ORDERS.discretes)


def _gapped_orders(spark, sf):
    real, fake = sides(spark, sf, "orders")
    blank = {c: F.when(F.col("o_orderkey") % m == r, F.lit(None)).otherwise(F.col(c)) for c, (m, r) in GAPS.items()}
    keep = ["o_orderkey", *ORDERS.columns]
    return TablePair(real.withColumns(blank).select(*keep), fake.withColumns(blank).select(*keep), ORDERS)


@query("a11_record_distance_nulls", RECORD_GAPS.format(
    gapped=GAPPED, u=u_sql(SEED, "split", "o_orderkey"), codes=GAP_CODES, h=h_sql(SEED, "record", "o_orderkey"),
    cmp_status="r.k_o_orderstatus > f.k_o_orderstatus", cmp_priority="r.k_o_orderpriority > f.k_o_orderpriority"))
def a11_nulls(spark, sf):
    return rounded(nearest.record_distance(reports.coded(_gapped_orders(spark, sf)), key=["o_orderkey"], seed=SEED))


@query("a11_record_distance_any_nulls", RECORD_GAPS.format(
    gapped=GAPPED, u=u_sql(SEED, "split", "o_orderkey"), codes=GAP_NAMES, h=h_sql(SEED, "record", "o_orderkey"),
    cmp_status="r.k_o_orderstatus IS DISTINCT FROM f.k_o_orderstatus",
    cmp_priority="r.k_o_orderpriority IS DISTINCT FROM f.k_o_orderpriority"))
def a11_any_nulls(spark, sf):
    return rounded(nearest.record_distance(_gapped_orders(spark, sf), mismatch="any", key=["o_orderkey"], seed=SEED))


@query("a11_record_distance_lineitem")
def a11_lineitem(spark, sf):
    return rounded(nearest.record_distance(reports.coded(kept_pair(spark, sf, "lineitem")), seed=SEED))


def _hot_sql(source):
    cells = ", ".join(f"CAST({c} = '{v}' AS DOUBLE) AS h{i}" for i, (c, v) in enumerate(
        [("o_orderstatus", v) for v in "FOP"] + [("o_orderpriority", p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]))
    return f"SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER () AS z, {cells} FROM {source}"


NEIGHBOUR = f"""WITH {sides_sql('orders')}, r AS ({_hot_sql('rl')}), f AS ({_hot_sql('fk')}),
b AS (SELECT r.o_orderkey, sqrt(min(pow(r.z - f.z, 2) + {' + '.join(f'pow(r.h{i} - f.h{i}, 2)' for i in range(8))})) AS d FROM r, f GROUP BY r.o_orderkey)
SELECT round(avg(d), 6) AS neighbor_mean, round(stddev_pop(d), 6) AS neighbor_std FROM b"""


@query("a12_nearest_neighbour", NEIGHBOUR)
def a12(spark, sf):
    return rounded(nearest.neighbour_distance(pair(spark, sf, "orders")))


@query("a12_nearest_neighbour_lineitem")
def a12_lineitem(spark, sf):
    return rounded(nearest.neighbour_distance(pair(spark, sf, "lineitem")))


@query("a12_nearest_embeddings", f"""
WITH v AS (SELECT vec_id, embedding, {u_sql(SEED, 'split', 'vec_id')} < 0.5 AS is_real FROM embeddings)
SELECT r.vec_id, round(min(list_distance(CAST(r.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[]))), 6) AS distance
FROM v r, v f WHERE r.is_real AND NOT f.is_real GROUP BY r.vec_id""")
def a12_embeddings(spark, sf):
    from tablemirror.operators.sample import split
    real, fake = split(table(spark, sf, "embeddings"), ["vec_id"], 0.5, SEED)
    vec = F.col("embedding").cast("array<double>").alias("vec")
    none = F.array().cast("array<int>").alias("codes")
    found = nearest.nearest_costs(real.select(vec, none), fake.select(vec, none))
    ids = real.select("vec_id", vec)
    return rounded(ids.join(found, "vec").select("vec_id", F.sqrt("best").alias("distance")))


# ---------------------------------------------------------------- rows

COPIED = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("a13_copied_rows", f"""
WITH {sides_sql('lineitem')} SELECT {', '.join(COPIED)}, count(*) AS copies FROM fk
WHERE EXISTS (SELECT 1 FROM rl WHERE {' AND '.join(f'rl.{c} = fk.{c}' for c in COPIED)}) GROUP BY ALL""")
def a13(spark, sf):
    return stats.copied_rows(pair(spark, sf, "lineitem").select(*COPIED))


@query("a13_copied_row_count", f"""
WITH {sides_sql('lineitem')} SELECT CAST(count(*) AS BIGINT) AS copied FROM fk
WHERE EXISTS (SELECT 1 FROM rl WHERE {' AND '.join(f'rl.{c} = fk.{c}' for c in COPIED)})""")
def a13_count(spark, sf):
    return stats.copied_row_count(pair(spark, sf, "lineitem").select(*COPIED))


@query("a13_copied_rows_expanded", f"""
WITH {sides_sql('lineitem')} SELECT {', '.join(COPIED)} FROM fk
WHERE EXISTS (SELECT 1 FROM rl WHERE {' AND '.join(f'rl.{c} = fk.{c}' for c in COPIED)})""")
def a13_expanded(spark, sf):
    return stats.copied_rows_expanded(pair(spark, sf, "lineitem").select(*COPIED))


def _dup_sql(source):
    return f"(SELECT CAST(coalesce(sum(c), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM {source} GROUP BY {', '.join(COPIED)}) WHERE c > 1)"


@query("a14_duplicate_rows", f"WITH {sides_sql('lineitem')} SELECT {_dup_sql('rl')} AS duplicate_real, {_dup_sql('fk')} AS duplicate_fake")
def a14(spark, sf):
    return stats.duplicate_rows(pair(spark, sf, "lineitem").select(*COPIED))


# ---------------------------------------------------------------- report

@query("a15_report")
def a15(spark, sf):
    return rounded(reports.report(pair(spark, sf, "orders"), seed=SEED), 4)


@query("a15_report_lineitem")
def a15_lineitem(spark, sf):
    return rounded(reports.report(pair(spark, sf, "lineitem"), seed=SEED), 4)


def _dup2(source, columns):
    return f"(SELECT CAST(coalesce(sum(c), 0) AS DOUBLE) FROM (SELECT count(*) AS c FROM {source} GROUP BY {', '.join(columns)}) WHERE c > 1)"


@query("a15_miscellaneous", f"""
WITH {sides_sql('orders')}, {diff_sql(ORDERS)}, a AS (SELECT sqrt(avg(diff * diff)) AS rmse, avg(diff) AS mae, corr("real", fake) FILTER (col_a <> col_b) AS pr FROM d)
SELECT 'miscellaneous' AS section, 'RMSE_Column_Correlation' AS metric, round(rmse, 6) AS value FROM a UNION ALL
SELECT 'miscellaneous', 'MAE_Column_Correlation', round(mae, 6) FROM a UNION ALL SELECT 'miscellaneous', 'PEARSONR_Column_Correlation', round(pr, 6) FROM a UNION ALL
SELECT 'miscellaneous', 'Record_Distance', record_distance FROM ({RECORD.format(sides=sides_sql('orders'), codes=CODES, h=h_sql(SEED, 'record', 'o_orderkey'), op='>')}) UNION ALL
SELECT 'miscellaneous', 'Neighbor_Mean', neighbor_mean FROM ({NEIGHBOUR}) UNION ALL SELECT 'miscellaneous', 'Neighbor_Std', neighbor_std FROM ({NEIGHBOUR}) UNION ALL
SELECT 'miscellaneous', 'Duplicate_Real', {_dup2('rl', ORDERS.columns)} UNION ALL SELECT 'miscellaneous', 'Duplicate_Fake', {_dup2('fk', ORDERS.columns)}""")
def a15_miscellaneous(spark, sf):
    keyed = _keyed_orders(spark, sf)
    return rounded(reports.miscellaneous(keyed, key=["o_orderkey"], seed=SEED))


@query("a15_scores_with_metrics")
def a15_scores(spark, sf):
    both = pair(spark, sf, "orders")
    scores = both.real.groupBy(F.col("o_orderstatus").alias("name")).agg(F.avg("o_totalprice").alias("mean_price"))
    return rounded(reports.with_scores(scores, reports.miscellaneous(both, seed=SEED, distances=False)), 4)


# ---------------------------------------------------------------- wide tables with NULLs

WIDE = {f"c{i}": f"CASE WHEN (l_orderkey + {i}) % {i + 4} <> 0 THEN CAST((CAST(l_quantity AS BIGINT) * {2 * i + 3} + l_linenumber * {i}) % 31 AS DOUBLE) END"
        for i in range(25)}
WIDE_SQL = f"w AS (SELECT {', '.join(f'{e} AS {c}' for c, e in WIDE.items())} FROM lineitem)"


def wide(spark, sf):
    """The columns of ``WIDE``, as one array expression: as 25 of them they are a method too large for the JVM to compile."""
    cells = F.expr("transform(sequence(0, 24), i -> CASE WHEN (l_orderkey + i) % (i + 4) <> 0 THEN "
                   "CAST((CAST(l_quantity AS BIGINT) * (2 * i + 3) + l_linenumber * i) % 31 AS DOUBLE) END)")
    rows = table(spark, sf, "lineitem").select(cells.alias("cells"))
    return rows.select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(WIDE)])


@query("a1_wide_with_nulls", f"WITH {WIDE_SQL} SELECT col_a, col_b, round(value, 6) AS value FROM ({corr_sql('w', list(WIDE))})")
def a1_wide(spark, sf):
    """Every pair over the rows where both are known, at any number of columns."""
    return rounded(assoc.numeric_association(wide(spark, sf), list(WIDE)))


@query("a10_covariance_with_nulls", f"WITH {WIDE_SQL} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(covar_samp({a}, {b}), 6) AS value FROM w" for a in WIDE for b in WIDE) + ")")
def a10_wide(spark, sf):
    cov = pca.moments(wide(spark, sf), list(WIDE))[1]
    rows = [(a, b, float(cov[i, j])) for i, a in enumerate(WIDE) for j, b in enumerate(WIDE)]
    return rounded(spark.createDataFrame(rows, "col_a string, col_b string, value double"))
