"""Models, components and curves on inputs whose answer SQL can state: separable labels, closed forms, given predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemirror.operators import models, pca, plotdata
from tablemirror.operators.features import FeatureMaker
from tablemirror.operators.report import report_with_models
from tablemirror.operators.sample import split
from tablemirror.plans.fixtures import SEED, pair, sides, sides_sql
from tablemirror.plans.registry import query, rounded, scratch, table
from tablemirror.plans.utility_queries import DOCS, docs, four
from tablemirror.schema import CATEGORICAL, NUMERICAL, ORDINAL, TableMeta, TablePair
from tablemirror.sources import tables as sources

# ---------------------------------------------------------------- separable labels

RICH = TableMeta({"c_acctbal": NUMERICAL, "c_nationkey": ORDINAL, "rich": CATEGORICAL}, label="rich",
                 problem_type="binary_classification")
BAND = TableMeta({"c_acctbal": NUMERICAL, "band": CATEGORICAL}, label="band", problem_type="multiclass_classification")
CURVE = TableMeta({"c_acctbal": NUMERICAL, "y": NUMERICAL}, label="y", problem_type="regression")


def customers(spark, sf):
    balance = F.col("c_acctbal").cast("double")
    return table(spark, sf, "customer").select(
        "c_custkey", balance.alias("c_acctbal"), "c_nationkey", (balance > 4500).cast("int").alias("rich"),
        F.when(balance < 2500, "low").when(balance < 6000, "middle").otherwise("top").alias("band"),
        F.exp(1 + balance / 2000).alias("y"))


def names_sql(names, source="customer", where="TRUE"):
    values = ", ".join(f"('{n}')" for n in names)
    return f"SELECT name, count(*) AS \"rows\", TRUE AS right_enough FROM {source}, (VALUES {values}) AS v(name) WHERE {where} GROUP BY name"


@query("u1_u6_separable_label", names_sql(models.CLASSIFIERS))
def separable(spark, sf):
    """A label that one column decides: every classifier must find it."""
    df = customers(spark, sf)
    rows = FeatureMaker.fit(df, RICH).transform(df)
    seen = [models.fit_classifier(name, rows, SEED).transform(rows).agg(
        F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"),
        (F.avg((F.col("label") == F.col("prediction")).cast("double")) >= 0.95).alias("right_enough")) for name in models.CLASSIFIERS]
    return reduce(DataFrame.unionByName, seen)


@query("u7_forest_regressor_of_steps", names_sql(["random_forest_regr"], "lineitem"))
def steps(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", F.when(F.col("l_quantity") > 25, 10.0).otherwise(2.0).alias("y"))
    rows = FeatureMaker.fit(df, TableMeta({"l_quantity": NUMERICAL, "y": NUMERICAL}, label="y"), classes=False).transform(df)
    seen = models.fit_regressor("random_forest_regr", rows).transform(rows)
    return seen.agg(F.lit("random_forest_regr").alias("name"), F.count(F.lit(1)).alias("rows")).crossJoin(
        seen.agg(*models.score_columns(["r2"], F.col("label"), F.col("prediction")))).select(
        "name", "rows", (F.col("r2") >= 0.95).alias("right_enough"))


# The penalised least squares of one feature: weight = soft(cov, l1) / (var + l2 / sd(y)).
@query("u8_u10_penalised_closed_form", """
WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem),
r AS (SELECT (l_quantity - a) / (b - a) * 5 AS x, CAST(l_extendedprice AS DOUBLE) / 10000 AS y FROM lineitem, e),
m AS (SELECT count(*) AS n, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c, stddev_samp(y) AS sy FROM r),
p(name, l1, l2) AS (SELECT 'lasso', 1.0, 0.0 UNION ALL SELECT 'elastic_net', 0.5, 0.5 UNION ALL SELECT 'ridge', 0.0, CAST(1.0 AS DOUBLE) / n FROM m),
w AS (SELECT name, vx, vy, c, sign(c) * greatest(abs(c) - l1, 0) / (vx + l2 / sy) AS w FROM p, m)
SELECT name, round(sqrt(vy - 2 * w * c + w * w * vx), 3) AS rmse FROM w""")
def penalised(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_extendedprice").cast("double") / 10000).alias("y"))
    rows = FeatureMaker.fit(df, TableMeta({"l_quantity": NUMERICAL, "y": NUMERICAL}, label="y"), classes=False).transform(df)
    seen = [models.fit_regressor(name, rows).transform(rows).agg(
        F.lit(name).alias("name"), F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), 2))).alias("rmse"))
        for name in ("lasso", "elastic_net", "ridge")]
    return rounded(reduce(DataFrame.unionByName, seen), 3)


def _halves(spark, sf, meta):
    real, fake = split(customers(spark, sf), ["c_custkey"], 0.5, SEED)
    return TablePair(real, fake, meta), real


@query("u16_fake_to_real_separable", " UNION ALL ".join(
    f"SELECT '{n}' AS name, TRUE AS right_enough" for n in models.BINARY_MODELS))
def u16_separable(spark, sf):
    both, real = _halves(spark, sf, RICH)
    return models.fake_to_real(both, real, seed=SEED).select("name", ((F.col("accuracy") >= 0.95) & (F.col("f1") >= 0.95)).alias("right_enough"))


@query("u17_fake_to_real_bands", " UNION ALL ".join(f"SELECT '{n}' AS name, TRUE AS right_enough" for n in models.MULTICLASS_MODELS))
def u17_bands(spark, sf):
    both, real = _halves(spark, sf, BAND)
    return models.fake_to_real(both, real, seed=SEED).select("name", (F.col("accuracy") >= 0.9).alias("right_enough"))


@query("u18_fake_to_real_exponential", "SELECT 'linear_regression' AS name, 1.0 AS r2")
def u18_exponential(spark, sf):
    """The logarithm of the label is a line in the feature."""
    both, real = _halves(spark, sf, CURVE)
    return rounded(models.fake_to_real(both, real, seed=SEED), 4)


# ---------------------------------------------------------------- given predictions

def given(spark, sf):
    o = table(spark, sf, "orders")
    one = lambda origin, limit: o.select(     # noqa: E731
        F.lit("given").alias("model"), F.lit(origin).alias("trained_on"), "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 0, "real").otherwise("fake").alias("tested_on"),
        (F.col("o_orderstatus") == "F").cast("double").alias("label"), (F.col("o_totalprice") > limit).cast("double").alias("prediction"))
    return one("real", 150000).unionByName(one("fake", 200000))


def _scores_sql(side, where):
    y, p = "(o_orderstatus = 'F')", "(o_totalprice > lim)"
    count = lambda c: f"CAST(count(*) FILTER ({where} AND {c}) AS DOUBLE)"     # noqa: E731
    hit, right, n = count(f"{y} AND {p}"), count(f"{y} = {p}"), count("TRUE")
    return (f"round({right} / {n}, 6) AS accuracy_{side}, round({hit} / {count(y)}, 6) AS recall_score_{side}, "
            f"round({hit} / {count(p)}, 6) AS precision_score_{side}, round(2 * {hit} / ({count(y)} + {count(p)}), 6) AS f1_score_{side}, "
            f"round({right} / (2 * {n} - {right}), 6) AS jaccard_similarity_{side}")


@query("u12_scores_of_given_predictions", f"""
SELECT name, {_scores_sql('real', 'o_orderkey % 3 = 0')}, {_scores_sql('fake', 'o_orderkey % 3 <> 0')}
FROM orders, (VALUES ('given_real', 150000), ('given_fake', 200000)) AS v(name, lim) GROUP BY name""")
def u12_given(spark, sf):
    return rounded(models.grid_scores(given(spark, sf), models.CLASS_SCORES))


@query("u13_agreement_of_given_predictions", """
WITH s AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'real' ELSE 'fake' END AS tested_on,
  count(*) FILTER ((o_totalprice > 150000) = (o_totalprice > 200000)) AS hits, count(*) AS n FROM orders GROUP BY 1)
SELECT 'given' AS model, tested_on, round(CAST(hits AS DOUBLE) / (2 * n - hits), 6) AS jaccard FROM s""")
def u13_given(spark, sf):
    return rounded(models.prediction_agreement(given(spark, sf), ["o_orderkey"]))


# ---------------------------------------------------------------- components

TWO = TableMeta({"l_quantity": NUMERICAL, "l_discount": NUMERICAL})
EIGEN = """(SELECT (a + b + sqrt((a - b) * (a - b) + 4 * c * c)) / 2 AS first, (a + b - sqrt((a - b) * (a - b) + 4 * c * c)) / 2 AS second
  FROM (SELECT var_samp(l_quantity) AS a, var_samp(l_discount) AS b, covar_samp(l_quantity, l_discount) AS c FROM {0}))"""


def two_columns(spark, sf):
    real, fake = sides(spark, sf, "lineitem")
    return TablePair(real.select(*TWO.columns), fake.select(*TWO.columns), TWO)


@query("a10_variances_of_two_columns", f"""
WITH {sides_sql('lineitem')}, r AS {EIGEN.format('rl')}, f AS {EIGEN.format('fk')}
SELECT 0 AS component, round(r.first, 5) AS "real", round(f.first, 5) AS fake FROM r, f UNION ALL
SELECT 1, round(r.second, 5), round(f.second, 5) FROM r, f""")
def a10_two(spark, sf):
    return rounded(pca.pca_variances(two_columns(spark, sf)), 5)


@query("a10_similarity_of_two_columns", f"""
WITH {sides_sql('lineitem')}, r AS {EIGEN.format('rl')}, f AS {EIGEN.format('fk')}
SELECT round(1 - (abs((r.first - f.first) / r.first) + abs((r.second - f.second) / r.second)) / 2, 6) AS value FROM r, f""")
def a10_two_similarity(spark, sf):
    return rounded(pca.pca_similarity(two_columns(spark, sf)))


@query("a10_total_variance_of_embeddings", """
WITH x AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
c AS (SELECT a.i, b.i AS j, covar_samp(a.v, b.v) AS c FROM x AS a JOIN x AS b ON a.vec_id = b.vec_id GROUP BY 1, 2)
SELECT round(sum(c) FILTER (i = j), 5) AS total, round(sum(c * c), 5) AS squares FROM c""")
def a10_total(spark, sf):
    """All eigenvalues: their sum is the trace, the sum of their squares that of the matrix."""
    df = table(spark, sf, "embeddings")
    dims = df.select(F.max(F.size("embedding"))).first()[0]
    wide = df.select(*[F.element_at("embedding", i + 1).cast("double").alias(f"e{i}") for i in range(dims)])
    values = pca.explained_variance(wide, TableMeta({c: NUMERICAL for c in wide.columns}), dims)
    return rounded(spark.createDataFrame([(float(values.sum()), float((values ** 2).sum()))], "total double, squares double"), 5)


@query("v1_moments_of_pca_points", f"""
WITH {sides_sql('lineitem')}, r AS {EIGEN.format('rl')}, f AS {EIGEN.format('fk')}
SELECT 'Real' AS kind, (SELECT count(*) FROM rl) AS n, round(first, 5) AS var1, round(second, 5) AS var2, 0.0 AS cov, 0.0 AS mean1 FROM r UNION ALL
SELECT 'Fake', (SELECT count(*) FROM fk), round(first, 5), round(second, 5), 0.0, 0.0 FROM f""")
def v1_moments(spark, sf):
    real, fake = sides(spark, sf, "lineitem")
    points = plotdata.pca_points(TablePair(real, fake, TWO), ["l_orderkey"])
    near = lambda c: F.round(F.abs(c), 5)     # noqa: E731
    return rounded(points.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.var_samp("pc1").alias("var1"), F.var_samp("pc2").alias("var2"),
        near(F.covar_samp("pc1", "pc2")).alias("cov"), near(F.avg("pc1")).alias("mean1")), 5)


# ---------------------------------------------------------------- curves, sources, report

@query("v6_density_curve_points", f"""
WITH {sides_sql('events')}, b AS (SELECT 'Real' AS kind, value FROM rl UNION ALL SELECT 'Fake', value FROM fk),
e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 50 AS w FROM b),
h AS (SELECT kind, lo, w, CAST(least(floor((value - lo) / w), 49) AS INTEGER) AS bin, count(*) AS cnt FROM b, e GROUP BY ALL),
m AS (SELECT kind, cnt, lo + bin * w AS low, lo + (bin + 1) * w AS high, lo + (bin + 0.5) * w AS mid FROM h),
s AS (SELECT kind, sum(cnt) AS n, min(low) AS a, max(high) AS b,
  sqrt(greatest(sum(mid * mid * cnt) / sum(cnt) - pow(sum(mid * cnt) / sum(cnt), 2), 1e-12)) * pow(sum(cnt), -0.2) AS h FROM m GROUP BY kind),
x AS (SELECT s.*, a + (b - a) * i / 99 AS x FROM s, range(100) AS r(i))
SELECT kind, 'value' AS name, round(x, 4) AS x, round(sum(cnt * exp(-pow((x - mid) / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 6) AS density
FROM x JOIN m USING (kind) GROUP BY kind, x, n, h""")
def v6_points(spark, sf):
    return rounded(plotdata.density_curve(plotdata.histogram(pair(spark, sf, "events"), ["value"], 50)), 6, x=4)


@query("s5_csv_pair", f"""
WITH {sides_sql('part')} SELECT 'real' AS origin, p_size, p_retailprice, p_brand FROM rl UNION ALL SELECT 'fake', p_size, p_retailprice, p_brand FROM fk""")
def s5(spark, sf):
    """Two delimited files: the columns of fake stand in another order, and real has one more."""
    real, fake = sides(spark, sf, "part")
    a, b = scratch(spark, "real"), scratch(spark, "fake")
    real.select("p_size", "p_type", "p_retailprice", "p_brand").write.option("header", True).csv(a)
    fake.select("p_brand", "p_size", "p_retailprice").write.option("header", True).option("sep", "\t").csv(b)
    both = sources.read_csv_pair(spark, a, b, ",", "\t")
    return both.real.withColumn("origin", F.lit("real")).unionByName(both.fake.withColumn("origin", F.lit("fake")))


@query("a15_report_with_models")
def a15_models(spark, sf):
    """The whole report with all six classifiers: score rows, each with every scalar metric."""
    real_train, real_test, fake_train, fake_test = four(docs(spark, sf), "doc_id")
    _, scores = report_with_models(TablePair(real_train, fake_train, DOCS), TablePair(real_test, fake_test, DOCS), ["doc_id"], seed=SEED)
    return rounded(scores, 2)
