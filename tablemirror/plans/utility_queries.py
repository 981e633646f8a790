"""Features, model grids and likelihoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemirror.operators import likelihood, models
from tablemirror.operators.features import FeatureMaker
from tablemirror.operators.sample import split
from tablemirror.plans.fixtures import SEED, sides, sides_sql, u_sql
from tablemirror.plans.registry import query, rounded, table
from tablemirror.plans.sample_queries import NET, NET_BLANKS, blanked_lineitem
from tablemirror.schema import CATEGORICAL, NUMERICAL, ORDINAL, TableMeta, TablePair

DOCS = TableMeta({"n_chars": NUMERICAL, "lang": CATEGORICAL, "source": ORDINAL, "toxic": CATEGORICAL, "quality": CATEGORICAL},
                 label="quality", problem_type="binary_classification")
VECTORS = TableMeta({**{f"e{i}": NUMERICAL for i in range(64)}, "label": CATEGORICAL}, label="label",
                    problem_type="multiclass_classification")
PRICES = TableMeta({"l_quantity": NUMERICAL, "l_discount": NUMERICAL, "l_linenumber": ORDINAL, "l_extendedprice": NUMERICAL},
                   label="l_extendedprice", problem_type="regression")
FLAGS = TableMeta({"l_quantity": NUMERICAL, "l_extendedprice": NUMERICAL, "l_discount": NUMERICAL, "l_tax": NUMERICAL,
                   "l_linenumber": ORDINAL, "l_linestatus": CATEGORICAL}, label="l_linestatus", problem_type="binary_classification")
LANGS = ["de", "en", "es", "fr"]


def docs(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").drop("text"), "doc_id")


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(f"e{i}") for i in range(64)], "label")


def line_key():
    """Row key of lineitem for matching predictions of one table."""
    return F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate").alias("row_id")


def four(df, key):
    """Real and fake, each divided 80/20."""
    real, fake = split(df, [key], 0.5, SEED)
    return [*split(real, [key], 0.8, SEED + 1), *split(fake, [key], 0.8, SEED + 1)]


@query("f1_feature_maker", f"""
WITH d AS (SELECT * FROM labels JOIN documents USING (doc_id)), e AS (SELECT CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi FROM d)
SELECT doc_id, round(CASE WHEN lo >= 0 AND hi >= 1000 THEN ln(greatest(n_chars, 0.01)) ELSE (n_chars - lo) / (hi - lo) * 5 END, 6) AS n_chars,
  {', '.join(f"CASE WHEN lang = '{v}' THEN 1.0 ELSE 0.0 END AS lang_{v}" for v in LANGS)},
  dense_rank() OVER (ORDER BY source) - 1.0 AS source, CAST(toxic AS DOUBLE) AS toxic, CAST(quality AS DOUBLE) AS label FROM d, e""")
def f1(spark, sf):
    df = docs(spark, sf)
    flat = FeatureMaker.fit(df, DOCS).flat(df, keep=["doc_id"])
    return rounded(flat.toDF(*[c.replace("=", "_") for c in flat.columns]))


@query("f1_transform_rows", """
WITH d AS (SELECT * FROM labels JOIN documents USING (doc_id)), k AS (SELECT lang, dense_rank() OVER (ORDER BY lang) - 1.0 AS code FROM d WHERE lang <> 'de' GROUP BY lang)
SELECT coalesce(code, -1.0) AS label, count(*) AS n FROM d LEFT JOIN k USING (lang) GROUP BY 1""")
def f1_rows(spark, sf):
    """Missing numbers and a label that the fitted table never has: every row comes through, the label as -1."""
    df = docs(spark, sf).withColumn("n_chars", F.when(F.col("n_chars") % 7 != 0, F.col("n_chars")))
    meta = TableMeta({"n_chars": NUMERICAL, "source": ORDINAL, "lang": CATEGORICAL}, label="lang")
    made = FeatureMaker.fit(df.filter("lang <> 'de'"), meta).transform(df)
    return made.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("f1_feature_maker_lineitem", """
WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_discount) AS c, max(l_discount) AS d FROM lineitem)
SELECT l_orderkey, round((l_quantity - a) / (b - a) * 5, 6) AS l_quantity, round(ln(greatest(l_extendedprice, 0.01)), 6) AS l_extendedprice,
  round((l_discount - c) / (d - c) * 5, 6) AS l_discount, CAST(l_linenumber - 1 AS DOUBLE) AS l_linenumber,
  CASE WHEN l_linestatus = 'F' THEN 0.0 ELSE 1.0 END AS label FROM lineitem, e""")
def f1_lineitem(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(FeatureMaker.fit(df, FLAGS.without("l_tax")).flat(df, keep=["l_orderkey"]))


def _classifier(name, model, **params):
    @query(name)
    def run(spark, sf):
        df = table(spark, sf, "lineitem").withColumn("row_id", line_key())
        train, test = split(df, ["l_orderkey"], 0.8, SEED)
        maker = FeatureMaker.fit(df, FLAGS)
        fitted = models.fit_classifier(model, maker.transform(train), SEED, **params)
        seen = fitted.transform(maker.transform(test))
        return rounded(seen.agg(*models.score_columns(models.CLASS_SCORES, F.col("label"), F.col("prediction")),
                                F.count(F.lit(1)).alias("rows")), 2)


_classifier("u1_logistic_regression", "logistic_regression")
_classifier("u2_random_forest", "random_forest")
_classifier("u3_decision_tree", "decision_tree")
_classifier("u4_mlp", "mlp")
_classifier("u5_adaboost", "adaboost")
_classifier("u6_gradient_boosting", "xgboost")


def _regressor(name, model):
    @query(name)
    def run(spark, sf):
        df = table(spark, sf, "lineitem")
        train, test = split(df, ["l_orderkey"], 0.8, SEED)
        maker = FeatureMaker.fit(df, PRICES, classes=False)
        fitted = models.fit_regressor(model, maker.transform(train), SEED)
        seen = fitted.transform(maker.transform(test))
        return rounded(seen.agg(*models.score_columns(["rmse", "mae", "r2"], F.col("label"), F.col("prediction"))), 2)


_regressor("u7_random_forest_regressor", "random_forest_regr")
_regressor("u8_lasso", "lasso")
_regressor("u9_ridge", "ridge")
_regressor("u10_elastic_net", "elastic_net")


@query("u11_linear_regression", """
WITH r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS icept FROM lineitem)
SELECT round(sqrt(avg(pow(l_extendedprice - icept - slope * l_quantity, 2))), 2) AS rmse, round(avg(icept + slope * l_quantity), 2) AS mean_prediction FROM lineitem, r""")
def u11(spark, sf):
    meta = TableMeta({"l_quantity": NUMERICAL, "l_extendedprice": NUMERICAL}, label="l_extendedprice")
    df = table(spark, sf, "lineitem")
    rows = FeatureMaker.fit(df, meta, classes=False).transform(df)
    seen = models.fit_regressor("linear_regression", rows).transform(rows)
    return rounded(seen.agg(F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), 2))).alias("rmse"),
                            F.avg("prediction").alias("mean_prediction")), 2)


GRID_MODELS = ["logistic_regression", "decision_tree", "random_forest"]
GRID_PARAMS: dict = {}


def docs_grid(spark, sf):
    parts = four(docs(spark, sf), "doc_id")
    return models.utility_grid(parts[0], parts[1], parts[2], parts[3], DOCS, GRID_MODELS, ["doc_id"], params=GRID_PARAMS, seed=SEED)


@query("u12_cross_evaluation")
def u12(spark, sf):
    return rounded(models.grid_scores(docs_grid(spark, sf), models.CLASS_SCORES), 2)


@query("u12_cross_evaluation_lineitem")
def u12_lineitem(spark, sf):
    parts = four(table(spark, sf, "lineitem").withColumn("row_id", line_key()), "l_orderkey")
    seen = models.utility_grid(parts[0], parts[1], parts[2], parts[3], FLAGS, ["logistic_regression", "random_forest"], ["row_id"],
                               params=GRID_PARAMS, seed=SEED)
    return rounded(models.grid_scores(seen, models.CLASS_SCORES), 2)


@query("u13_prediction_agreement")
def u13(spark, sf):
    return rounded(models.prediction_agreement(docs_grid(spark, sf), ["doc_id"]), 2)


SCORE_TABLE = """SELECT concat(l_returnflag, l_linenumber) AS name, avg(l_discount) AS a_real, avg(l_tax) AS a_fake,
  avg(l_quantity) / 50 AS b_real, avg(l_extendedprice) / 100000 AS b_fake FROM lineitem GROUP BY 1"""


@query("u14_utility_score", f"""
SELECT round(1 - (avg(abs((a_real - a_fake) / a_real)) + avg(abs((b_real - b_fake) / b_real))) / 2, 6) AS utility FROM ({SCORE_TABLE})""")
def u14(spark, sf):
    scores = table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linenumber").alias("name")).agg(
        F.avg("l_discount").alias("a_real"), F.avg("l_tax").alias("a_fake"), (F.avg("l_quantity") / 50).alias("b_real"),
        (F.avg("l_extendedprice") / 100000).alias("b_fake"))
    return rounded(models.utility_score(scores, ["a", "b"]))


@query("u15_regression_grid")
def u15(spark, sf):
    parts = four(table(spark, sf, "lineitem").withColumn("row_id", line_key()), "l_orderkey")
    seen = models.utility_grid(parts[0], parts[1], parts[2], parts[3], PRICES, ["random_forest_regr", "ridge"], ["row_id"], task="regression", seed=SEED)
    scores = models.grid_scores(seen, models.REGRESSION_SCORES)
    # The original score of a regression grid is the constant 0; the MAPE version stands beside it.
    extra = models.utility_score(scores, models.REGRESSION_SCORES).withColumn("constant_score", F.lit(0.0))
    return rounded(scores.crossJoin(F.broadcast(extra)), 2)


@query("u16_fake_to_real_binary")
def u16(spark, sf):
    real, fake = split(docs(spark, sf), ["doc_id"], 0.5, SEED)
    return rounded(models.fake_to_real(TablePair(real, fake, DOCS), real), 2)


@query("u17_fake_to_real_multiclass")
def u17(spark, sf):
    real, fake = split(vectors(spark, sf), ["vec_id"], 0.5, SEED)
    return rounded(models.fake_to_real(TablePair(real, fake, VECTORS), real), 2)


@query("u18_fake_to_real_regression")
def u18(spark, sf):
    real, fake = sides(spark, sf, "lineitem")
    return rounded(models.fake_to_real(TablePair(real, fake, PRICES), real), 4)


@query("u19_constant_label_guard", f"""
WITH d AS (SELECT *, {u_sql(SEED, 'split', 'doc_id')} < 0.5 AS is_real FROM labels JOIN documents USING (doc_id))
SELECT 'decision_tree' AS name, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(2 * avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) / (1 + avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END)), 6) AS f1 FROM d WHERE is_real""")
def u19(spark, sf):
    """Fake rows with a single label predict that label."""
    real, fake = split(docs(spark, sf), ["doc_id"], 0.5, SEED)
    one = fake.filter(F.col("quality") == 1)
    return rounded(models.fake_to_real(TablePair(real, one, DOCS), real, ["decision_tree"]))


@query("b1_mixture_likelihood")
def b1(spark, sf):
    real, fake = sides(spark, sf, "lineitem")
    return rounded(likelihood.mixture_likelihood(fake, real, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], (10, 30)), 1)


def _net(source, alias):
    a = f"(SELECT l_linestatus, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM {source}) AS p0 FROM {source} GROUP BY 1)"
    b = f"(SELECT l_linestatus, l_returnflag, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY l_linestatus) AS p1 FROM {source} GROUP BY 1, 2)"
    c = f"(SELECT l_returnflag, l_linenumber, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS p2 FROM {source} GROUP BY 1, 2)"
    return lambda rows: (f"(SELECT avg(ln(coalesce(p0, 0) * coalesce(p1, 0) * coalesce(p2, 0) + 1e-8)) FROM {rows} LEFT JOIN {a} USING (l_linestatus) "
                         f"LEFT JOIN {b} USING (l_linestatus, l_returnflag) LEFT JOIN {c} USING (l_returnflag, l_linenumber))")


@query("b2_bayes_net_likelihood", f"""
WITH {sides_sql('lineitem')}, fs AS (SELECT * FROM fk WHERE NOT (l_returnflag = 'R' AND l_linenumber = 7))
SELECT 'bayesian_network' AS name, round({_net('rl', 'g')('fs')}, 6) AS syn_likelihood, round({_net('fs', 'f')('rl')}, 6) AS test_likelihood""")
def b2(spark, sf):
    real, fake = sides(spark, sf, "lineitem")
    # A combination the fake table lacks, so that test rows meet probability 0.
    fake = fake.filter(~((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)))
    given = likelihood.conditional_tables(real, NET)
    return rounded(likelihood.bayes_net_likelihood(fake, real, NET, given))




def _net_null(source):
    """As ``_net``, with a missing value as a value of its own in counts and lookups."""
    a = f"(SELECT l_linestatus, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM {source}) AS p0 FROM {source} GROUP BY 1)"
    b = f"(SELECT l_linestatus, l_returnflag, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY l_linestatus) AS p1 FROM {source} GROUP BY 1, 2)"
    c = f"(SELECT l_returnflag, l_linenumber, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS p2 FROM {source} GROUP BY 1, 2)"
    same = lambda x, y, *cols: " AND ".join(f"{x}.{k} IS NOT DISTINCT FROM {y}.{k}" for k in cols)
    return lambda rows: (f"(SELECT avg(ln(coalesce(p0, 0) * coalesce(p1, 0) * coalesce(p2, 0) + 1e-8)) FROM {rows} z "
                         f"LEFT JOIN {a} a ON {same('z', 'a', 'l_linestatus')} "
                         f"LEFT JOIN {b} b ON {same('z', 'b', 'l_linestatus', 'l_returnflag')} "
                         f"LEFT JOIN {c} c ON {same('z', 'c', 'l_returnflag', 'l_linenumber')})")


_BLANKED = ", ".join(f"CASE WHEN {rule} THEN NULL ELSE {c} END AS {c}" for c, rule in NET_BLANKS.items())


@query("b2_null_parents", f"""
WITH lb AS (SELECT l_orderkey, {_BLANKED} FROM lineitem), rl AS (SELECT * FROM lb WHERE {u_sql(SEED, 'split', 'l_orderkey')} < 0.5),
fk AS (SELECT * FROM lb WHERE {u_sql(SEED, 'split', 'l_orderkey')} >= 0.5)
SELECT 'bayesian_network' AS name, round({_net_null('rl')('fk')}, 6) AS syn_likelihood, round({_net_null('fk')('rl')}, 6) AS test_likelihood""")
def b2_null_parents(spark, sf):
    real, fake = (blanked_lineitem(df) for df in sides(spark, sf, "lineitem"))
    given = likelihood.conditional_tables(real, NET)
    return rounded(likelihood.bayes_net_likelihood(fake, real, NET, given))


@query("u19_dispatch_bayesian_likelihood", f"""
WITH {sides_sql('lineitem')}, fs AS (SELECT * FROM fk WHERE NOT (l_returnflag = 'R' AND l_linenumber = 7))
SELECT 'bayesian_network' AS name, round({_net('rl', 'g')('fs')}, 6) AS syn_likelihood, round({_net('fs', 'f')('rl')}, 6) AS test_likelihood""")
def u19_bayesian(spark, sf):
    real, fake = sides(spark, sf, "lineitem")
    fake = fake.filter(~((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)))
    meta = TableMeta({"l_linestatus": CATEGORICAL, "l_returnflag": CATEGORICAL, "l_linenumber": ORDINAL},
                     problem_type="bayesian_likelihood")
    return rounded(models.fake_to_real(TablePair(real, fake, meta), real, structure=NET))


@query("u19_dispatch_gaussian_likelihood")
def u19_gaussian(spark, sf):
    real, fake = sides(spark, sf, "lineitem")
    meta = TableMeta({"l_quantity": NUMERICAL, "l_discount": NUMERICAL, "l_tax": NUMERICAL}, problem_type="gaussian_likelihood")
    return rounded(models.fake_to_real(TablePair(real, fake, meta), real), 1)
