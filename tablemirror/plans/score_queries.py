"""Scores over truth and prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemirror.functions import scores
from tablemirror.operators.assoc import association_difference
from tablemirror.plans.fixtures import pair
from tablemirror.plans.registry import query, rounded, table

# Hard predictions: truth is l_returnflag = 'A', prediction l_quantity > 30, score l_quantity.
HARD = """p AS (SELECT CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS p,
  l_quantity AS s FROM lineitem),
c AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (y = 1 AND p = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND p = 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (y = 1 AND p = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (y = 0 AND p = 0) AS DOUBLE) AS tn FROM p)"""
# Numbers: truth is the price, prediction a price of 1500 per piece.
NUMBERS = "p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)"
# Classes: truth is l_linenumber, prediction a bucket of the quantity.
CLASSES = "p AS (SELECT l_linenumber AS y, CAST(floor(l_quantity / 8) AS INTEGER) + 1 AS p FROM lineitem)"


def hard(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "A").cast("int").alias("y"), (F.col("l_quantity") > 30).cast("int").alias("p"),
        F.col("l_quantity").alias("s"))


def numbers(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))


def classes(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("y"), (F.floor(F.col("l_quantity") / 8).cast("int") + 1).alias("p"))


def _register(name, data, score, sql, digits=6):
    @query(name, sql)
    def run(spark, sf):
        df = data(spark, sf)
        return rounded(df.agg(scores.SCORES[score](F.col("y"), F.col("p")).alias(score)), digits)


_register("m1_pearson", numbers, "pearsonr", f"WITH {NUMBERS} SELECT round(corr(y, p), 6) AS pearsonr FROM p")
_register("m4_precision", hard, "precision_score", f"WITH {HARD} SELECT round(tp / (tp + fp), 6) AS precision_score FROM c")
_register("m5_recall", hard, "recall_score", f"WITH {HARD} SELECT round(tp / (tp + fn), 6) AS recall_score FROM c")
_register("m6_roc_auc_hard", hard, "roc_auc", f"WITH {HARD} SELECT round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS roc_auc FROM c")
_register("m8_f1_binary", hard, "f1_score", f"WITH {HARD} SELECT round(2 * tp / (2 * tp + fp + fn), 6) AS f1_score FROM c")
_register("m8_f1_micro", classes, "f1_score", f"WITH {CLASSES} SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS f1_score FROM p")
_register("m9_accuracy", hard, "accuracy", f"WITH {HARD} SELECT round((tp + tn) / n, 6) AS accuracy FROM c")
_register("m10_mse", numbers, "mse", f"WITH {NUMBERS} SELECT round(avg((y - p) * (y - p)), 2) AS mse FROM p", 2)
_register("m12_mae", numbers, "mae", f"WITH {NUMBERS} SELECT round(avg(abs(y - p)), 4) AS mae FROM p", 4)
_register("m13_mape", numbers, "mape", f"WITH {NUMBERS} SELECT round(avg(abs((y - p) / y)), 6) AS mape FROM p")
_register("m14_rmse", numbers, "rmse", f"WITH {NUMBERS} SELECT round(sqrt(avg((y - p) * (y - p))), 4) AS rmse FROM p", 4)
_register("m15_cosine_distance", numbers, "cosine", f"WITH {NUMBERS} SELECT round(1 - sum(y * p) / sqrt(sum(y * y) * sum(p * p)), 6) AS cosine FROM p")
_register("m17_jaccard_micro", classes, "jaccard_similarity",
          f"WITH {CLASSES}, c AS (SELECT CAST(count(*) FILTER (y = p) AS DOUBLE) AS h, count(*) AS n FROM p) SELECT round(h / (2 * n - h), 6) AS jaccard_similarity FROM c")
_register("m18_r2", numbers, "r2", f"WITH {NUMBERS}, m AS (SELECT avg(y) AS m FROM p) SELECT round(1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)), 6) AS r2 FROM p, m")


@query("m2_spearman", f"""
WITH {NUMBERS}, r AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS b FROM p)
SELECT round(corr(a, b), 6) AS spearman FROM r""")
def m2(spark, sf):
    return rounded(scores.spearman(numbers(spark, sf), "y", "p"))


@query("m3_confusion_matrix", f"WITH {CLASSES} SELECT y AS truth, p AS predicted, count(*) AS cnt FROM p GROUP BY ALL")
def m3(spark, sf):
    return scores.confusion_matrix(classes(spark, sf), "y", "p")


@query("m6_roc_auc", f"""
WITH {HARD}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM p),
t AS (SELECT CAST(sum(r) FILTER (y = 1) AS DOUBLE) AS sr, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS np, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS nn FROM r)
SELECT round((sr - np * (np + 1) / 2) / (np * nn), 6) AS roc_auc FROM t""")
def m6(spark, sf):
    return rounded(scores.roc_auc(hard(spark, sf), "y", "s"))


@query("m7_pr_auc", f"""
WITH {HARD}, h AS (SELECT s, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM p GROUP BY s),
k AS (SELECT s, pos, CAST(sum(pos) OVER (ORDER BY s DESC) AS DOUBLE) AS tp, CAST(sum(n) OVER (ORDER BY s DESC) AS DOUBLE) AS m FROM h),
q AS (SELECT tp / sum(pos) OVER () AS rec, tp / m AS pre, s FROM k),
z AS (SELECT rec - coalesce(lag(rec) OVER (ORDER BY s DESC), 0) AS w, (pre + coalesce(lag(pre) OVER (ORDER BY s DESC), 1)) / 2 AS v FROM q)
SELECT round(sum(w * v), 6) AS pr_auc FROM z""")
def m7(spark, sf):
    return rounded(scores.pr_auc(hard(spark, sf), "y", "s"))


@query("m13_mape_zero_truth", """
WITH p AS (SELECT CAST(l_discount AS DOUBLE) AS y, CAST(l_tax AS DOUBLE) AS p FROM lineitem)
SELECT round(avg(abs((y - p) / y)) FILTER (y <> 0), 6) AS mape, count(*) FILTER (y = 0) AS zeros FROM p""")
def m13_zero(spark, sf):
    y, p = F.col("l_discount"), F.col("l_tax")
    return rounded(table(spark, sf, "lineitem").agg(scores.mape(y, p).alias("mape"), scores.zero_truth(y, p).alias("zeros")))


@query("m19_macro_micro_f1", f"""
WITH {CLASSES}, l AS (SELECT DISTINCT y AS k FROM p UNION SELECT DISTINCT p FROM p),
c AS (SELECT k, count(*) FILTER (y = k) AS t, count(*) FILTER (p = k) AS g, count(*) FILTER (y = k AND p = k) AS h FROM p, l GROUP BY k)
SELECT round(CAST(sum(h) AS DOUBLE) / sum(t), 6) AS accuracy, round(avg(2.0 * h / (t + g)), 6) AS macro_f1, round(CAST(sum(h) AS DOUBLE) / sum(t), 6) AS micro_f1 FROM c""")
def m19(spark, sf):
    return rounded(scores.class_f1(classes(spark, sf), "y", "p"))


def matrices(spark, sf):
    """Numeric association matrices of both sides in long form."""
    both = pair(spark, sf, "lineitem")
    return association_difference(both.select(*both.meta.numericals))
