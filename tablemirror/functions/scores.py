"""Scores over (truth, prediction) columns.

The first group are aggregate expressions: a score is ``fn(y, p) -> Column``, so any number of them
share one pass and users add their own without a Python UDF. The second group need an order or a
class table and work on a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemirror.operators.joins import lookup
from tablemirror.operators.ordering import ROWS_PER_TASK, running


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("double")


def pearson(y: Column, p: Column) -> Column:
    return F.corr(y, p)


def precision(y: Column, p: Column) -> Column:
    return _ratio(_count((y == 1) & (p == 1)), _count(p == 1))


def recall(y: Column, p: Column) -> Column:
    return _ratio(_count((y == 1) & (p == 1)), _count(y == 1))


def f1_binary(y: Column, p: Column) -> Column:
    hits = _count((y == 1) & (p == 1))
    return _ratio(2 * hits, _count(y == 1) + _count(p == 1))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


def f1(y: Column, p: Column) -> Column:
    """Binary for at most two truth labels, else micro (which is the accuracy)."""
    return F.when(F.count_distinct(y) <= 2, f1_binary(y, p)).otherwise(accuracy(y, p))


def jaccard_micro(y: Column, p: Column) -> Column:
    hits, n = _count(y == p), F.count(F.lit(1)).cast("double")
    return hits / (2 * n - hits)


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mape(y: Column, p: Column) -> Column:
    """Mean of abs((y - p) / y) over rows with y != 0; see ``zero_truth`` for the others."""
    return F.avg(F.abs(F.try_divide(y - p, y)))


def zero_truth(y: Column, p: Column) -> Column:
    return F.count_if(y == 0)


def cosine_distance(y: Column, p: Column) -> Column:
    return 1 - F.sum(y * p) / F.sqrt(F.sum(y * y) * F.sum(p * p))


def r2(y: Column, p: Column) -> Column:
    return 1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y))


def roc_auc_hard(y: Column, p: Column) -> Column:
    """Area under the ROC curve of 0/1 predictions: (sensitivity + specificity) / 2."""
    sensitivity = _ratio(_count((y == 1) & (p == 1)), _count(y == 1))
    specificity = _ratio(_count((y == 0) & (p == 0)), _count(y == 0))
    return (sensitivity + specificity) / 2


SCORES: dict[str, Callable[[Column, Column], Column]] = {
    "pearsonr": pearson,
    "precision_score": precision,
    "recall_score": recall,
    "f1_score": f1,
    "f1_binary": f1_binary,
    "accuracy": accuracy,
    "jaccard_similarity": jaccard_micro,
    "mse": mse,
    "rmse": rmse,
    "mae": mae,
    "mape": mape,
    "cosine": cosine_distance,
    "r2": r2,
    "roc_auc": roc_auc_hard,
}


def score_columns(names: Sequence[str], y: Column, p: Column, dataset: str | None = None) -> list[Column]:
    """Aggregate columns named ``<score>_<dataset>``."""
    unknown = [n for n in names if n not in SCORES]
    if unknown:
        raise ValueError(f"unknown scores: {unknown}")
    return [SCORES[n](y, p).alias(n if dataset is None else f"{n}_{dataset}") for n in names]


# ---------------------------------------------------------------- ordered and per-class scores

def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("truth"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("cnt"))


def class_f1(df: DataFrame, y: str, p: str) -> DataFrame:
    """``accuracy, macro_f1, micro_f1`` from the confusion counts (one row per class pair)."""
    cm = confusion_matrix(df, y, p)
    cells = F.array(F.struct(F.col("truth").alias("label"), F.col("cnt").alias("t"), F.lit(0).cast("bigint").alias("g")),
                    F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("cnt").alias("g")))
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("cnt")).otherwise(0)
    sides = (cm.select(F.inline(cells), hit.alias("hit")).groupBy("label")
             .agg(F.sum("t").alias("t"), F.sum("g").alias("g"),
                  (F.sum("hit") / 2).alias("hit")))      # every hit is seen once per side
    return sides.agg((F.sum("hit") / F.sum("t")).alias("accuracy"),
                     F.avg(2 * F.col("hit") / (F.col("t") + F.col("g"))).alias("macro_f1"),
                     (F.sum("hit") / F.sum("t")).alias("micro_f1"))


def average_ranks(df: DataFrame, group: Sequence[str], value: str, count: str,
                  rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Average rank of each distinct value of a (group, value, count) table."""
    ranked = running(df, group, [F.col(value)], {"_upto": ("sum", F.col(count))}, rows_per_task)
    return ranked.select(*group, value, (F.col("_upto") - (F.col(count) - 1) / 2).alias("rank"))


def weighted_pearson(x: Column, y: Column, w: Column) -> Column:
    """Pearson correlation of weighted points; give x and y roughly centred."""
    n = F.sum(w)
    cov = F.sum(w * x * y) - F.sum(w * x) * F.sum(w * y) / n
    vx = F.sum(w * x * x) - F.sum(w * x) * F.sum(w * x) / n
    vy = F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / n
    return F.try_divide(cov, F.sqrt(vx * vy))


def spearman(df: DataFrame, y: str, p: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rank correlation with average ranks for ties; equal pairs are compressed to counts first."""
    pairs = (df.select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")).dropna()
             .groupBy("y", "p").agg(F.count(F.lit(1)).alias("cnt")))
    sides = (pairs.select(F.inline(F.array(F.struct(F.lit("y").alias("side"), F.col("y").alias("v"), "cnt"),
                                           F.struct(F.lit("p").alias("side"), F.col("p").alias("v"), "cnt"))))
             .groupBy("side", "v").agg(F.sum("cnt").alias("cnt")))
    ranks = average_ranks(sides, ["side"], "v", "cnt", rows_per_task)
    ry = ranks.filter(F.col("side") == "y").select(F.col("v").alias("y"), F.col("rank").alias("ry"))
    rp = ranks.filter(F.col("side") == "p").select(F.col("v").alias("p"), F.col("rank").alias("rp"))
    n = pairs.agg(F.sum("cnt").alias("n"))
    both = lookup(lookup(pairs, ry, ["y"]), rp, ["p"]).crossJoin(F.broadcast(n))   # one row
    middle = (F.col("n") + 1) / 2
    return both.agg(weighted_pearson(F.col("ry") - middle, F.col("rp") - middle, F.col("cnt")).alias("spearman"))


def _thresholds(df: DataFrame, y: str, score: str, rows_per_task: int) -> DataFrame:
    """``v, pos, neg, tp, fp``: class counts per distinct score and from that score upwards."""
    counts = df.groupBy(F.col(score).cast("double").alias("v")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    return running(counts, [], [F.col("v").desc()],
                   {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}, rows_per_task)


def roc_auc(df: DataFrame, y: str, score: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Area under the ROC curve of any score: rank sum over the histogram of scores."""
    t = _thresholds(df, y, score, rows_per_task)
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("pos") * F.col("neg") / 2)
    return t.agg((wins / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def pr_auc(df: DataFrame, y: str, score: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Area under the precision-recall curve, trapezoids from (recall 0, precision 1)."""
    t = _thresholds(df, y, score, rows_per_task)
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(F.try_divide(tp0, tp0 + fp0))
    return t.agg((F.sum(F.col("pos") * (here + before) / 2) / F.sum("pos")).alias("pr_auc"))


# ---------------------------------------------------------------- small matrices in long form

def pairwise_rows(a: DataFrame, b: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """``row_a, row_b, euclidean, cosine_similarity`` between the rows of two long matrices.

    For matrices with one row per table column, such as association matrices: rows meet on the
    shared column key.
    """
    left = a.select(F.col(row).alias("row_a"), F.col(column).alias("_k"), F.col(value).alias("_x"))
    right = b.select(F.col(row).alias("row_b"), F.col(column).alias("_k"), F.col(value).alias("_y"))
    x, y = F.col("_x"), F.col("_y")
    return left.join(right, "_k").groupBy("row_a", "row_b").agg(
        F.sqrt(F.sum((x - y) * (x - y))).alias("euclidean"),
        F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("cosine_similarity"))
