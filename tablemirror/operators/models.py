"""Model utility with Spark ML: what a model learns from fake is worth on real, and the reverse."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemirror.functions.scores import class_f1, f1_binary, jaccard_micro, mape, r2, score_columns
from tablemirror.operators.features import FeatureMaker
from tablemirror.operators.likelihood import bayes_net_likelihood, conditional_tables, mixture_likelihood
from tablemirror.operators.perceptron import fit_perceptron
from tablemirror.operators.trees import Binned, binned_vectors, counted_bins, dealt, fit_class_forest, fit_label_forest
from tablemirror.schema import TableMeta, TablePair
from tablemirror.session import cut, spread, written

CLASS_SCORES = ("f1_score", "recall_score", "precision_score", "accuracy", "jaccard_similarity")
REGRESSION_SCORES = ("mse", "rmse", "mae", "mape")


class Constant:
    """A model of a single label."""

    def __init__(self, label: float):
        self.value = label

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(float(self.value)))


@dataclass(frozen=True)
class Stump:
    """``left`` where the feature is at most ``threshold``, else ``right``; without a feature (-1) always ``left``."""

    feature: int
    bin: int
    threshold: float
    left: int
    right: int


class Boosted:
    """Weighted vote of stumps."""

    def __init__(self, votes: list[tuple[Stump, float]], classes: int):
        self.votes, self.classes = votes, classes

    def transform(self, df: DataFrame) -> DataFrame:
        # Stumps that ask the same are one term per class.
        terms: dict[tuple[int, float], np.ndarray] = {}
        for stump, alpha in self.votes:
            sides = terms.setdefault((stump.feature, stump.threshold), np.zeros((2, self.classes)))
            sides[0, stump.left] += alpha
            sides[1, stump.right] += alpha
        sums = [F.lit(0.0)] * self.classes
        for (feature, threshold), sides in terms.items():
            low = F.get("_x", F.lit(feature)) <= F.lit(threshold) if feature >= 0 else F.lit(True)
            sums = [s + F.when(low, F.lit(float(sides[0, k]))).otherwise(F.lit(float(sides[1, k]))) for k, s in enumerate(sums)]
        votes = F.array(*sums)
        return df.withColumn("_x", vector_to_array("features")).withColumn(
            "prediction", (F.array_position(votes, F.array_max(votes)) - 1).cast("double")).select(*df.columns, "prediction")


def class_counts(train: DataFrame) -> dict[float, int]:
    return {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}   # one row per class


def balanced(train: DataFrame, counts: dict[float, int]) -> DataFrame:
    """Weights n / (classes * class size)."""
    n, k = sum(counts.values()), len(counts)
    weight = F.lit(None).cast("double")
    for label, size in counts.items():
        weight = F.when(F.col("label") == label, F.lit(n / (k * size))).otherwise(weight)
    return train.withColumn("weight", weight)


def _classes(counts: dict[float, int]) -> int:
    return int(max(counts)) + 1


def fit_logistic(train: DataFrame, counts: dict[float, int], seed: int = 0, max_iter: int = 50):
    n = sum(counts.values())
    return LogisticRegression(weightCol="weight", maxIter=max_iter, regParam=1.0 / n, standardization=False).fit(
        balanced(train, counts))


def fit_forest(train: DataFrame, counts: dict[float, int], seed: int = 0, trees: int = 100, depth: int = 10):
    """As Spark's random forest, over counted bins (see ``trees``)."""
    return fit_class_forest(train, max(2, _classes(counts)), trees, depth, seed)


def fit_tree(train: DataFrame, counts: dict[float, int], seed: int = 0):
    depth = 20 if len(counts) <= 2 else 30
    cells, edges = counted_bins(train)
    cells = balanced(binned_vectors(dealt(cells, ["bins", "label"]), len(edges)), counts).select(
        "features", "label", (F.col("weight") * F.col("n")).alias("weight"))
    return Binned(edges, DecisionTreeClassifier(maxDepth=depth, weightCol="weight", seed=seed).fit(cells))


def fit_mlp(train: DataFrame, counts: dict[float, int], seed: int = 0, hidden: int = 100, max_iter: int = 50):
    width = train.select("features").first()["features"].size
    return fit_perceptron(train, [width, hidden, max(2, _classes(counts))], max_iter, seed)


def fit_gbt(train: DataFrame, counts: dict[float, int], seed: int = 0, rounds: int = 20):
    """Spark's boosted trees of the counted bins: rows of equal bins and label have one gradient, so one row with their
    number as weight gives the same trees."""
    cells, edges = counted_bins(train)
    cells = binned_vectors(dealt(cells.withColumnRenamed("n", "weight"), ["bins", "label"]), len(edges)).select(
        "features", "label", F.col("weight").cast("double").alias("weight"))
    gbt = GBTClassifier(maxIter=rounds, maxDepth=6, stepSize=0.3, seed=seed, weightCol="weight")
    return Binned(edges, gbt.fit(cells) if _classes(counts) <= 2 else OneVsRest(classifier=gbt, weightCol="weight").fit(cells))


def _stump_sums(votes: list[tuple[Stump, float]], scale: float, bins: int, classes: int):
    """Of one task: weight and rows by feature, bin and class under the votes so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, rows = 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype="int8").reshape(batch.num_rows, -1)
            y, n = batch.column("label").to_numpy().astype(int), batch.column("n").to_numpy()
            logs = np.full(len(y), scale)
            for s, alpha in votes:
                predicted = np.where(codes[:, s.feature] <= s.bin, s.left, s.right) if s.feature >= 0 else s.left
                logs += alpha * (predicted != y)
            w = n * np.exp(logs)
            at = (np.arange(codes.shape[1])[None, :] * bins + codes) * classes + y[:, None]
            size = codes.shape[1] * bins * classes
            weights = weights + np.bincount(at.ravel(), np.repeat(w, codes.shape[1]), size)
            rows = rows + np.bincount(at.ravel(), np.repeat(n, codes.shape[1]), size).astype("int64")
        if isinstance(rows, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype="int32")), pa.array(weights), pa.array(rows)],
                                             names=["pos", "w", "n"])
    return run


def _best_stump(w: np.ndarray, n: np.ndarray, thresholds: list[np.ndarray]) -> tuple[Stump, float]:
    """The split with the largest Gini gain of (features, bins, classes) sums, and its share of wrong weight."""
    total = w[0].sum(axis=0)
    share = total / total.sum()
    best, stump = 0.0, Stump(-1, 0, 0.0, int(total.argmax()), int(total.argmax()))
    for f, t in enumerate(thresholds):
        for b in range(len(t)):
            low, rows = w[f, :b + 1].sum(axis=0), n[f, :b + 1].sum()
            if rows == 0 or rows == n[f].sum():
                continue
            high = total - low
            gain = ((low ** 2).sum() / low.sum() + (high ** 2).sum() / max(high.sum(), 1e-300)) / total.sum() - (share ** 2).sum()
            if gain > best:
                best, stump = gain, Stump(f, b, float(t[b]), int(low.argmax()), int(high.argmax()))
    if stump.feature < 0:
        return stump, 1.0 - share.max()
    low = w[stump.feature, :stump.bin + 1].sum(axis=0)
    high = w[stump.feature, stump.bin + 1:].sum(axis=0)
    wrong = low.sum() - low[stump.left] + high.sum() - high[stump.right]
    return stump, float(max(wrong, 0.0) / total.sum())


def fit_adaboost(train: DataFrame, counts: dict[float, int], seed: int = 0, rounds: int = 50):
    """Discrete SAMME over decision stumps. Rows are reduced to the bins of their features, equal ones counted; a round
    is one aggregate of weights by feature, bin and class, from which the driver takes the best split."""
    k, classes = max(2, len(counts)), max(2, _classes(counts))
    cells, thresholds = counted_bins(train)
    cells, dims = spread(cells), len(thresholds)
    bins = max(len(t) for t in thresholds) + 1
    votes: list[tuple[Stump, float]] = []
    scale = -math.log(sum(counts.values()))
    for _ in range(rounds):
        sums = cells.mapInArrow(_stump_sums(votes, scale, bins, classes), "pos int, w double, n long").groupBy("pos").agg(
            F.sum("w").alias("w"), F.sum("n").alias("n")).orderBy("pos").toPandas()     # features x bins x classes rows
        shape = (dims, bins, classes)
        stump, error = _best_stump(sums["w"].to_numpy().reshape(shape), sums["n"].to_numpy().reshape(shape), thresholds)
        if error >= 1 - 1 / k:
            break
        if error <= 0:
            votes.append((stump, 1.0))
            break
        alpha = math.log((1 - error) / error) + math.log(k - 1)
        votes.append((stump, alpha))
        # The next total weight, so that the weights always add up to one.
        scale -= math.log(1 + error * (math.exp(alpha) - 1))
    return Boosted(votes, _classes(counts)) if votes else Constant(max(counts, key=counts.get))


CLASSIFIERS: dict[str, Callable] = {
    "logistic_regression": fit_logistic, "random_forest": fit_forest, "decision_tree": fit_tree,
    "mlp": fit_mlp, "adaboost": fit_adaboost, "xgboost": fit_gbt,
}


def _linear(**params):
    def fit(train: DataFrame, n: int, seed: int = 0):
        return LinearRegression(standardization=False, maxIter=100, **params).fit(train)
    return fit


def fit_ridge(train: DataFrame, n: int, seed: int = 0):
    return LinearRegression(standardization=False, elasticNetParam=0.0, regParam=1.0 / n).fit(train)


def fit_linear(train: DataFrame, n: int, seed: int = 0):
    return LinearRegression(solver="normal").fit(train)


def fit_forest_regressor(train: DataFrame, n: int, seed: int = 42):
    return fit_label_forest(train, trees=20, depth=5, seed=42)


REGRESSORS: dict[str, Callable] = {
    "random_forest_regr": fit_forest_regressor,
    "lasso": _linear(elasticNetParam=1.0, regParam=1.0),
    "ridge": fit_ridge,
    "elastic_net": _linear(elasticNetParam=0.5, regParam=1.0),
    "linear_regression": fit_linear,
}
# The regressors of a report's grid.
REPORT_REGRESSORS = ("random_forest_regr", "lasso", "ridge", "elastic_net")


def fit_classifier(name: str, train: DataFrame, seed: int = 0, **params):
    train = train.filter(F.col("label") >= 0)       # a class that real never has cannot be learnt, only missed
    counts = class_counts(train)
    if len(counts) == 1:
        return Constant(next(iter(counts)))
    return CLASSIFIERS[name](train, counts, seed, **params)


def fit_regressor(name: str, train: DataFrame, seed: int = 0, **params):
    return REGRESSORS[name](train, train.count(), seed, **params)


# ---------------------------------------------------------------- grids

def cross_predictions(train: dict[str, DataFrame], test: dict[str, DataFrame], models: Sequence[str],
                      fit: Callable, key: Sequence[str], seed: int = 0, params: dict | None = None) -> DataFrame:
    """``model, trained_on, tested_on, key..., label, prediction`` for every model, training and test set."""
    out = None
    for origin, rows in train.items():
        rows = written(rows)
        for name in models:
            model = fit(name, rows, seed, **(params or {}).get(name, {}))
            for target, held in test.items():
                one = model.transform(held).select(
                    F.lit(name).alias("model"), F.lit(origin).alias("trained_on"), F.lit(target).alias("tested_on"),
                    *key, "label", "prediction")
                out = one if out is None else out.unionByName(one)
    return out


def grid_scores(predictions: DataFrame, scores: Sequence[str]) -> DataFrame:
    """``name (<model>_<trained on>), <score>_real, <score>_fake``: one grouped aggregate for all."""
    y, p = F.col("label"), F.col("prediction")
    long = predictions.groupBy("model", "trained_on", "tested_on").agg(*score_columns(scores, y, p))
    return long.groupBy(F.concat_ws("_", "model", "trained_on").alias("name")).agg(*[
        F.max(F.when(F.col("tested_on") == t, F.col(s))).alias(f"{s}_{t}") for s in scores for t in ("real", "fake")])


def prediction_agreement(predictions: DataFrame, key: Sequence[str]) -> DataFrame:
    """``model, tested_on, jaccard``: agreement of the real-trained and the fake-trained model."""
    by_row = predictions.groupBy("model", "tested_on", *key).agg(
        F.max(F.when(F.col("trained_on") == "real", F.col("prediction"))).alias("a"),
        F.max(F.when(F.col("trained_on") == "fake", F.col("prediction"))).alias("b"))
    return by_row.groupBy("model", "tested_on").agg(jaccard_micro(F.col("a"), F.col("b")).alias("jaccard"))


def utility_score(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """``utility``: 1 - mean over the metrics of MAPE(metric on real, metric on fake) over all rows."""
    total = F.lit(0.0)
    for n in names:
        total = total + mape(F.col(f"{n}_real"), F.col(f"{n}_fake"))
    return scores.agg((1 - total / len(names)).alias("utility"))


def utility_grid(real_train: DataFrame, real_test: DataFrame, fake_train: DataFrame, fake_test: DataFrame,
                 meta: TableMeta, models: Sequence[str], key: Sequence[str], task: str = "class",
                 scores: Sequence[str] | None = None, seed: int = 0, params: dict | None = None,
                 label: Column | None = None) -> DataFrame:
    """Predictions of the two-by-two evaluation (see ``grid_scores`` and ``prediction_agreement``)."""
    maker = FeatureMaker.fit(real_train.unionByName(real_test), meta, classes=task == "class")
    made = [maker.transform(df, keep=key) for df in (real_train, fake_train, real_test, fake_test)]
    if label is not None:
        made = [df.withColumn("label", label) for df in made]
    fit = fit_classifier if task == "class" else fit_regressor
    return cut(cross_predictions({"real": made[0], "fake": made[1]}, {"real": made[2], "fake": made[3]},
                                 models, fit, key, seed, params))


BINARY_MODELS = ("decision_tree", "adaboost", "logistic_regression", "mlp")
MULTICLASS_MODELS = ("decision_tree", "mlp")
REGRESSION_MODELS = ("linear_regression",)
PROBLEMS = ("binary_classification", "multiclass_classification", "regression", "gaussian_likelihood", "bayesian_likelihood")


def fake_to_real(pair: TablePair, test: DataFrame, models: Sequence[str] | None = None, seed: int = 0,
                 params: dict | None = None, structure: Mapping[str, Sequence[str]] | None = None,
                 given: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Train on fake, test on real, by the problem type of the metadata.

    Binary: accuracy and F1. Multiclass: accuracy, macro and micro F1. Regression: R2 of
    ln(label clipped to [1, 20000]). Gaussian likelihood: mixtures over the numerical columns. Bayesian likelihood: a
    network of the given ``structure``; its tables are ``given``, else fitted on real.
    """
    problem = pair.meta.problem_type
    if problem == "gaussian_likelihood":
        return mixture_likelihood(pair.fake, test, pair.meta.numericals, **(params or {}).get(problem, {}))
    if problem == "bayesian_likelihood":
        return bayes_net_likelihood(pair.fake, test, structure, given or conditional_tables(pair.real, structure))
    maker = FeatureMaker.fit(pair.real, pair.meta, classes=problem != "regression")
    train, held = spread(maker.transform(pair.fake)), maker.transform(test)
    defaults = {"binary_classification": BINARY_MODELS, "multiclass_classification": MULTICLASS_MODELS,
                "regression": REGRESSION_MODELS}
    out = None
    for name in models or defaults[problem]:
        extra = (params or {}).get(name, {})
        if problem == "regression":
            logged = F.log(F.greatest(F.lit(1.0), F.least(F.col("label"), F.lit(20000.0))))
            model = fit_regressor(name, train.withColumn("label", logged), seed, **extra)
            seen = model.transform(held.withColumn("label", logged))
            row = seen.agg(r2(F.col("label"), F.col("prediction")).alias("r2"))
        else:
            seen = fit_classifier(name, train, seed, **extra).transform(held)
            if problem == "binary_classification":
                row = seen.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
                               f1_binary(F.col("label"), F.col("prediction")).alias("f1"))
            else:
                row = class_f1(seen, "label", "prediction")
        row = row.select(F.lit(name).alias("name"), "*")
        out = row if out is None else out.unionByName(row)
    return out
