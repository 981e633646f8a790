"""Trees over counted bins, held against plain computations over rows."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablemirror.operators import models, trees


def _rows(spark, n=3000):
    df = spark.range(n).select(
        F.col("id").alias("row"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") * 37 % 100).cast("double").alias("b"),
        (F.col("id") * 11 % 5).cast("double").alias("c"))
    df = df.withColumn("label", ((F.col("a") > 3) & (F.col("b") < 60)).cast("double"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).select("row", "features", "label")


def test_forest_levels_are_sums_over_counted_bins(spark, monkeypatch):
    """A tree without draws and choice divides at the best Gini gain over all rows; equal rows are one cell."""
    df = _rows(spark).cache()
    cells, edges = trees.counted_bins(df)
    assert cells.agg(F.sum("n")).first()[0] == 3000 and cells.count() < 1200
    cells = trees.dealt(cells.withColumn("channel", F.col("label").cast("int")).withColumn("t0", F.col("n").cast("double")),
                        ["bins", "label"])
    nodes = trees.grow(cells, 3, max(map(len, edges)) + 1, 1, 3, 3, 2, trees._gini, trees.given_draws, 1)
    x = np.array([[*r["features"].toArray(), r["label"]] for r in df.collect()])

    def gain(f, t):
        low, high = x[x[:, f] <= t, 3], x[x[:, f] > t, 3]
        return sum(len(s) * (s.mean() ** 2 + (1 - s.mean()) ** 2) for s in (low, high) if len(s))

    best = max(gain(f, t) for f in range(3) for t in edges[f])
    assert gain(nodes.feature[0], edges[nodes.feature[0]][nodes.bin[0]]) == pytest.approx(best)
    assert nodes.sums[0].tolist() == [float((x[:, 3] == k).sum()) for k in (0, 1)]
    forest = models.fit_classifier("random_forest", df, 7, trees=20, depth=4)
    seen = forest.transform(df)
    assert seen.columns == ["row", "features", "label", "prediction"]
    assert seen.filter("label = prediction").count() > 2900
    again = models.fit_classifier("random_forest", df.repartition(5), 7, trees=20, depth=4)
    assert (again.nodes.sums == forest.nodes.sums).all()


def test_bootstrap_draws_every_row(spark):
    """A cell of n rows is drawn as n rows are: mean n, variance n."""
    cells = trees.dealt(spark.range(4000).select(F.col("id").cast("string").cast("binary").alias("bins"), F.lit(9).cast("long").alias("n")),
                        ["bins"]).toArrow()
    drawn = trees.class_draws(3)(cells, 0)
    assert drawn.mean() == pytest.approx(9, abs=0.3) and drawn.var() == pytest.approx(9, abs=1.0)


def test_label_forest_reads_cells_only(spark):
    df = _rows(spark).withColumn("label", F.element_at(F.array(F.lit(5.0), F.lit(9.0)), (F.col("label") + 1).cast("int")) + F.col("row") % 2)
    forest = trees.fit_label_forest(df, 20, 5, 42)
    mean = df.groupBy("features").agg(F.avg("label").alias("label"))
    error = forest.transform(mean).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]
    assert error < 1.0
    assert forest.nodes.sums[:20, 0].mean() == pytest.approx(3000, rel=0.03)


def test_boosting_takes_counted_rows(spark, monkeypatch):
    """The boosted trees see one row for equal bins and labels, with their number as weight."""
    df = _rows(spark)
    fit, seen = models.GBTClassifier.fit, []
    monkeypatch.setattr(models.GBTClassifier, "fit", lambda self, rows: seen.append(rows.agg(F.count(F.lit(1)), F.sum("weight")).first()) or fit(self, rows))
    model = models.fit_classifier("xgboost", df, 7, rounds=5)
    assert seen[0][0] < 1200 and seen[0][1] == 3000
    assert model.transform(df).filter("label = prediction").count() == 3000


def test_perceptron_is_the_one_spark_fits(spark):
    """The same first weights, loss and steps as Spark's classifier, from packed rows."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    from tablemirror.operators import perceptron
    df = _rows(spark).select("features", "label").cache()
    layers = [3, 10, 2]
    theirs = MultilayerPerceptronClassifier(layers=layers, maxIter=15, seed=3).fit(df).weights.toArray()
    blocks, count = perceptron.packed(df.repartition(4))
    assert count == 3000 and sum(r["n"] for r in blocks.collect()) == 3000
    rows = df.collect()
    x, y = np.array([r["features"].toArray() for r in rows]), np.array([int(r["label"]) for r in rows])

    def loss(w):
        hidden = 1 / (1 + np.exp(-(x @ w[:30].reshape(3, 10) + w[30:40])))
        out = hidden @ w[40:60].reshape(10, 2) + w[60:]
        return float((np.log(np.exp(out).sum(axis=1)) - out[np.arange(len(y)), y]).mean())

    value, gradient = perceptron.block_sums(x.astype(np.float32), y, theirs, layers)
    assert value / 3000 == pytest.approx(loss(theirs), abs=1e-5)
    for i in (0, 35, 45, 61):
        step = np.zeros(62)
        step[i] = 1e-5
        assert gradient[i] / 3000 == pytest.approx((loss(theirs + step) - loss(theirs - step)) / 2e-5, abs=1e-4)
    model = perceptron.fit_perceptron(df, layers, 15, 3)
    ours = model.weights.toArray()
    assert loss(ours) <= loss(theirs) + 0.02 < 0.5            # the line searches differ in later steps
    assert model.transform(df).filter("label = prediction").count() > 2400
    once = perceptron.fit_perceptron(df, layers, 1, 3).weights.toArray()
    assert np.abs(once - MultilayerPerceptronClassifier(layers=layers, maxIter=1, seed=3).fit(df).weights.toArray()).max() < 1e-3


def test_perceptron_passes_are_matrix_products_over_packed_blocks(spark, monkeypatch):
    """A pass reads a few blocks per task, dealt evenly, whatever lay where before."""
    from tablemirror.operators import perceptron
    monkeypatch.setattr(perceptron, "BLOCK", 100)
    monkeypatch.setattr(perceptron, "TASK_ROWS", 500)
    blocks, _ = perceptron.packed(_rows(spark).coalesce(1))
    sizes = [sum(r["n"] for r in part) for part in blocks.rdd.glom().collect()]
    assert len(sizes) == 6 and max(sizes) <= 700 and sum(sizes) == 3000
    seen = []
    monkeypatch.setattr(perceptron, "fit_perceptron", lambda train, layers, max_iter, seed: seen.append(layers) or "model")
    monkeypatch.setattr(models, "fit_perceptron", perceptron.fit_perceptron)
    assert models.fit_classifier("mlp", _rows(spark), 7) == "model" and seen == [[3, 100, 2]]
