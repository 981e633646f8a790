"""The aggregates behind the comparison charts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemirror.operators.assoc import association_difference, association_matrix, numeric_association
from tablemirror.operators.clean import numeric_columns
from tablemirror.operators.ordering import running
from tablemirror.operators.pca import pca_scores
from tablemirror.operators.profile import fitted_vocabularies, long_form, value_counts
from tablemirror.operators.sample import exact_sample
from tablemirror.schema import TableMeta, TablePair


def _both(pair: TablePair, build) -> DataFrame:
    real, fake = build(pair.real), build(pair.fake)
    return real.withColumn("kind", F.lit("Real")).unionByName(fake.withColumn("kind", F.lit("Fake")))


def pca_points(pair: TablePair, key: Sequence[str], points: int | None = None, seed: int = 0) -> DataFrame:
    """``kind, key..., pc1, pc2`` by each table's own components; at most ``points`` rows per table."""
    def build(df: DataFrame) -> DataFrame:
        scores = pca_scores(df, pair.meta, 2, keep=key)
        return scores if points is None else exact_sample(scores, points, key, seed, "points")
    return _both(pair, build)


def correlation_triangle(pair: TablePair) -> DataFrame:
    """``kind, col_a, col_b, value``: numeric correlations below the diagonal."""
    order = {c: i for i, c in enumerate(pair.meta.numericals)}
    position = F.create_map(*[p for c, i in order.items() for p in (F.lit(c), F.lit(i))])
    below = position[F.col("col_a")] > position[F.col("col_b")]
    return _both(pair, lambda df: numeric_association(df, pair.meta.numericals).filter(below))


def log_mean_std(df: DataFrame, meta: TableMeta, vocabularies: dict[str, list[str]]) -> DataFrame:
    """``name, log_mean, log_std`` of the numeric encoding: ln(abs(mean) + 1e-5), ln(std + 1e-5)."""
    columns = numeric_columns(meta, vocabularies)
    row = df.agg(*[a for i, c in enumerate(columns.values()) for a in (
        F.log(F.abs(F.avg(c)) + F.lit(1e-5)).alias(f"m{i}"), F.log(F.stddev_samp(c) + F.lit(1e-5)).alias(f"s{i}"))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"m{i}").alias("log_mean"),
                                                  F.col(f"s{i}").alias("log_std")) for i, n in enumerate(columns)])))


def mean_std(pair: TablePair) -> DataFrame:
    """``kind, name, log_mean, log_std`` in the columns of the real table."""
    vocabularies = fitted_vocabularies(pair.real, pair.meta.discretes)
    return _both(pair, lambda df: log_mean_std(df, pair.meta, vocabularies))


def association_plot(pair: TablePair) -> DataFrame:
    """``col_a, col_b, real, fake, diff``."""
    return association_difference(pair)


def cumulative_distribution(pair: TablePair, columns: Sequence[str]) -> DataFrame:
    """``kind, name, value, share``: share of rows up to each value; one row per different value."""
    counts = _both(pair, lambda df: value_counts(df, columns, "double"))
    upto = running(counts, ["kind", "name"], [F.col("value")], {"upto": ("sum", F.col("cnt"))})
    totals = F.broadcast(counts.groupBy("kind", "name").agg(F.sum("cnt").alias("n")))     # one row per column
    return upto.join(totals, ["kind", "name"]).select("kind", "name", "value", (F.col("upto") / F.col("n")).alias("share"))


def histogram(pair: TablePair, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """``kind, name, bin, low, high, cnt, density`` on bins shared by both tables."""
    both = _both(pair, lambda df: long_form(df, columns, "double")).filter(F.col("value").isNotNull())
    ends = F.broadcast(both.groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi")))   # one row per column
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    at = F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("lo"), width)), F.lit(0)).cast("int")
    binned = (both.join(ends, "name").withColumn("bin", F.least(at, F.lit(bins - 1)))
              .groupBy("kind", "name", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("cnt")))
    totals = F.broadcast(binned.groupBy("kind", "name").agg(F.sum("cnt").alias("n")))
    return binned.join(totals, ["kind", "name"]).select(
        "kind", "name", "bin", (F.col("lo") + F.col("bin") * width).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "cnt",
        F.try_divide(F.col("cnt").cast("double"), F.col("n") * width).alias("density"))


def density_curve(bins: DataFrame, points: int = 100) -> DataFrame:
    """``kind, name, x, density``: Gaussian kernel over the bins of ``histogram`` (Scott's bandwidth).

    Input and output are a few rows per column, whatever the size of the tables.
    """
    middle = (F.col("low") + F.col("high")) / 2
    shape = bins.groupBy("kind", "name").agg(
        F.sum("cnt").alias("n"), F.min("low").alias("a"), F.max("high").alias("b"),
        F.sum(middle * F.col("cnt")).alias("s1"), F.sum(middle * middle * F.col("cnt")).alias("s2"))
    sd = F.sqrt(F.greatest(F.col("s2") / F.col("n") - F.pow(F.col("s1") / F.col("n"), 2), F.lit(1e-12)))
    grid = shape.select("kind", "name", "n", "a", "b", (sd * F.pow("n", F.lit(-0.2))).alias("h"),
                        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i"))
    grid = grid.withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("_i") / F.lit(points - 1))
    cells = bins.select("kind", "name", middle.alias("_m"), "cnt")
    z = (F.col("x") - F.col("_m")) / F.col("h")
    return grid.join(cells, ["kind", "name"]).groupBy("kind", "name", "x").agg(
        (F.sum(F.col("cnt") * F.exp(-z * z / 2)) / (F.first("n") * F.first("h") * math.sqrt(2 * math.pi))).alias("density"))


def category_proportions(pair: TablePair, columns: Sequence[str]) -> DataFrame:
    """``kind, name, value, proportion`` over the stacked tables."""
    counts = _both(pair, lambda df: value_counts(df, columns))
    totals = F.broadcast(counts.groupBy("kind", "name").agg(F.sum("cnt").alias("n")))     # one row per column
    return counts.join(totals, ["kind", "name"]).select("kind", "name", "value", (F.col("cnt") / F.col("n")).alias("proportion"))


def mean_std_of_many(real: DataFrame, fakes: dict[str, DataFrame], meta: TableMeta) -> DataFrame:
    """``synthesizer, name, log_mean, log_std`` for the real table and several fake ones."""
    vocabularies = fitted_vocabularies(real, meta.discretes)
    out = log_mean_std(real, meta, vocabularies).withColumn("synthesizer", F.lit("Real"))
    for name, fake in fakes.items():
        out = out.unionByName(log_mean_std(fake, meta, vocabularies).withColumn("synthesizer", F.lit(name)))
    return out


def association_of_many(real: DataFrame, fakes: dict[str, DataFrame], meta: TableMeta) -> DataFrame:
    """``synthesizer, col_a, col_b, value, diff`` against the one real table."""
    base = association_matrix(real, meta).withColumnRenamed("value", "_real")
    out = None
    for name, fake in fakes.items():
        one = association_matrix(fake, meta).withColumn("synthesizer", F.lit(name))
        out = one if out is None else out.unionByName(one)
    # One row per column pair.
    return out.join(F.broadcast(base), ["col_a", "col_b"]).select(
        "synthesizer", "col_a", "col_b", "value", F.abs(F.col("value") - F.col("_real")).alias("diff"))
