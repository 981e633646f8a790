"""Leaderboards over score tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Sections of a score file and the baselines left out of it.
SECTIONS = {
    "Gaussian Mixture Simulated Data": ["grid/syn_likelihood", "grid/test_likelihood", "gridr/syn_likelihood",
                                        "gridr/test_likelihood", "ring/syn_likelihood", "ring/test_likelihood"],
    "Bayesian Networks Simulated Data": ["asia/syn_likelihood", "asia/test_likelihood", "alarm/syn_likelihood",
                                         "alarm/test_likelihood", "child/syn_likelihood", "child/test_likelihood",
                                         "insurance/syn_likelihood", "insurance/test_likelihood"],
    "Real World Datasets": ["adult/f1", "census/f1", "credit/f1", "covtype/macro_f1", "intrusion/macro_f1",
                            "mnist12/accuracy", "mnist28/accuracy", "news/r2"],
}
BASELINES = ["IdentitySynthesizer", "IndependentSynthesizer", "UniformSynthesizer"]
NOT_EVALUATED = "N/E"


def leaderboard(scores: DataFrame, previous: DataFrame | None = None, replace_existing: bool = True) -> DataFrame:
    """Mean of every score per (name, dataset), stamped with the UTC time.

    With a ``previous`` leaderboard the new rows are appended; rows of the same name are replaced or
    kept.
    """
    plain = scores.drop("iteration", "synthesizer")
    metrics = [c for c in plain.columns if c not in ("name", "dataset")]
    board = plain.groupBy("name", "dataset").agg(*[F.avg(m).alias(m) for m in metrics])
    board = board.withColumn("timestamp", F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))
    if previous is None:
        return board
    if replace_existing:
        previous = previous.join(board.select("name").distinct(), "name", "left_anti")
    return previous.unionByName(board, allowMissingColumns=True)


def to_long(scores: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``ids..., metric, value`` of a wide score table."""
    metrics = [c for c in scores.columns if c not in ids]
    return scores.select(*ids, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                                  for m in metrics])))


def wins(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., synthesizer, wins``: in how many metrics it has the highest value; ties all win.

    A NULL value never wins.
    """
    best = Window.partitionBy(*by, "metric")
    top = F.max("value").over(best)
    return long.withColumn("_win", F.coalesce((F.col("value") == top).cast("int"), F.lit(0))).groupBy(*by, "synthesizer").agg(
        F.sum("_win").alias("wins"))


def sectioned(long: DataFrame, sections: Mapping[str, Sequence[str]] = SECTIONS,
              drop: Sequence[str] = tuple(BASELINES)) -> DataFrame:
    """Add the ``section`` of each metric; baselines and metrics of no section are left out."""
    rows = [(m, s) for s, metrics in sections.items() for m in metrics]
    table = long.sparkSession.createDataFrame(rows, "metric string, section string")
    return long.filter(~F.col("synthesizer").isin(*drop)).join(F.broadcast(table), "metric")


def summary(long: DataFrame, versions: Sequence[str], summarise: Callable[..., DataFrame] = wins,
            value: str = "wins") -> DataFrame:
    """``section, synthesizer, <version>...`` with versions descending and gaps shown as N/E."""
    ordered = sorted(versions, reverse=True)
    scored = summarise(long, by=["section", "version"])
    wide = scored.groupBy("section", "synthesizer").pivot("version", ordered).agg(F.first(value))
    return wide.select("section", "synthesizer", *[F.coalesce(F.col(f"`{v}`").cast("string"), F.lit(NOT_EVALUATED)).alias(v)
                                                   for v in ordered])


def dataset_metrics(scores: DataFrame) -> DataFrame:
    """``name, metric, value``: mean per (name, dataset) under the label ``dataset/metric``; missing
    means are dropped."""
    long = to_long(scores.drop("iteration", "synthesizer"), ["name", "dataset"])
    means = long.groupBy("name", "dataset", "metric").agg(F.avg("value").alias("value"))
    return means.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(
        "name", F.concat_ws("/", "dataset", "metric").alias("metric"), "value")


def repeated(run: Callable[[int], DataFrame], iterations: int, synthesizer: str, dataset: str) -> DataFrame:
    """Scores of several runs, tagged; every run is a branch of one plan with its own seed."""
    out = None
    for i in range(iterations):
        one = run(i).withColumns({"iteration": F.lit(i), "synthesizer": F.lit(synthesizer), "dataset": F.lit(dataset)})
        out = one if out is None else out.unionByName(one)
    return out
