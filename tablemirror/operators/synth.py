"""Statistical synthesizers: uniform, independent marginals, bootstrap and Bayesian network."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemirror.functions.hashing import uniform
from tablemirror.operators.joins import lookup
from tablemirror.operators.likelihood import conditional_tables, decoded, topological
from tablemirror.operators.profile import long_form, sorted_vocabulary
from tablemirror.operators.sample import cdf_lookup, cumulative, dense_index, sample_with_replacement
from tablemirror.schema import TableMeta

STRATEGIES = ("uniform", "independent", "identity", "bayes_net")


def synthesize(df: DataFrame, meta: TableMeta, n: int, strategy: str, key: Sequence[str], seed: int = 0,
               structure: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``draw`` and n synthetic rows of the table's columns."""
    if strategy == "identity":
        return sample_with_replacement(df, n, key, seed).select("draw", *meta.columns)
    if strategy == "independent":
        return independent(df, meta.columns, n, key, seed)
    if strategy == "uniform":
        return uniform_rows(df, meta, n, seed)
    if strategy == "bayes_net":
        return bayes_net_rows(df, structure, n, seed)
    raise ValueError(f"unknown strategy {strategy!r}, expected one of {STRATEGIES}")


def uniform_rows(df: DataFrame, meta: TableMeta, n: int, seed: int = 0) -> DataFrame:
    """Numericals uniform between minimum and maximum, categories uniform over the vocabulary."""
    rows = df.sparkSession.range(n).withColumnRenamed("id", "draw")
    if meta.numericals:
        ends = df.agg(*[a for i, c in enumerate(meta.numericals) for a in (
            F.min(F.col(c).cast("double")).alias(f"lo{i}"), F.max(F.col(c).cast("double")).alias(f"hi{i}"))]).first()
        rows = rows.withColumns({
            c: F.lit(ends[f"lo{i}"]) + uniform(seed, f"uniform:{c}", F.col("draw")) * F.lit(ends[f"hi{i}"] - ends[f"lo{i}"])
            for i, c in enumerate(meta.numericals)})
    if meta.discretes:
        vocabulary = sorted_vocabulary(df, meta.discretes)
        sizes = {r["name"]: r["n"] for r in vocabulary.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
        for c in meta.discretes:
            code = F.floor(uniform(seed, f"uniform:{c}", F.col("draw")) * F.lit(sizes[c]))
            values = vocabulary.filter(F.col("name") == c).select(F.col("code").alias("_code"), F.col("value").alias(c))
            rows = lookup(rows.withColumn("_code", code), values, ["_code"], "inner").drop("_code")
    return rows.select("draw", *meta.columns)


def independent(df: DataFrame, columns: Sequence[str], n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Every column drawn from its own marginal: one random row position per draw and column.

    All columns are looked up in one join on (column, position), whose keys are evenly spread.
    """
    columns = list(columns)
    size = df.count()
    indexed = long_form(dense_index(df, key, seed, name="_idx"), columns, "string", keep=["_idx"])
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw")
    wanted = F.array(*[F.struct(F.lit(c).alias("name"), F.floor(
        uniform(seed, f"marginal:{c}", F.col("draw")) * F.lit(size)).alias("_idx")) for c in columns])
    cells = draws.select("draw", F.inline(wanted)).join(indexed, ["name", "_idx"])
    wide = cells.groupBy("draw").agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns])
    return wide.select("draw", *[F.col(c).cast(df.schema[c].dataType).alias(c) for c in columns])


def bayes_net_rows(df: DataFrame, structure: Mapping[str, Sequence[str]], n: int, seed: int = 0) -> DataFrame:
    """Ancestral sampling: parents before children, one distribution lookup per column. Values come back as text; a
    missing value is drawn as often as it occurs, also as a parent."""
    tables = conditional_tables(df, structure)
    rows = df.sparkSession.range(n).withColumnRenamed("id", "draw")
    for child in topological(structure):
        parents = list(structure[child])
        cdf = cumulative(tables[child].select(*parents, child, "_p"), parents, [child], "_p").drop("_p")
        rows = cdf_lookup(rows.withColumn("_u", uniform(seed, f"net:{child}", F.col("draw"))), cdf,
                          parents, "_u", [child]).drop("_u")
    return rows.select("draw", *[decoded(c) for c in structure])
