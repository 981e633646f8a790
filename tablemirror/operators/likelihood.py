"""Likelihood scores: Bayesian networks of discrete columns, and Gaussian mixtures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemirror.operators.joins import lookup
from tablemirror.operators.mixture import fit_tables, packed_log_likelihoods, packed_tables

FLOOR = 1e-8    # added to a probability before its logarithm
MISSING = "\u2205"   # a missing value; every known one is written with a leading "=", so both sort in value order


def coded(c: str):
    """A column's values as text that joins NULL with NULL: known values in their order, a missing value last."""
    return F.when(F.col(c).isNull(), F.lit(MISSING)).otherwise(F.concat(F.lit("="), F.col(c).cast("string"))).alias(c)


def decoded(c: str):
    return F.when(F.col(c) == MISSING, F.lit(None).cast("string")).otherwise(F.expr(f"substring(`{c}`, 2)")).alias(c)


def topological(structure: Mapping[str, Sequence[str]]) -> list[str]:
    """Parents before children."""
    done: list[str] = []
    left = dict(structure)
    while left:
        ready = [c for c, parents in left.items() if all(p in done for p in parents)]
        if not ready:
            raise ValueError("the structure has a cycle or names an unknown parent")
        done += ready
        for c in ready:
            del left[c]
    return done


def conditional_tables(df: DataFrame, structure: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Per child: ``parents..., child, _p`` from counts, values ``coded``: a missing value is a value of its own."""
    nodes = list(structure)
    joint = df.select(*[coded(c) for c in nodes]).groupBy(*nodes).agg(
        F.count(F.lit(1)).alias("_n"))
    out = {}
    for child, parents in structure.items():
        both = joint.groupBy(*parents, child).agg(F.sum("_n").alias("_c"))
        if parents:
            above = both.groupBy(*parents).agg(F.sum("_c").alias("_t"))
            both = both.join(above, list(parents))
        else:
            both = both.crossJoin(F.broadcast(both.agg(F.sum("_c").alias("_t"))))     # one row
        out[child] = both.select(*parents, child, (F.col("_c") / F.col("_t")).alias("_p"))
    return out


def bayes_net_log_likelihood(df: DataFrame, tables: Mapping[str, DataFrame],
                             structure: Mapping[str, Sequence[str]]) -> DataFrame:
    """``loglik``: mean of ln(p + 1e-8) over the rows; anything unseen has p = 0. A missing value, parent or child,
    is a value of its own (``tables`` from ``conditional_tables``).

    Equal rows are counted first, so a frequent combination is scored once.
    """
    nodes = list(structure)
    rows = df.select(*[coded(c) for c in nodes]).groupBy(*nodes).agg(
        F.count(F.lit(1)).alias("_n"))
    p = F.lit(1.0)
    for i, (child, parents) in enumerate(structure.items()):
        rows = lookup(rows, tables[child].withColumnRenamed("_p", f"_p{i}"), [*parents, child])
        p = p * F.coalesce(F.col(f"_p{i}"), F.lit(0.0))
    return rows.agg((F.sum(F.log(p + F.lit(FLOOR)) * F.col("_n")) / F.sum("_n")).alias("loglik"))


def bayes_net_likelihood(fake: DataFrame, test: DataFrame, structure: Mapping[str, Sequence[str]],
                         given: Mapping[str, DataFrame]) -> DataFrame:
    """``name, syn_likelihood, test_likelihood``: fake under the given network, and test under a
    network of the same structure fitted on fake."""
    syn = bayes_net_log_likelihood(fake, given, structure).select(F.col("loglik").alias("syn_likelihood"))
    refit = conditional_tables(fake, structure)
    held = bayes_net_log_likelihood(test, refit, structure).select(F.col("loglik").alias("test_likelihood"))
    return syn.crossJoin(held).select(F.lit("bayesian_network").alias("name"), "syn_likelihood", "test_likelihood")


def mixture_likelihood(fake: DataFrame, test: DataFrame, columns: Sequence[str], components: Sequence[int] = (10, 30),
                       max_iter: int = 100) -> DataFrame:
    """``name, components, syn_likelihood, test_likelihood``: a mixture fitted on test scores fake, one
    fitted on fake scores test."""
    tables = {"fake": fake, "test": test}
    data = packed_tables(tables, columns)
    fitted = fit_tables(tables, columns, components, max_iter, data=data)
    models = {f"{kind}_{k}": (table, fitted[origin, k]) for k in components
              for kind, table, origin in (("syn", "fake", "test"), ("test", "test", "fake"))}
    found = packed_log_likelihoods(data, models)
    value = lambda kind, k: F.max(F.when(F.col("name") == f"{kind}_{k}", F.col("loglik")))      # noqa: E731
    cells = [F.struct(F.lit(k).alias("components"), value("syn", k).alias("syn_likelihood"), value("test", k).alias("test_likelihood"))
             for k in components]
    return found.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).select(
        F.lit("gaussian_mixture").alias("name"), "components", "syn_likelihood", "test_likelihood")
