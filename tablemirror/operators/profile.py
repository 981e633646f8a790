"""Column profiling: kinds, vocabularies, metadata, encoder statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemirror.operators.ordering import running
from tablemirror.schema import CATEGORICAL, NUMERICAL, ORDINAL, TableMeta, is_numeric


def long_form(df: DataFrame, columns: Sequence[str], dtype: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column): ``keep..., name, value`` with values cast to ``dtype``."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast(dtype).alias("value")) for c in columns])
    return df.select(*keep, F.inline(cells))


def value_counts(df: DataFrame, columns: Sequence[str], dtype: str = "string",
                 keep: Sequence[str] = ()) -> DataFrame:
    """``keep..., name, value, cnt`` for all columns in one pass; NULL values are left out."""
    return (long_form(df, columns, dtype, keep).filter(F.col("value").isNotNull())
            .groupBy(*keep, "name", "value").agg(F.count(F.lit(1)).alias("cnt")))


def infer_kinds(df: DataFrame, unique_thresh: int = 0, discrete: Sequence[str] | None = None,
                approximate: bool = False) -> DataFrame:
    """``name, distinct_values, kind``: a numeric column with more than ``unique_thresh`` distinct
    values is numerical, everything else categorical; an explicit list wins."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    if approximate:
        row = df.agg(*[count(c).alias(c) for c in df.columns])
        counts = long_form(row, df.columns, "bigint").withColumnRenamed("value", "distinct_values")
    else:
        # One count per (name, value) first: a frequent value is combined before the shuffle.
        counts = (value_counts(df, df.columns).groupBy("name")
                  .agg(F.count(F.lit(1)).alias("distinct_values")))
    fields = df.sparkSession.createDataFrame(
        [(f.name, is_numeric(f.dataType), None if discrete is None else f.name in discrete)
         for f in df.schema.fields], "name string, is_numeric boolean, listed boolean")
    numerical = F.when(F.col("listed").isNotNull(), ~F.col("listed")).otherwise(
        F.col("is_numeric") & (F.col("distinct_values") > unique_thresh))
    return (fields.join(counts, "name", "left")
            .withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))
            .select("name", "distinct_values",
                    F.when(numerical, F.lit(NUMERICAL)).otherwise(F.lit(CATEGORICAL)).alias("kind")))


def vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``name, value, cnt, rank`` (0-based) by falling count, ties by value."""
    ranked = running(value_counts(df, columns), ["name"], [F.col("cnt").desc(), F.col("value")],
                     {"rank": ("sum", F.lit(1).cast("bigint"))})
    return ranked.withColumn("rank", F.col("rank") - 1)


def sorted_vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``name, value, cnt, code`` (0-based) in value order; numbers are ordered as numbers."""
    counts = value_counts(df, columns)
    ranked = running(counts.withColumn("_number", _number(df, columns)), ["name"], [F.col("_number"), F.col("value")],
                     {"code": ("sum", F.lit(1).cast("bigint"))})
    return ranked.withColumn("code", F.col("code") - 1).drop("_number")


def _number(df: DataFrame, columns: Sequence[str]) -> Column:
    """The value as a number if its column is numeric, else null."""
    numeric = [c for c in columns if is_numeric(df.schema[c].dataType)]
    return F.when(F.col("name").isin(numeric), F.col("value").try_cast("double")) if numeric else F.lit(None).cast("double")


def column_metadata(df: DataFrame, meta: TableMeta) -> DataFrame:
    """``name, position, kind, min, max, size``; the vocabulary itself stays in ``vocabulary()``."""
    spark = df.sparkSession
    positions = spark.createDataFrame([(n, i, k) for i, (n, k) in enumerate(meta.kinds.items())],
                                      "name string, position int, kind string")
    parts = []
    if meta.numericals:
        row = df.agg(*[F.struct(F.min(F.col(c).cast("double")).alias("min"),
                                F.max(F.col(c).cast("double")).alias("max")).alias(c) for c in meta.numericals])
        cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`.min").alias("min"),
                                   F.col(f"`{c}`.max").alias("max"), F.lit(None).cast("bigint").alias("size"))
                          for c in meta.numericals])
        parts.append(row.select(F.inline(cells)))
    given = [(c, None, None, len(meta.vocabularies[c])) for c in meta.discretes if c in meta.vocabularies]
    if given:
        parts.append(spark.createDataFrame(given, "name string, min double, max double, size bigint"))
    counted = [c for c in meta.discretes if c not in meta.vocabularies]
    if counted:
        parts.append(value_counts(df, counted).groupBy("name").agg(F.count(F.lit(1)).alias("size")).select(
            "name", F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"), "size"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return positions.join(out, "name", "left")


def fitted_vocabularies(df: DataFrame, columns: Sequence[str], limit: int = 10_000,
                        by_count: bool = False) -> dict[str, list[str]]:
    """Vocabularies as driver lists, for encoders that write them into an expression.

    A column with more than ``limit`` values is refused: use the join based encoders for it.
    """
    if not columns:
        return {}
    most = limit * len(columns)
    rows = value_counts(df, columns).limit(most + 1).collect()
    found: dict[str, list] = {c: [] for c in columns}
    numeric = {c for c in columns if is_numeric(df.schema[c].dataType)}
    for r in rows:
        number = float(r["value"]) if r["name"] in numeric else 0.0
        found[r["name"]].append((-r["cnt"] if by_count else 0, number, r["value"]))
    if len(rows) > most or any(len(pairs) > limit for pairs in found.values()):
        raise ValueError(f"a column of {list(columns)} has more than {limit} values: use the join based encoding")
    return {c: [v for *_, v in sorted(pairs)] for c, pairs in found.items()}


def encoder_statistics(df: DataFrame, meta: TableMeta) -> DataFrame:
    """``name, kind, min, max, mean, size``: what the column encoders are fitted from."""
    base = column_metadata(df, TableMeta(meta.kinds)).select("name", "kind", "min", "max", "size")
    if not meta.numericals:
        return base.withColumn("mean", F.lit(None).cast("double"))
    means = long_form(df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in meta.numericals]),
                      meta.numericals, "double").withColumnRenamed("value", "mean")
    return base.join(means, "name", "left")


def column_indices(meta: TableMeta) -> tuple[list[int], list[int]]:
    """Positions of the categorical and of the ordinal columns."""
    return meta.positions(CATEGORICAL), meta.positions(ORDINAL)
