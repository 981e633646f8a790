"""Imputation, category codes and numeric encodings shared by two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemirror.operators.joins import lookup
from tablemirror.operators.ordering import running
from tablemirror.operators.profile import fitted_vocabularies
from tablemirror.schema import TableMeta, TablePair

MISSING = "[NAN]"


def impute_categorical(df: DataFrame, columns: Sequence[str], value: str = MISSING) -> DataFrame:
    """NULL categories become ``[NAN]``."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(value)) for c in columns})


def impute_numerical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL (and NaN) numbers become the column mean of the others."""
    cleaned = df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns})
    means = cleaned.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return cleaned.fillna({c: means[c] for c in columns if means[c] is not None})


def first_appearance_codes(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """``value, code``: codes in the order in which the values first appear."""
    firsts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.min(order_by).alias("_first"))
    coded = running(firsts, [], [F.col("_first"), F.col("value")], {"code": ("sum", F.lit(1).cast("bigint"))})
    return coded.select("value", (F.col("code") - 1).alias("code"))


def frequency_codes(df: DataFrame, column: str) -> DataFrame:
    """``value, code``: codes by falling count, ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("_cnt"))
    coded = running(counts, [], [F.col("_cnt").desc(), F.col("value")], {"code": ("sum", F.lit(1).cast("bigint"))})
    return coded.select("value", (F.col("code") - 1).alias("code"))


def factorize(df: DataFrame, column: str, order_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The table with ``column`` replaced by integer codes (missing: -1), and the mapping."""
    mapping = frequency_codes(df, column) if order_by is None else first_appearance_codes(df, column, order_by)
    codes = mapping.withColumnRenamed("value", column)
    joined = lookup(df, codes, [column])
    return (joined.withColumn(column, F.coalesce("code", F.lit(-1).cast("bigint"))).select(*df.columns), mapping)


def encode_codes(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace values by the codes of a mapping fitted elsewhere; an unseen value gives NULL."""
    codes = mapping.select(F.col("value").alias(column), "code")
    return lookup(df, codes, [column]).withColumn(column, F.col("code")).select(*df.columns)


def decode_codes(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace codes by their values."""
    values = mapping.select(F.col("code").alias(column), "value")
    return lookup(df, values, [column]).withColumn(column, F.col("value")).select(*df.columns)


def shared_target(pair: TablePair, column: str, order_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Label codes fitted on real and used for both tables."""
    real, mapping = factorize(pair.real, column, order_by)
    return real, encode_codes(pair.fake, column, mapping)


def numeric_columns(meta: TableMeta, vocabularies: dict[str, list[str]]) -> dict[str, Column]:
    """Named numeric expressions: numericals as they are, a column of at most two categories as its
    code, others as one 0/1 column per category; sorted by name."""
    out: dict[str, Column] = {}
    for name in meta.columns:
        if name in meta.discretes:
            values = vocabularies[name]
            text = F.col(name).cast("string")
            if len(values) <= 2:
                code = F.lit(None).cast("double")
                for i, v in reversed(list(enumerate(values))):
                    code = F.when(text == v, F.lit(float(i))).otherwise(code)
                out[name] = code
            else:
                for v in values:
                    out[f"{name}_{v}"] = F.coalesce((text == v).cast("double"), F.lit(0.0))
        else:
            out[name] = F.col(name).cast("double")
    return dict(sorted(out.items()))


def numeric_encoding(pair: TablePair, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables in the numeric columns of the real table: a category that only fake has gets no
    column, one that only real has is 0 in fake."""
    vocabularies = fitted_vocabularies(pair.real, pair.meta.discretes)
    columns = numeric_columns(pair.meta, vocabularies)
    chosen = [c.alias(n) for n, c in columns.items()]
    return pair.real.select(*keep, *chosen), pair.fake.select(*keep, *chosen), list(columns)


def zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre and scale by the table's own mean and sample standard deviation (NULL if constant)."""
    aggs = [f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    row = df.agg(*aggs).first()
    scaled = {}
    for i, c in enumerate(columns):
        spread = row[f"s_{i}"]
        scaled[c] = ((F.col(c) - F.lit(row[f"m_{i}"])) / F.lit(spread)) if spread else F.lit(None).cast("double")
    return df.withColumns(scaled)


def project(df: DataFrame, columns: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """The wanted columns in sorted order; one the table lacks is 0."""
    wanted = sorted(c for c in columns if c not in drop)
    return df.select(*[F.col(c) if c in df.columns else F.lit(0).alias(c) for c in wanted])
