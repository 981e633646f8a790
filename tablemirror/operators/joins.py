"""Joins that stay balanced when one key holds a large share of the rows, and copy counting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemirror.session import cut, hashable

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
TASK_ROWS = 1_000_000       # rows of one key that a task may get
HEAVY_KEYS = 10_000


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    total = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            total = total + F.coalesce(F.size(c), F.lit(0)) * 8
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        total = total + F.lit(16)
    return total


def lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", broadcast_rows: int = BROADCAST_ROWS,
           broadcast_bytes: int = BROADCAST_BYTES, task_rows: int = TASK_ROWS) -> DataFrame:
    """Join many rows to a lookup table with one row (or a few) per key.

    A table of at most ``broadcast_rows`` rows and about ``broadcast_bytes`` bytes is broadcast. A larger one is joined by
    shuffle: a key with more than ``task_rows`` rows is spread over as many tasks as its rows need, by repeating only its
    lookup rows (at most the ``HEAVY_KEYS`` largest keys, which every task knows). Rows with a missing key, which
    match nothing, are spread over all tasks.
    """
    on = list(on)
    table = cut(table)
    size = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(table)), F.lit(0)).alias("b")).first()
    if size["n"] <= broadcast_rows and size["b"] <= broadcast_bytes:
        return rows.join(F.broadcast(table), on, how)
    counts = rows.dropna(subset=on).groupBy(*on).count().filter(F.col("count") > task_rows)
    heavy = cut(counts.orderBy(F.col("count").desc(), *on).limit(HEAVY_KEYS).select(
        *on, F.ceil(F.col("count") / task_rows).alias("_salts")))
    # Depends on the row and its partition only, so a retried task gives the same salt.
    drawn = F.xxhash64(*[F.col(f"`{c}`") for c in hashable(rows)], F.spark_partition_id())
    missing = F.greatest(*[F.col(f"`{c}`").isNull() for c in on], F.lit(False))
    salted_rows = (rows.withColumn("_drawn", drawn).join(F.broadcast(heavy), on, "left")
                   .withColumn("_salt", F.when(missing, F.col("_drawn")).when(
                       F.col("_salts").isNotNull(), F.pmod("_drawn", "_salts")).otherwise(F.lit(0)))
                   .drop("_salts", "_drawn"))
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)).cast("bigint") - 1)
    salted_table = table.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return salted_rows.join(salted_table, [*on, "_salt"], how).drop("_salt")


def distinct_counts(df: DataFrame, count: str = "copies") -> DataFrame:
    """Every different row once, with how often it occurs (combined before the shuffle)."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(count))


def expand_copies(df: DataFrame, count: str, number: str | None = None, chunk: int = 100_000) -> DataFrame:
    """Repeat each row ``count`` times; a row with very many copies is spread over tasks by chunks."""
    keep = [c for c in df.columns if c != count]
    last = ((F.col(count) - 1) / F.lit(chunk)).cast("bigint")
    chunks = (df.filter(F.col(count) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
              .repartition(F.xxhash64(*keep), F.col("_chunk")))
    start = F.col("_chunk") * F.lit(chunk)
    end = F.least(start + F.lit(chunk), F.col(count)) - 1
    out = chunks.withColumn("_number", F.explode(F.sequence(start, end)))
    return out.select(*keep, *([F.col("_number").alias(number)] if number else []))
