"""Running aggregates over a global order, without a one-task window.

A window ordered over a whole column sends that column to one task. ``running`` does so only while
every group is small; beyond that it range-partitions the rows, aggregates inside each range and adds
what the earlier ranges carry over.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemirror.session import cut, cut_counted

ROWS_PER_TASK = 1_000_000

_AGGREGATES = {
    "sum": (F.sum, lambda carried, local: F.coalesce(carried, F.lit(0)) + local),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column],
            aggs: dict[str, tuple[str, Column]], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add running (inclusive) sums, maxima or minima per group, in the given order.

    ``aggs`` maps a new column to ``(function, expression)``. The order must be total within a group
    (compress equal values to counts first), which also rules out a hot value.
    """
    base, rows = cut_counted(df)
    largest = rows
    if rows > rows_per_task:
        largest = base.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if largest <= rows_per_task:
        window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return base.select("*", *[_AGGREGATES[fn][0](expr).over(window).alias(name)
                                  for name, (fn, expr) in aggs.items()])

    ranges = math.ceil(rows / rows_per_task)
    inputs = base.select("*", *[expr.alias(f"_in_{name}") for name, (_, expr) in aggs.items()])
    # Materialised, so that both readers below see the same ranges.
    ranged = cut(inputs.repartitionByRange(ranges, *[F.col(g) for g in group], *order)
                 .withColumn("_range", F.spark_partition_id()))
    window = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[_AGGREGATES[fn][0](F.col(f"_in_{name}")).over(window).alias(f"_local_{name}")
                                 for name, (fn, _) in aggs.items()])
    # One row per group and range it touches: at most groups + ranges rows.
    totals = ranged.groupBy("_range", *group).agg(
        *[_AGGREGATES[fn][0](f"_in_{name}").alias(f"_total_{name}") for name, (fn, _) in aggs.items()])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_range").alias("_crange"), *[F.col(g).alias(f"_c_{g}") for g in group],
        *[_AGGREGATES[fn][0](F.col(f"_total_{name}")).over(before).alias(f"_carry_{name}")
          for name, (fn, _) in aggs.items()])
    match = F.col("_range") == F.col("_crange")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_c_{g}"))
    joined = local.join(carried, match, "left")
    return joined.select(
        *df.columns, *[_AGGREGATES[fn][1](F.col(f"_carry_{name}"), F.col(f"_local_{name}")).alias(name)
                       for name, (fn, _) in aggs.items()])
