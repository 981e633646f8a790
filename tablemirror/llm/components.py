"""Connected components by repeated contraction, without collecting edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemirror.session import written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component`` for every node of an edge; ``component`` is the smallest node reachable.

    Each round every node points to its first neighbour in an order drawn anew by hash, or to itself, so that chains shrink
    by a constant factor; edges are rewritten between
    the nodes pointed to, and vanish inside a contracted group. Sums per node are combined before shuffles; an edge
    table has one row an edge, whatever a node's degree. Null ends are dropped; an empty table gives no rows.
    """
    # Parquet instead of checkpoints: a checkpoint hands its plan's inferred constraints on to the next round, which grow.
    live = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
                   .filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    place = written(live.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("at")))
    salt = 0
    while live.take(1):
        salt += 1
        both = live.select("u", "v").unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min(F.struct(F.xxhash64(F.lit(salt), "v").alias("h"), F.col("v"))).alias("_best"))
        own = F.struct(F.xxhash64(F.lit(salt), "u").alias("h"), F.col("u").alias("v"))
        point = written(near.select("u", F.least(F.col("_best"), own)["v"].alias("p")))
        left, right = (point.select(F.col("u").alias(x), F.col("p").alias(f"p{x}")) for x in ("u", "v"))
        live = written(live.join(left, "u").join(right, "v").filter("pu <> pv").select(
            F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        moved = point.select(F.col("u").alias("at"), "p")
        place = written(place.join(moved, "at", "left").select("node", F.coalesce("p", "at").alias("at")))
    least = place.groupBy("at").agg(F.min("node").alias("component"))
    return place.join(least, "at").select("node", "component")
