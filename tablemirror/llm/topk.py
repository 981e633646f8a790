"""Exact top-k inner products by norm buckets.

Vectors are grouped by length (norm) into buckets, longest first. A first pass over the leading bucket gives every
query a lower bound of its k-th best score. A query then visits only the buckets whose longest vector could still
reach that bound, and in each bucket chooses by the local cosine threshold: if even the bucket's own norms rule out
most vectors, they are cut by length; otherwise by the feasible interval of the query's strongest coordinates.
What is left is multiplied out exactly, ties included.

Buckets and query blocks hold a bounded number of rows each, also when all vectors are equal (a bucket of tied
norms is split by hash); a task sees one bucket and one query block at a time. The stated query set meets all
rows block by block, and returns at most k rows a query and bucket.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of other
dimension than the query's score as if padded by zeros; equal scores go by the smaller id; a repeated id is a
candidate of its own for other ids, never for its own id; two query rows of one id are ranked as one query: their best
lists are merged, and a candidate that both found appears once for each; null ids take no part; other columns stay outside; an empty table gives no rows.
Scores are exact as long as they fit a long.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemirror.llm.common import only
from tablemirror.operators.joins import lookup
from tablemirror.session import written

BUCKET_ROWS = 4096
BUCKETS = 1024          # at most, apart from splits of tied norms
QUERY_ROWS = 2048
FOCUS = 4               # coordinates that prune together
EXACT = float(1 << 53)


def quantized(embeddings: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """_id, _v (integer components), _norm of the vectors that take part."""
    component = F.col("_x")
    whole = (F.col("_id").isNotNull() & (F.size(component) > 0)
             & F.forall(component, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return (only(embeddings, _id=key, _x=vector).withColumn("_x", F.col("_x").cast("array<double>")).filter(whole)
            .select("_id", F.transform(component, lambda x: F.floor(x * scale)).alias("_v"))
            .withColumn("_norm", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))))


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, x in enumerate(rows):
        out[i, :len(x)] = x
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; floating point only where it cannot round."""
    bound = a.shape[-1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return np.rint(a.astype(float) @ b.astype(float)).astype(np.int64) if bound < EXACT else a @ b


class Bucket:
    """Vectors of one bucket, longest first, with the sorted coordinates of their directions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray):
        order = np.lexsort((ids, -norms))
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        self.unit = self.vectors / np.maximum(self.norms, 1e-300)[:, None]
        self.by = np.argsort(self.unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.unit, self.by, axis=0)

    def candidates(self, query: np.ndarray, norm: float, bound: float) -> np.ndarray:
        """Positions that may still reach ``bound``."""
        n = len(self.ids)
        if norm == 0 or bound <= 0:
            return np.arange(n)
        slack = 1e-9
        by_length = int(np.searchsorted(-self.norms, -(bound / norm) * (1 - slack), side="right"))
        if by_length == 0:
            return np.arange(0)
        cosine = min(1.0, bound / (norm * self.norms[0]))       # local threshold of the bucket
        direction = query / norm
        focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS]
        along = direction[focus]
        spread = np.sqrt(np.maximum(0.0, (1 - along ** 2) * (1 - cosine ** 2))) + 1e-6
        least = np.where(-along >= cosine, -2.0, cosine * along - spread)       # feasible interval of each coordinate
        most = np.where(along >= cosine, 2.0, cosine * along + spread)
        low = [int(np.searchsorted(self.sorted[:, f], x, side="left")) for f, x in zip(focus, least, strict=True)]
        high = [int(np.searchsorted(self.sorted[:, f], x, side="right")) for f, x in zip(focus, most, strict=True)]
        narrow = int(np.argmin(np.subtract(high, low)))
        if by_length <= high[narrow] - low[narrow]:
            return np.arange(by_length)
        kept = self.by[low[narrow]:high[narrow], focus[narrow]]
        for f, x, y in zip(focus, least, most, strict=True):
            kept = kept[(self.unit[kept, f] >= x) & (self.unit[kept, f] <= y)]
        return kept[kept < by_length]


def best_of(query_id: int, query: np.ndarray, norm: float, bound: float, bucket: Bucket, k: int) -> list[tuple]:
    at = bucket.candidates(query, norm, bound)
    at = at[bucket.ids[at] != query_id]
    if not len(at):
        return []
    scores = products(bucket.vectors[at], query)
    if len(at) > k:
        kth = np.partition(scores, len(at) - k)[len(at) - k]
        keep = scores >= kth
        at, scores = at[keep], scores[keep]
    order = np.lexsort((bucket.ids[at], -scores))[:k]
    return [(query_id, int(bucket.ids[at[i]]), int(scores[i])) for i in order]


def search(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """One query block against one bucket."""
    names = ["query_id", "vec_id", "score"]
    if not len(left) or not len(right):
        return pd.DataFrame(columns=names).astype("int64")
    width = max(max(map(len, left["_v"])), max(map(len, right["_v"])))
    bucket = Bucket(right["_id"].to_numpy(), matrix(right["_v"], width), right["_norm"].to_numpy())
    queries = matrix(left["_v"], width)
    rows = []
    for i, (q, norm, bound) in enumerate(zip(left["_id"], left["_norm"], left["_bound"], strict=True)):
        rows += best_of(int(q), queries[i], norm, bound, bucket, k)
    return pd.DataFrame(rows, columns=names).astype("int64")


def bucketed(vectors: DataFrame, rows: int, bucket_rows: int, buckets: int) -> tuple[DataFrame, list[float]]:
    """Vectors with _bucket (by falling norm) and _part (splits a bucket of tied norms), and the largest norm of
    each bucket. The driver holds at most ``buckets`` numbers."""
    wanted = max(1, min(buckets, math.ceil(rows / bucket_rows)))
    cuts = sorted({float(x) for x in vectors.approxQuantile("_norm", [i / wanted for i in range(1, wanted)], 0.1 / wanted)}
                  if wanted > 1 else set(), reverse=True)
    # Bucket i holds norms in (cuts[i], cuts[i - 1]], the last one the rest.
    place = F.aggregate(F.lit(cuts).cast("array<double>"), F.lit(0), lambda n, c: n + F.when(F.col("_norm") <= c, 1).otherwise(0))
    placed = vectors.withColumn("_bucket", place if cuts else F.lit(0))
    sizes = {r["_bucket"]: (r["n"], r["top"]) for r in placed.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.max("_norm").alias("top")).collect()}
    parts = [max(1, math.ceil(sizes.get(b, (0, 0))[0] / (2 * bucket_rows))) for b in range(len(cuts) + 1)]
    split = F.pmod(F.xxhash64("_id", "_v"), F.get(F.lit(parts).cast("array<int>"), F.col("_bucket"))).cast("int")
    return (placed.withColumn("_part", split).withColumn("_parts", F.get(F.lit(parts).cast("array<int>"), F.col("_bucket"))),
            [sizes.get(b, (0, 0.0))[1] for b in range(len(cuts) + 1)])


def top_k(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5,
          scale: int = 256, bucket_rows: int = BUCKET_ROWS, buckets: int = BUCKETS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by ``every``."""
    vectors = written(quantized(embeddings, key, vector, scale))
    rows = vectors.count()
    placed, tops = bucketed(vectors, rows, bucket_rows, buckets)
    parts = placed.groupBy("_bucket").agg(F.max("_parts").alias("_parts"))
    blocks = max(1, math.ceil(rows / every / query_rows))
    queries = (vectors.filter(F.col("_id") % every == 0).select(*[F.col(c).alias(c) for c in vectors.columns])
               .withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")))
    group = ("_bucket", "_part", "_block")

    def searched(asked: DataFrame, targets: DataFrame) -> DataFrame:
        """``asked`` has _buckets, the array of buckets each query visits."""
        sent = (asked.withColumn("_bucket", F.explode("_buckets")).drop("_buckets")
                .join(F.broadcast(parts), "_bucket").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
                .drop("_parts"))
        # Vectors go only to query blocks that visit their bucket; a bucket that no query can need is not shuffled.
        visits = sent.groupBy("_bucket").agg(F.collect_set("_block").alias("_visits"))
        own = targets.select(*[F.col(c).alias(c) for c in ("_id", "_v", "_norm", "_bucket", "_part")])
        met = lookup(own, visits, ["_bucket"], how="inner").withColumn("_block", F.explode("_visits")).drop("_visits")
        return sent.groupBy(*group).cogroup(met.groupBy(*group)).applyInPandas(
            lambda a, b: search(a, b, k), "query_id long, vec_id long, score long")

    first = searched(queries.withColumn("_bound", F.lit(0.0)).withColumn("_buckets", F.array(F.lit(0))),
                     placed.filter("_bucket = 0"))
    first = written(first)
    # The k-th best so far, if there are k: a score that the final k-th best cannot fall below.
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    bounds = (first.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") == k)
              .select("query_id", F.col("score").alias("_kth")))
    reach = F.filter(F.sequence(F.lit(1), F.lit(max(1, len(tops) - 1))),
                     lambda b: (F.col("_bound") <= 0)
                     | (F.get(F.lit(tops).cast("array<double>"), b) * F.col("_norm") * (1 + 1e-9) >= F.col("_bound")))
    later = (queries.join(bounds, queries["_id"] == bounds["query_id"], "left").drop("query_id")
             .withColumn("_bound", F.coalesce(F.col("_kth").cast("double"), F.lit(0.0))).drop("_kth")
             .withColumn("_buckets", reach if len(tops) > 1 else F.array().cast("array<int>")))
    found = first.unionByName(searched(later, placed.filter("_bucket > 0"))) if len(tops) > 1 else first
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
