"""Exact, repeatable row sampling: without and with replacement, conditional, balanced, split."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemirror.functions.hashing import hash_uniform, key_hash, uniform
from tablemirror.operators.joins import expand_copies, lookup
from tablemirror.operators.ordering import running
from tablemirror.operators.profile import long_form, value_counts
from tablemirror.schema import TablePair

GRID = 1024          # cells a cumulative distribution is cut into for the lookup
EXPECTED = 8         # hash digits that are counted near the place where a sample is expected to end
INDEX_DIGITS = 4     # hash digits per index bucket: 65 536 buckets


def exact_sample(df: DataFrame, n: int, key: Sequence[str] | None = None, seed: int = 0,
                 stream: str = "sample", rows: int | None = None) -> DataFrame:
    """Exactly ``n`` rows without replacement: those with the smallest key hashes.

    The n-th smallest hash is found by refining a histogram of hash prefixes (at most 65 536 rows per
    step), so the result is a plain filter of the table - no global sort. If the number of ``rows`` is known, one pass over
    long prefixes near the place where the hash is expected mostly does (about 6 sqrt(rows) prefixes). Rows with equal hashes
    are equal rows if the key is the whole row (the default); as many copies as fit are kept.
    """
    key = list(df.columns if key is None else key)
    hashed = key_hash(seed, stream, *key)
    if n <= 0:
        return df.limit(0)
    hashes = df.select(hashed.alias("h"))
    prefix, before = "", 0
    if rows and n < rows:
        width = max(6.0 * math.sqrt(n / rows * (1 - n / rows) / rows), 1.0 / rows)
        low, high = (format(min(max(int((n / rows + d) * 16 ** EXPECTED), 0), 16 ** EXPECTED - 1), f"0{EXPECTED}x") for d in (-width, width))
        p = F.substring("h", 1, EXPECTED)
        # Below the place ("") and above it ("g") only the number matters.
        near = hashes.groupBy(F.when(p < low, F.lit("")).when(p > high, F.lit("g")).otherwise(p).alias("p")).agg(F.count(F.lit(1)).alias("cnt"))
        hit = near.select("p", "cnt", F.sum("cnt").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)).alias("cum")).filter(
            F.col("cum") >= n).orderBy("p").first()
        if hit is not None and hit["p"] not in ("", "g"):
            if hit["cum"] == n:
                return df.filter(F.substring(hashed, 1, EXPECTED) <= hit["p"])
            before, prefix = hit["cum"] - hit["cnt"], hit["p"]
    while len(prefix) < 32:
        digits = len(prefix) + 4
        counts = (hashes.filter(F.col("h").startswith(prefix)).groupBy(F.substring("h", 1, digits).alias("p"))
                  .agg(F.count(F.lit(1)).alias("cnt")))
        upto = counts.select("p", "cnt", F.sum("cnt").over(
            Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
        hit = upto.filter(F.col("cum") >= n - before).orderBy("p").first()
        if hit is None:
            return df
        if before + hit["cum"] == n:
            return df.filter(F.substring(hashed, 1, digits) <= hit["p"])
        before, prefix = before + hit["cum"] - hit["cnt"], hit["p"]
    full = df.filter(hashed < F.lit(prefix))
    missing = n - before
    edge = df.filter(hashed == F.lit(prefix))
    if len(key) < len(df.columns):
        different = edge.distinct().limit(2).count()
        if different > 1:
            raise ValueError("the sampling key is not unique")
    copy = edge.limit(1).withColumn("_copies", F.lit(missing).cast("bigint"))
    return full.unionByName(expand_copies(copy, "_copies").select(*df.columns))


def equal_length(pair: TablePair, key: Sequence[str] | None = None, seed: int = 0) -> TablePair:
    """Cut both tables to the length of the shorter one."""
    n_real, n_fake = pair.real.count(), pair.fake.count()
    n = min(n_real, n_fake)
    real = pair.real if n_real == n else exact_sample(pair.real, n, key, seed, "equal", n_real)
    fake = pair.fake if n_fake == n else exact_sample(pair.fake, n, key, seed, "equal", n_fake)
    return TablePair(real.select(*pair.meta.columns), fake.select(*pair.meta.columns), pair.meta)


def split(df: DataFrame, key: Sequence[str], train: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train and test parts by key hash: no shuffle, and a row never changes sides."""
    u = uniform(seed, "split", *key)
    return df.filter(u < train), df.filter(u >= train)


def shuffle_cap(df: DataFrame, key: Sequence[str] | None, n: int | None = None, seed: int = 0) -> DataFrame:
    """At most ``n`` rows in hash order before feature making; ``None`` keeps all rows."""
    return df if n is None else exact_sample(df, n, key, seed, "features")


def dense_index(df: DataFrame, key: Sequence[str], seed: int = 0, stream: str = "index",
                within: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """Number the rows 0, 1, 2... by key hash, per ``within`` group if given.

    The hash splits every group, also one with most of the rows, into even buckets that are numbered
    apart and shifted by the sizes of the buckets before them. The key has to be unique.
    """
    hashed = df.withColumn("_h", key_hash(seed, stream, *key)).withColumn(
        "_bucket", F.substring("_h", 1, INDEX_DIGITS))
    groups = [*within, "_bucket"]
    sizes = hashed.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*groups).orderBy("_h"))
    return (hashed.withColumn("_inside", inside).join(offsets, groups)
            .withColumn(name, F.col("_before") + F.col("_inside") - 1)
            .drop("_h", "_bucket", "_inside", "_before"))


def draw_positions(df: DataFrame, n: int, size: int, seed: int, stream: str) -> DataFrame:
    """``draw, idx``: n uniform row positions."""
    u = uniform(seed, stream, F.col("id"))
    return df.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(u * F.lit(size)).alias("idx"))


def sample_with_replacement(df: DataFrame, n: int, key: Sequence[str], seed: int = 0,
                            stream: str = "bootstrap") -> DataFrame:
    """``draw`` and the columns of a uniformly drawn row, n times."""
    size = df.count()
    if not size:
        return df.withColumn("draw", F.lit(0).cast("bigint")).limit(0)
    draws = draw_positions(df, n, size, seed, stream)
    return draws.join(dense_index(df, key, seed), "idx").drop("idx")


def category_row_index(df: DataFrame, columns: Sequence[str], key: Sequence[str], seed: int = 0) -> DataFrame:
    """``name, value, idx, key...``: for every category the numbered list of its rows."""
    cells = long_form(df, columns, "string", keep=key).filter(F.col("value").isNotNull())
    return dense_index(cells, key, seed, "category", within=["name", "value"])


def conditional_sample(df: DataFrame, requests: DataFrame, columns: Sequence[str], key: Sequence[str],
                       seed: int = 0) -> DataFrame:
    """One random matching row per request ``(request, name, value)``: ``request, name, value, key...``.

    A request for a category without rows gets none. Requests spread over the rows of a category; if
    most of them ask for a category with a single row, adaptive execution splits that join key.
    """
    sizes = value_counts(df, columns)
    u = uniform(seed, "condition", F.col("request"))
    asked = lookup(requests, sizes, ["name", "value"], "inner").withColumn("idx", F.floor(u * F.col("cnt")))
    index = category_row_index(df, columns, key, seed)
    return asked.join(index, ["name", "value", "idx"]).select("request", "name", "value", *key)


def category_pmf(df: DataFrame, columns: Sequence[str], log_smoothing: bool = True) -> DataFrame:
    """``name, value, cnt, p``: probabilities from log(count + 1), or from the counts themselves."""
    counts = value_counts(df, columns)
    weight = F.log1p(F.col("cnt").cast("double")) if log_smoothing else F.col("cnt").cast("double")
    weighted = counts.withColumn("_w", weight)
    # One row per column.
    totals = weighted.groupBy("name").agg(F.sum("_w").alias("_total"))
    return weighted.join(F.broadcast(totals), "name").select("name", "value", "cnt", (F.col("_w") / F.col("_total")).alias("p"))


def cumulative(pmf: DataFrame, group: Sequence[str], order: Sequence[str], p: str = "p") -> DataFrame:
    """Add the probability interval ``lo, hi`` of each row; the last one of a group ends at 1."""
    ups = running(pmf, group, [F.col(o) for o in order], {"hi": ("sum", F.col(p))})
    # Rounded alike, so that an interval starts exactly where the one before it ends and no draw falls between.
    downs = ups.withColumn("lo", F.round(F.col("hi") - F.col(p), 12)).withColumn("hi", F.round("hi", 12))
    last = downs.groupBy(*group).agg(F.max("hi").alias("_top"))
    both = downs.join(last, list(group)) if group else downs.crossJoin(F.broadcast(last))      # one row
    # Rounding must not leave a gap below 1.
    return both.withColumn("hi", F.when(F.col("hi") == F.col("_top"), F.lit(2.0)).otherwise(F.col("hi"))).drop("_top")


def cdf_lookup(draws: DataFrame, cdf: DataFrame, on: Sequence[str], u: str, values: Sequence[str]) -> DataFrame:
    """Inverse sampling: give each draw the row of its group whose interval holds ``u``.

    Both sides meet in one of ``GRID`` cells of [0, 1), so a draw is compared with the few intervals
    of its cell and even a single group is spread over ``GRID`` keys.
    """
    cell = F.floor(F.col(u) * F.lit(GRID)).cast("int")
    first = F.floor(F.col("lo") * F.lit(GRID)).cast("int")
    final = F.floor(F.least(F.col("hi"), F.lit(1.0)) * F.lit(GRID)).cast("int")
    gridded = cdf.filter(F.col("lo") < 1.0).select(
        *on, "lo", "hi", *values,
        F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(final, F.lit(GRID - 1)))).alias("_cell"))
    keys = [*on, "_cell"]
    joined = lookup(draws.withColumn("_cell", cell), gridded, keys, "inner")
    return joined.filter((F.col(u) >= F.col("lo")) & (F.col(u) < F.col("hi"))).drop("_cell", "lo", "hi")


def condition_draws(df: DataFrame, columns: Sequence[str], n: int, seed: int = 0, log_smoothing: bool = True,
                    vectors: bool = False) -> DataFrame:
    """n conditions: a uniformly drawn discrete column, then a category by (log-smoothed) frequency.

    ``draw, column_id, name, category_id, value`` and, on demand, the one-hot condition vector and the
    column mask. Categories are numbered in value order.
    """
    columns = list(columns)
    pmf = category_pmf(df, columns, log_smoothing)
    numbered = running(pmf, ["name"], [F.col("value")], {"category_id": ("sum", F.lit(1).cast("bigint"))})
    cdf = cumulative(numbered.withColumn("category_id", F.col("category_id") - 1), ["name"], ["value"])
    names = F.array(*[F.lit(c) for c in columns])
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw"),
        F.floor(uniform(seed, "column", F.col("id")) * F.lit(len(columns))).cast("int").alias("column_id"),
        uniform(seed, "category", F.col("id")).alias("_u"))
    draws = draws.withColumn("name", F.element_at(names, F.col("column_id") + 1))
    out = cdf_lookup(draws, cdf, ["name"], "_u", ["category_id", "value"]).select(
        "draw", "column_id", "name", "category_id", "value")
    if not vectors:
        return out
    sizes = {r["name"]: r["size"] for r in pmf.groupBy("name").agg(F.count(F.lit(1)).alias("size")).collect()}
    starts, width = [], 0
    for c in columns:
        starts.append(width)
        width += sizes.get(c, 0)
    hot = F.element_at(F.array(*[F.lit(s) for s in starts]), F.col("column_id") + 1) + F.col("category_id")
    return out.withColumn("vector", one_hot_at(hot, width)).withColumn(
        "mask", one_hot_at(F.col("column_id"), len(columns)))


def one_hot_at(position: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == position).cast("double"))


def fixed_condition_sample(df: DataFrame, column: str, value, n: int, key: Sequence[str],
                           seed: int = 0) -> DataFrame:
    """n rows drawn with replacement among those with ``column = value``."""
    return sample_with_replacement(df.filter(F.col(column) == F.lit(value)), n, key, seed, "fixed")


__all__ = ["exact_sample", "equal_length", "split", "shuffle_cap", "dense_index", "sample_with_replacement",
           "category_row_index", "conditional_sample", "category_pmf", "cumulative", "cdf_lookup",
           "condition_draws", "fixed_condition_sample", "hash_uniform"]
