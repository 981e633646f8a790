"""Association of mixed-type columns, and distances between association matrices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemirror.functions.scores import cosine_distance, mae, mse, pairwise_rows, rmse
from tablemirror.operators.joins import lookup
from tablemirror.operators.profile import long_form
from tablemirror.schema import TableMeta, TablePair

PAIRS = 200         # column pairs a task hands over at once; wider tables take several, with the same result
CONSTANT = 1e-13    # a variance that is so small a part of the squares is the rounding of a constant column
GROUPS = 100        # groups whose sums a task holds

COMBINED = 1_000_000     # up to this many combinations of all discrete columns rows are combined first


def _cell(a: str, b: str, value: Column) -> Column:
    return F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), value.alias("value"))


def _attach(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add totals that have one row per group of ``by`` (a single row without groups)."""
    return df.join(F.broadcast(small), list(by)) if by else df.crossJoin(F.broadcast(small))


def numeric_association(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by..., col_a, col_b, value``: Pearson correlation of all ordered pairs, each over the rows where both are known.

    A task turns Arrow batches into a few sums for each pair, centred at the group's means; an aggregate adds them.
    """
    columns = list(columns)
    doubles = df.select(*by, *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    averages = [F.avg(f"_x{i}").alias(f"_m{i}") for i in range(len(columns))]
    found = doubles.groupBy(*by).agg(*averages)
    groups = (found.orderBy(*by).limit(GROUPS) if by else found).collect()       # others are centred at 0
    means = {tuple(r[:len(by)]): np.nan_to_num(np.array(r[len(by):], dtype=float), posinf=0.0, neginf=0.0) for r in groups}
    vectors = doubles.select(*by, F.array(*[f"_x{i}" for i in range(len(columns))]).alias("_x"))
    keys = [f for f in vectors.schema.fields if f.name in by]
    sums = ["n", "bad", "sx", "sy", "sxx", "syy", "sxy"]
    schema = T.StructType([*keys, T.StructField("_i", T.IntegerType()), T.StructField("_j", T.IntegerType()),
                           *[T.StructField(s, T.DoubleType()) for s in sums]])
    added = (vectors.mapInArrow(_pair_sums(means, len(columns), list(by), sums, PAIRS), schema).groupBy(*by, "_i", "_j")
             .agg(*[F.sum(s).alias(s) for s in sums]))
    vx, vy = (F.col(s2) - F.try_divide(F.col(s1) * F.col(s1), F.col("n")) for s1, s2 in (("sx", "sxx"), ("sy", "syy")))
    constant = (vx <= F.col("sxx") * F.lit(CONSTANT)) | (vy <= F.col("syy") * F.lit(CONSTANT))
    r = F.try_divide(F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n")), F.sqrt(vx) * F.sqrt(vy))
    value = (F.when(F.col("n") == 0, F.lit(None)).when(F.col("bad") > 0, F.lit(float("nan")))
             .when(constant, F.lit(None)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))))
    names = F.array(*[F.lit(c) for c in columns])
    a, b = F.get(names, F.col("_i")), F.get(names, F.col("_j"))
    return added.select(*by, F.inline(F.array(F.struct(a.alias("col_a"), b.alias("col_b"), value.alias("value")),
                                              F.struct(b.alias("col_a"), a.alias("col_b"), value.alias("value")))))


def _pair_sums(means: dict[tuple, np.ndarray], width: int, by: list[str], names: list[str], pairs: int):
    """Of one task, for each group and pair of columns: rows where both are known, those where one is not finite, sums,
    squares and products of the others."""
    first, second = np.triu_indices(width, 1)

    def rows(totals: dict[tuple, tuple]) -> Iterator[pa.RecordBatch]:
        for key, (n, bad, x, xx, xy) in totals.values():
            for at in range(0, len(first), pairs):
                i, j = first[at:at + pairs], second[at:at + pairs]
                keys = [pa.concat_arrays([key.column(c)] * len(i)) for c in by]
                values = [n[i, j], bad[i, j], x[i, j], x[j, i], xx[i, j], xx[j, i], xy[i, j]]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(i.astype("int32")), pa.array(j.astype("int32")),
                                                  *[pa.array(v) for v in values]], names=[*by, "_i", "_j", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("_x").flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(batch.num_rows, -1)
            known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(x.shape)
            if by:
                coded = batch.select(by).to_pandas().groupby(by, dropna=False, sort=False).ngroup().to_numpy()
                parts = [np.flatnonzero(coded == g) for g in range(coded.max() + 1)]
            else:
                parts = [slice(None)]
            for at in parts:
                key = batch.select(by).slice(int(at[0]), 1) if by else None
                name = tuple(key.to_pylist()[0].values()) if by else ()
                v, k = x[at] - means.get(name, 0.0), known[at]
                wild = k & ~np.isfinite(v)
                v, k = np.where(k & ~wild, v, 0.0), k.astype(float)
                w, good = wild.astype(float), k - wild
                one = np.stack((k.T @ k, w.T @ k + k.T @ w, v.T @ good, (v * v).T @ good, v.T @ v))
                totals[name] = (key, one + totals[name][1] if name in totals else one)
            if len(totals) > GROUPS:
                yield from rows(totals)
                totals = {}
        yield from rows(totals)
    return run


def correlation_ratio(df: DataFrame, nominal: Sequence[str], numeric: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by..., nominal, numeric, value``: eta, from group sizes and means of all pairs in one pass."""
    numeric = list(numeric)
    totals = df.groupBy(*by).agg(*[a for i, c in enumerate(numeric) for a in (
        F.avg(F.col(c).cast("double")).alias(f"m{i}"),
        (F.var_pop(F.col(c).cast("double")) * F.count(c)).alias(f"t{i}"))])
    groups = long_form(df, nominal, "string", keep=[*by, *numeric]).groupBy(*by, "name", "value").agg(
        *[a for i, c in enumerate(numeric) for a in (F.avg(F.col(c).cast("double")).alias(f"gm{i}"),
                                                     F.count(c).alias(f"gn{i}"))])
    joined = _attach(groups, totals, by)
    between = joined.groupBy(*by, "name").agg(*[
        F.sqrt(F.coalesce(F.try_divide(
            F.sum(F.col(f"gn{i}") * (F.col(f"gm{i}") - F.col(f"m{i}")) * (F.col(f"gm{i}") - F.col(f"m{i}"))),
            F.first(f"t{i}")), F.lit(0.0))).alias(f"e{i}") for i in range(len(numeric))])
    cells = F.array(*[F.struct(F.lit(c).alias("numeric"), F.least(F.col(f"e{i}"), F.lit(1.0)).alias("value"))
                      for i, c in enumerate(numeric)])
    return between.select(*by, F.col("name").alias("nominal"), F.inline(cells))


def pair_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by..., col_a, col_b, a, b, cnt`` for every unordered pair, and each column with itself."""
    columns = list(columns)
    texts = df.select(*by, *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000NULL")).alias(c) for c in columns])
    combinations_seen = texts.agg(F.approx_count_distinct(F.xxhash64(*columns))).first()[0]
    if combinations_seen <= COMBINED:
        # Combine equal rows first, so a combination meets every column pair once.
        texts = texts.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("_n"))
    else:
        # Too many combinations to be worth a shuffle: the pair counts combine on the map side.
        texts = texts.withColumn("_n", F.lit(1).cast("bigint"))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cells = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(a).alias("a"), F.col(b).alias("b"))
                      for a, b in pairs])
    return (texts.select(*by, "_n", F.inline(cells)).groupBy(*by, "col_a", "col_b", "a", "b")
            .agg(F.sum("_n").alias("cnt")))


def entropy(cnt: Column) -> Column:
    """Entropy (nats) of counts, as an aggregate."""
    c = cnt.cast("double")
    return F.log(F.sum(c)) - F.sum(c * F.log(c)) / F.sum(c)


def theils_u(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by..., col_a, col_b, value``: uncertainty coefficient U(col_a given col_b) for ordered pairs;
    1 where col_a is constant."""
    joint = pair_counts(df, columns, by).groupBy(*by, "col_a", "col_b").agg(entropy(F.col("cnt")).alias("h"))
    # One row per pair of columns: own entropies are those of a column with itself.
    own = joint.filter(F.col("col_a") == F.col("col_b"))
    ha = F.broadcast(own.select(*by, "col_a", F.col("h").alias("ha")))
    hb = F.broadcast(own.select(*by, "col_b", F.col("h").alias("hb")))
    full = joint.filter(F.col("col_a") != F.col("col_b")).join(ha, [*by, "col_a"]).join(hb, [*by, "col_b"])
    mutual = F.col("ha") + F.col("hb") - F.col("h")
    def u(h):
        return F.when(F.abs(h) < 1e-15, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(mutual, h))))
    cells = F.array(F.struct("col_a", "col_b", u(F.col("ha")).alias("value")),
                    F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), u(F.col("hb")).alias("value")))
    return full.select(*by, F.inline(cells))


def cramers_v(df: DataFrame, columns: Sequence[str], bias_correction: bool = True,
              by: Sequence[str] = ()) -> DataFrame:
    """``by..., col_a, col_b, value``: Cramer's V for ordered pairs, optionally bias corrected."""
    counts = pair_counts(df, columns, by)
    cells = counts.filter(F.col("col_a") != F.col("col_b"))
    own = counts.filter(F.col("col_a") == F.col("col_b"))
    na = own.select(*by, "col_a", "a", F.col("cnt").alias("na"))
    nb = own.select(*by, "col_b", "b", F.col("cnt").alias("nb"))
    sizes = own.groupBy(*by, "col_a").agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("cnt").cast("double").alias("n"))
    # chi2 = n * (sum c^2 / (na * nb) - 1) needs only the cells that occur.
    sized = lookup(lookup(cells, na, [*by, "col_a", "a"], "inner"), nb, [*by, "col_b", "b"], "inner")
    share = (sized.groupBy(*by, "col_a", "col_b")
             .agg(F.sum(F.col("cnt").cast("double") * F.col("cnt") / (F.col("na").cast("double") * F.col("nb"))).alias("s")))
    ka = F.broadcast(sizes.select(*by, "col_a", F.col("k").alias("ka"), "n"))
    kb = F.broadcast(sizes.select(*by, F.col("col_a").alias("col_b"), F.col("k").alias("kb")))
    full = share.join(ka, [*by, "col_a"]).join(kb, [*by, "col_b"])
    phi2 = F.greatest(F.col("s") - 1, F.lit(0.0))
    if bias_correction:
        n1 = F.col("n") - 1
        top = F.greatest(F.lit(0.0), phi2 - (F.col("ka") - 1) * (F.col("kb") - 1) / n1)
        bottom = F.least(F.col("ka") - (F.col("ka") - 1) * (F.col("ka") - 1) / n1,
                         F.col("kb") - (F.col("kb") - 1) * (F.col("kb") - 1) / n1) - 1
    else:
        top, bottom = phi2, F.least("ka", "kb") - 1
    v = F.coalesce(F.sqrt(F.try_divide(top, bottom)), F.lit(0.0))
    both = full.select(*by, "col_a", "col_b", v.alias("value"))
    return both.unionByName(both.select(*by, F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "value"))


def association_matrix(df: DataFrame, meta: TableMeta, nominal: str = "theil", by: Sequence[str] = ()) -> DataFrame:
    """``by..., col_a, col_b, value`` for all ordered pairs, 1 on the diagonal."""
    numeric, discrete = meta.numericals, meta.discretes
    diagonal = F.array(*[_cell(c, c, F.lit(1.0)) for c in meta.columns])
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1)
    out = groups.select(*by, F.inline(diagonal))
    if len(numeric) > 1:
        out = out.unionByName(numeric_association(df, numeric, by))
    if len(discrete) > 1:
        out = out.unionByName(theils_u(df, discrete, by) if nominal == "theil" else cramers_v(df, discrete, by=by))
    if numeric and discrete:
        eta = correlation_ratio(df, discrete, numeric, by)
        cells = F.array(F.struct(F.col("nominal").alias("col_a"), F.col("numeric").alias("col_b"), "value"),
                        F.struct(F.col("numeric").alias("col_a"), F.col("nominal").alias("col_b"), "value"))
        out = out.unionByName(eta.select(*by, F.inline(cells)))
    return out


def association_difference(pair: TablePair, nominal: str = "theil") -> DataFrame:
    """``col_a, col_b, real, fake, diff`` with the absolute difference; both tables in one plan."""
    both = association_matrix(pair.stacked(), pair.meta, nominal, ["origin"])
    wide = both.groupBy("col_a", "col_b").agg(*[
        F.max(F.when(F.col("origin") == o, F.col("value"))).alias(o) for o in ("real", "fake")])
    return wide.withColumn("diff", F.abs(F.col("real") - F.col("fake")))


def association_distance(difference: DataFrame) -> DataFrame:
    """``metric, value``: rmse, mae, mse and cosine of the matrices, Pearson of their off-diagonals."""
    real, fake = F.col("real"), F.col("fake")
    off = F.col("col_a") != F.col("col_b")
    row = difference.agg(rmse(real, fake).alias("rmse"), mae(real, fake).alias("mae"), mse(real, fake).alias("mse"),
                         cosine_distance(real, fake).alias("cosine"),
                         F.corr(F.when(off, real), F.when(off, fake)).alias("pearsonr"))
    names = ["rmse", "mae", "mse", "cosine", "pearsonr"]
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))


def association_row_distance(difference: DataFrame) -> DataFrame:
    """Euclidean distances between every row of the real and every row of the fake matrix."""
    return pairwise_rows(difference.select("col_a", "col_b", F.col("real").alias("value")),
                         difference.select("col_a", "col_b", F.col("fake").alias("value")),
                         "col_a", "col_b", "value").select("row_a", "row_b", "euclidean")
