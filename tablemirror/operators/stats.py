"""Column statistics of two tables and their similarity; copied and duplicated rows; alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemirror.functions.scores import mape
from tablemirror.operators.joins import distinct_counts, expand_copies
from tablemirror.operators.ordering import running
from tablemirror.operators.profile import sorted_vocabulary, value_counts
from tablemirror.schema import TablePair

STATISTICS = ("min", "max", "mean", "median", "std", "var")

_AGGREGATES = {
    "min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp,
}


def exact_medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by..., name, median`` from value counts: equal values are combined before the shuffle and the
    two middle values are found in the running count, so no column is gathered in one task."""
    keys = [*by, "name"]
    upto = running(value_counts(df, columns, "double", keep=by), keys, [F.col("value")], {"upto": ("sum", F.col("cnt"))})
    sizes = F.broadcast(upto.groupBy(*keys).agg(F.max("upto").alias("n")))      # one row per column
    first, second = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    def holds(position):
        return F.when((F.col("upto") - F.col("cnt") < position) & (F.col("upto") >= position), F.col("value"))
    return upto.join(sizes, keys).groupBy(*keys).agg(
        ((F.max(holds(first)) + F.max(holds(second))) / 2).alias("median"))


def table_statistics(df: DataFrame, columns: Sequence[str], approximate_median: bool = False,
                     by: Sequence[str] = ()) -> DataFrame:
    """``by..., name, min, max, mean, median, std, var`` per numerical column; one pass plus the medians."""
    columns = list(columns)
    aggs = [agg(F.col(c).cast("double")).alias(f"{s}{i}") for i, c in enumerate(columns) for s, agg in _AGGREGATES.items()]
    if approximate_median:
        aggs += [F.percentile_approx(F.col(c).cast("double"), 0.5).alias(f"median{i}") for i, c in enumerate(columns)]
    names = [*_AGGREGATES, *(["median"] if approximate_median else [])]
    cells = F.array(*[F.struct(F.lit(c).alias("name"), *[F.col(f"{s}{i}").alias(s) for s in names])
                      for i, c in enumerate(columns)])
    out = df.groupBy(*by).agg(*aggs).select(*by, F.inline(cells))
    if not approximate_median:
        out = out.join(exact_medians(df, columns, by), [*by, "name"], "left")
    return out.select(*by, "name", *STATISTICS)


def _side_by_side(stats: DataFrame, names: Sequence[str]) -> DataFrame:
    """``name, <stat>_real, <stat>_fake...`` from one row per (origin, name)."""
    return stats.groupBy("name").agg(*[
        F.max(F.when(F.col("origin") == o, F.col(s))).alias(f"{s}_{o}") for s in names for o in ("real", "fake")])


def numeric_statistics(pair: TablePair, chosen: Sequence[str] = STATISTICS, approximate_median: bool = False) -> DataFrame:
    """``name, <stat>_real, <stat>_fake..., sum_diff``: the sum of absolute differences."""
    wide = _side_by_side(table_statistics(pair.stacked(), pair.meta.numericals, approximate_median, ["origin"]), chosen)
    total = F.lit(0.0)
    for s in chosen:
        total = total + F.abs(F.col(f"{s}_real") - F.col(f"{s}_fake"))
    return wide.withColumn("sum_diff", total)


def categorical_statistics(pair: TablePair) -> DataFrame:
    """``name, unique_*, top_*, freq_*, freq_diff``; top is the most frequent value (tie: the smallest)."""
    counts = value_counts(pair.stacked(), pair.meta.discretes, keep=["origin"])
    per_side = counts.groupBy("origin", "name").agg(
        F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("value"))).alias("_top"))
    flat = per_side.select("origin", "name", "unique", F.col("_top.value").alias("top"), (-F.col("_top.neg")).alias("freq"))
    return _side_by_side(flat, ["unique", "top", "freq"]).withColumn("freq_diff", F.col("freq_real") - F.col("freq_fake"))


def statistic_vectors(pair: TablePair) -> DataFrame:
    """``section, item, real, fake``: six values per numerical, three per discrete column.

    The top category enters as its code in the sorted vocabulary of the real table, or in the given vocabulary of
    ``meta.vocabularies`` (a top value outside it has no code).
    """
    parts = []
    if pair.meta.numericals:
        wide = numeric_statistics(pair)
        cells = F.array(*[F.struct(F.concat_ws("_", F.lit(s), "name").alias("item"),
                                   F.col(f"{s}_real").alias("real"), F.col(f"{s}_fake").alias("fake")) for s in STATISTICS])
        parts.append(wide.select(F.lit("numerical").alias("section"), F.inline(cells)))
    if pair.meta.discretes:
        given = {c: list(v) for c, v in pair.meta.vocabularies.items() if c in pair.meta.discretes}
        codes = sorted_vocabulary(pair.real, [c for c in pair.meta.discretes if c not in given]).select(
            "name", "value", F.col("code").cast("long").alias("code"))
        if given:       # the metadata's own lists, on the driver already
            listed = pair.real.sparkSession.createDataFrame(
                [(c, str(v), i) for c, vs in given.items() for i, v in enumerate(vs)], "name string, value string, code long")
            codes = codes.unionByName(listed)
        stats = categorical_statistics(pair)          # one row per column
        for origin in ("real", "fake"):
            top = codes.select("name", F.col("value").alias(f"top_{origin}"), F.col("code").alias(f"code_{origin}"))
            stats = top.join(F.broadcast(stats), ["name", f"top_{origin}"], "right")
        cells = F.array(*[F.struct(F.concat_ws("_", F.lit(s), "name").alias("item"),
                                   F.col(f"{s}_real").cast("double").alias("real"),
                                   F.col(f"{s}_fake").cast("double").alias("fake")) for s in ("unique", "code", "freq")])
        parts.append(stats.select(F.lit("discrete").alias("section"), F.inline(cells)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def statistical_similarity(pair: TablePair, method: str = "spearman") -> DataFrame:
    """``value``: similarity of the statistic vectors, weighted by the number of columns of each kind."""
    vectors = statistic_vectors(pair)
    if method == "spearman":
        # A few rows per column of the tables, so the ranks come from plain windows.
        ranked = vectors.select("section", _average_rank("real").alias("r"), _average_rank("fake").alias("f"))
        scores = ranked.groupBy("section").agg(F.corr("r", "f").alias("v"))
    else:
        scores = vectors.groupBy("section").agg((1 - mape(F.col("real"), F.col("fake"))).alias("v"))
    weight = F.when(F.col("section") == "numerical", F.lit(len(pair.meta.numericals))).otherwise(F.lit(len(pair.meta.discretes)))
    return scores.agg((F.sum(F.col("v") * weight) / F.lit(len(pair.meta.columns))).alias("value"))


def _average_rank(column: str):
    ties = F.count(F.lit(1)).over(Window.partitionBy("section", column))
    return F.rank().over(Window.partitionBy("section").orderBy(column)) + (ties - 1) / 2


# ---------------------------------------------------------------- rows

def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]):
    condition = F.lit(True)
    for c in columns:
        condition = condition & a[c].eqNullSafe(b[c])
    return condition


def copied_rows(pair: TablePair) -> DataFrame:
    """Different fake rows that occur in real, with the number of their ``copies`` in fake."""
    columns = pair.meta.columns
    fake = distinct_counts(pair.fake.select(*columns))
    real = pair.real.select(*columns).distinct()
    # Not a semi join: the optimizer would move that below the counting, onto rows with hot keys.
    return fake.join(real, _same(fake, real, columns)).select(*[fake[c] for c in fake.columns])


def copied_rows_expanded(pair: TablePair) -> DataFrame:
    """Every fake row that occurs in real, copies included."""
    return expand_copies(copied_rows(pair), "copies")


def copied_row_count(pair: TablePair) -> DataFrame:
    return copied_rows(pair).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("copied"))


def duplicate_rows(pair: TablePair) -> DataFrame:
    """``duplicate_real, duplicate_fake``: rows that have at least one equal row in their own table."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return distinct_counts(df.select(*pair.meta.columns)).agg(
            F.coalesce(F.sum(F.when(F.col("copies") > 1, F.col("copies"))), F.lit(0)).alias(name))
    return side(pair.real, "duplicate_real").crossJoin(side(pair.fake, "duplicate_fake"))     # one row each


def align_tables(real: DataFrame, fake: DataFrame, drop: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Give both tables the same columns and types.

    If real has all columns of fake it is reduced to them; else ``drop`` is removed from both and the
    columns of fake take the names of real by position.
    """
    if set(fake.columns) <= set(real.columns):
        real = real.select(*fake.columns)
    else:
        real, fake = real.drop(*(drop or [])), fake.drop(*(drop or []))
        if len(real.columns) != len(fake.columns):
            raise ValueError(f"real has {len(real.columns)} columns and fake {len(fake.columns)}")
        fake = fake.toDF(*real.columns)
    return real, fake.select(*[F.col(c).cast(real.schema[c].dataType).alias(c) for c in real.columns])
