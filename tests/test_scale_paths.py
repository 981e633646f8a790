"""The plans taken for large inputs, forced on small ones."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablemirror.functions import scores
from tablemirror.operators import assoc, encode, joins, nearest, ordering, rankpair, sample
from tablemirror.operators import clean
from tablemirror.schema import TableMeta, TablePair


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def values(spark):
    data = [("a" if i % 3 else "b", float((i * 7919) % 1009), 1 + i % 4) for i in range(1500)]
    return spark.createDataFrame(data, "g string, v double, c long").groupBy("g", "v").agg(F.sum("c").alias("c"))


@pytest.mark.parametrize("group", [["g"], []])
def test_running_in_ranges_equals_one_window(spark, values, group):
    df = values if group else values.groupBy("v").agg(F.sum("c").alias("c"))
    aggs = {"s": ("sum", F.col("c")), "hi": ("max", F.when(F.col("c") > 2, F.col("v"))), "lo": ("min", F.col("v"))}
    small = ordering.running(df, group, [F.col("v")], aggs)
    large = ordering.running(df, group, [F.col("v")], aggs, rows_per_task=50)
    assert rows(small) == rows(large)
    down = ordering.running(df, group, [F.col("v").desc()], {"s": ("sum", F.col("c"))}, rows_per_task=50)
    window = Window.partitionBy(*group).orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, 0)
    assert rows(down) == rows(df.withColumn("s", F.sum("c").over(window)))


def test_lookup_with_a_hot_key_equals_plain_join(spark):
    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 400).alias("k"))
    table = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    # A missing key, a lookup row without key, and values as wide as a broadcast must not be.
    left = left.unionByName(spark.range(3000, 3500).select("id", F.lit(None).cast("bigint").alias("k")))
    table = table.unionByName(spark.range(1).select(F.lit(None).cast("bigint").alias("k"), F.lit(5).cast("bigint").alias("v")))
    for how in ("left", "inner", "left_anti"):
        for limits in ({"broadcast_rows": 0}, {"broadcast_bytes": 100}, {}):
            got = joins.lookup(left, table, ["k"], how, task_rows=90, **limits)
            assert rows(got.select(sorted(got.columns)).fillna(-1)) == rows(
                left.join(table, ["k"], how).select(sorted(got.columns)).fillna(-1))


def test_hot_and_missing_keys_are_spread(spark):
    left = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.lit("hot")).alias("k"))
    table = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    joined = joins.lookup(left, table, ["k"], broadcast_rows=0, task_rows=100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = joined.groupBy(F.spark_partition_id().alias("p"), "k").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for k in ("hot", None):
        sizes = [r["count"] for r in parts if r["k"] == k]
        assert sum(sizes) == 2000 and len(sizes) > 1 and max(sizes) < 1500
    many = spark.createDataFrame([("x" * 1000, [1.0] * 10), (None, None)], "k string, v array<double>")
    assert [r["b"] for r in many.select(joins.row_bytes(many).alias("b")).collect()] == [1112, 32]


def test_copies_are_expanded_in_chunks(spark):
    df = spark.createDataFrame([("a", 2500), ("b", 1), ("c", 0)], "x string, n long")
    out = joins.expand_copies(df, "n", "number", chunk=100)
    assert rows(out.groupBy("x").agg(F.count(F.lit(1)), F.count_distinct("number"), F.max("number"))) == [
        ("a", 2500, 2500, 2499), ("b", 1, 1, 0)]


@pytest.mark.parametrize("n", [0, 1, 499, 500, 777, 999, 1000, 2000])
def test_exact_sample_size(spark, n):
    df = spark.range(1000)
    got = {r["id"] for r in sample.exact_sample(df, n, ["id"], 5).collect()}
    assert len(got) == min(n, 1000)
    assert got <= {r["id"] for r in sample.exact_sample(df, min(n + 1, 1000), ["id"], 5).collect()}


def test_exact_sample_through_hot_copies(spark):
    df = spark.createDataFrame([(1, "x")] * 400 + [(i, "y") for i in range(2, 102)], "a int, b string")
    for n in (100, 250, 450):
        got = sample.exact_sample(df, n, seed=1).groupBy("a", "b").count().collect()
        assert sum(r["count"] for r in got) == n


def test_sampling_key_must_be_unique(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)], "k int, v int")
    with pytest.raises(ValueError):
        sample.exact_sample(df, 4, ["k"])


def test_sampling_does_not_depend_on_partitions(spark):
    df = spark.range(2000)
    assert rows(sample.exact_sample(df.repartition(1), 700, ["id"], 2)) == rows(sample.exact_sample(df.repartition(17), 700, ["id"], 2))
    a = sample.dense_index(df.repartition(3), ["id"], 2)
    assert rows(a) == rows(sample.dense_index(df.repartition(11), ["id"], 2))
    assert sorted(r["idx"] for r in a.collect()) == list(range(2000))


@pytest.mark.parametrize("width", [7, 100, 10_000])
def test_rank_pairs_equal_sorted_pairs(spark, width):
    rng = np.random.default_rng(3)
    real = np.concatenate([rng.integers(0, 9, 300), np.full(200, 4)]).astype(float)
    fake = rng.normal(4, 3, 500).round(1)
    data = [("real", "x", float(v)) for v in real] + [("fake", "x", float(v)) for v in fake]
    counts = spark.createDataFrame(data, "origin string, name string, value double").groupBy("origin", "name", "value").agg(
        F.count(F.lit(1)).alias("cnt"))
    got = rankpair.rank_pairs(counts, rows_per_bucket=width).groupBy("x", "y").agg(F.sum("w").alias("w")).collect()
    want = {}
    for pair in zip(sorted(real), sorted(fake)):
        want[pair] = want.get(pair, 0) + 1
    assert {(r["x"], r["y"]): r["w"] for r in got} == want


@pytest.mark.parametrize("rows_per_task", [20, 1_000_000])
def test_nearest_observed_equals_brute_force(spark, rows_per_task):
    rng = np.random.default_rng(5)
    real, fake = rng.normal(0, 9, 150).round(2), rng.normal(2, 12, 200).round(2)
    got = encode.nearest_observed(spark.createDataFrame([(float(v),) for v in fake], "x double"),
                                  spark.createDataFrame([(float(v),) for v in real], "x double"), ["x"], rows_per_task)
    order = np.sort(np.unique(real))
    for r in got.collect():
        assert abs(r["nearest"] - r["value"]) == np.abs(order - r["value"]).min()
    assert got.count() == len(np.unique(fake)) - len(set(fake) & set(real)) or got.count() >= 1


@pytest.mark.parametrize("block", [16, 2048])
@pytest.mark.parametrize("shape", ["normal", "clusters", "copies"])
def test_nearest_costs_equal_brute_force(spark, monkeypatch, block, shape):
    monkeypatch.setattr(nearest, "BLOCK", block)
    rng = np.random.default_rng(11)
    q, t = rng.normal(size=(150, 3)), rng.normal(size=(220, 3))
    if shape == "clusters":
        t = np.concatenate([t[:20] * 50, 1e4 + t[20:] / 100])
        q = np.concatenate([q[:75], 1e4 + q[75:] / 100])
    if shape == "copies":
        q[:60] = t[0]
        t[100:] = t[0]
    qc, tc = rng.integers(0, 3, (150, 2)), rng.integers(0, 3, (220, 2))
    schema = "vec array<double>, codes array<int>"
    for codes in (False, True):
        def frame(x, c):
            return spark.createDataFrame([([float(v) for v in a], [int(v) for v in b] if codes else []) for a, b in zip(x, c)], schema)
        got = nearest.nearest_costs(frame(q, qc), frame(t, tc)).collect()
        assert sum(r["weight"] for r in got) == 150
        want = {}
        for a, b in zip(q, qc):
            cost = ((t - a) ** 2).sum(axis=1) + ((tc > b).sum(axis=1) if codes else 0)
            want[(tuple(a), tuple(b) if codes else ())] = cost.min()
        for r in got:
            assert math.isclose(r["best"], want[(tuple(r["vec"]), tuple(r["codes"]))], rel_tol=1e-6, abs_tol=1e-9)


def test_cells_to_search_are_few_and_none_is_missed():
    rng = np.random.default_rng(3)
    t = np.hstack([rng.normal(size=(60_000, 3)), rng.integers(0, 3, (60_000, 1))])
    q = np.hstack([rng.normal(size=(300, 3)), rng.integers(0, 3, (300, 1))])
    tree = nearest._Tree(t[::7], 3, 32)
    cells = tree.locate(t)
    ids = np.unique(cells)
    assert len(ids) > 200 and np.bincount(cells).max() < 2000
    tree.fill(ids, np.array([t[cells == c].min(axis=0) for c in ids]), np.array([t[cells == c].max(axis=0) for c in ids]))
    own = tree.locate(q)
    costs = np.array([((t[:, :3] - x[:3]) ** 2).sum(axis=1) + (t[:, 3] > x[3]) for x in q])
    best = np.array([costs[i, cells == own[i]].min() for i in range(len(q))])
    found = [(r, c) for rows, at in tree.others(q, own, best) for r, c in zip(rows, at)]
    assert len(found) == len(set(found)) < 20 * len(q)
    for i in range(len(q)):
        # Whatever is closer than the own cell's best lies in a cell to search.
        assert set(cells[costs[i] < best[i]]) <= {c for r, c in found if r == i}
    got = nearest._nearest(q, t, 3, np.full(len(q), np.inf))
    assert np.allclose(got, costs.min(axis=1))


def test_spearman_and_curves_in_ranges(spark):
    df = spark.range(800).select(((F.col("id") * 37) % 101 > 50).cast("int").alias("y"), ((F.col("id") * 53) % 97).cast("double").alias("s"))
    for fn, name in ((scores.spearman, "spearman"), (scores.roc_auc, "roc_auc"), (scores.pr_auc, "pr_auc")):
        a, b = fn(df, "y", "s").first()[name], fn(df, "y", "s", rows_per_task=10).first()[name]
        assert math.isclose(a, b, rel_tol=1e-9)


def test_pair_counts_without_combining(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") % 3).alias("a"), (F.col("id") % 4).alias("b"), (F.col("id") % 5).alias("c"))
    combined = rows(assoc.theils_u(df, ["a", "b", "c"]))
    monkeypatch.setattr(assoc, "COMBINED", 0)
    direct = rows(assoc.theils_u(df, ["a", "b", "c"]))
    for x, y in zip(combined, direct):
        assert x[:2] == y[:2] and math.isclose(x[2], y[2], abs_tol=1e-9)


def test_wide_correlation_equals_narrow(spark, monkeypatch):
    df = spark.range(300).select(*[((F.col("id") * (2 * i + 3)) % 31).cast("double").alias(f"c{i}") for i in range(5)])
    df = df.withColumn("c4", F.when(F.col("c4") > 20, F.col("c4")))       # a column with nulls changes no other pair
    narrow = rows(assoc.numeric_association(df, df.columns))
    monkeypatch.setattr(assoc, "PAIRS", 2)
    for a, b in zip(narrow, rows(assoc.numeric_association(df, df.columns))):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=1e-9)


def test_no_nested_loop_over_rows(spark):
    """Plans over the data join by keys only; one-row totals may be attached by broadcast."""
    real = spark.range(100).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    pair = TablePair(real, real, TableMeta({"x": "numerical", "c": "categorical"}))
    from tablemirror.operators import stats
    for df in (stats.copied_rows(pair), stats.numeric_statistics(pair), rankpair.column_correlations(pair),
               assoc.association_difference(pair), sample.sample_with_replacement(real.withColumn("k", F.monotonically_increasing_id()), 50, ["k"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "BatchEvalPython" not in plan


def test_factorize_large_vocabulary(spark, monkeypatch):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("c"))
    codes, mapping = clean.factorize(df, "c", order_by="id")
    assert mapping.count() == 601
    back = clean.decode_codes(codes, "c", mapping)
    assert rows(back) == rows(df)


def test_numeric_association_of_odd_columns(spark):
    """Groups with a missing name, constant and infinite columns, pairs never known together; no aggregate per pair."""
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("a", 1.0, 0.1, 2.0, None, inf), ("a", 2.0, 0.1, 4.5, None, 1.0), ("a", 3.0, 0.1, None, 7.0, 2.0),
                                (None, 1e9 + 1, 0.1, 6.0, 1.0, 3.0), (None, 1e9 + 2, 0.1, 7.0, 2.0, 4.0), (None, 1e9 + 4, 0.1, 8.0, 2.0, nan)],
                               "g string, p double, q double, r double, s double, t double")
    found = {(x["g"], x["col_a"], x["col_b"]): x["value"] for x in assoc.numeric_association(df, list("pqrst"), ["g"]).collect()}
    assert len(found) == 40
    assert found["a", "p", "r"] == pytest.approx(1.0) and found[None, "p", "s"] == pytest.approx(np.corrcoef([1, 2, 4], [1, 2, 2])[0, 1])
    assert found["a", "p", "q"] is None and found["a", "r", "s"] is None and found["a", "p", "s"] is None
    assert np.isnan(found["a", "p", "t"]) and np.isnan(found[None, "t", "s"])
    plan = assoc.numeric_association(df, list("pqrst"))._jdf.queryExecution().optimizedPlan().toString()
    assert "corr(" not in plan


def test_nearest_costs_leave_little_on_disk(spark, monkeypatch):
    """Between the steps rows are plain columns, and what is used up is removed: only the answer's tables are left."""
    import glob
    import os

    from tablemirror.session import cut

    cut(spark.range(1))
    folder = spark.sparkContext.getCheckpointDir().split(":", 1)[-1]
    size = lambda: sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**/*", recursive=True) if os.path.isfile(f))
    n = 40_000
    df = spark.range(2 * n).select("id", F.array(*[(F.xxhash64("id", F.lit(i)) % 50).cast("double") for i in range(11)],
                                                 (F.xxhash64("id") % 1_000_003).cast("double")).alias("vec"), F.array().cast("array<int>").alias("codes"))
    before = size()
    found = nearest.nearest_costs(df.filter(f"id < {n}").drop("id"), df.filter(f"id >= {n}").drop("id"))
    assert found.agg(F.sum("weight")).first()[0] == n
    # 12 numbers as doubles are 96 bytes, of each query alone.
    assert size() - before < n * 96


@pytest.mark.parametrize("n", [1, 499, 2500, 4999])
def test_samples_of_known_tables_need_one_histogram(spark, n, monkeypatch):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("x"))
    want = {r["id"] for r in sample.exact_sample(df, n, ["id"], 3).collect()}
    assert {r["id"] for r in sample.exact_sample(df, n, ["id"], 3, rows=5000).collect()} == want and len(want) == n
    # Copies move the n-th hash away from its place.
    copies = df.select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("id"))
    got = sample.exact_sample(copies, n, seed=3, rows=5000)
    assert got.count() == n
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in sample.exact_sample(copies, n, seed=3).collect())
