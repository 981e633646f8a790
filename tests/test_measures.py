"""Hand-computed values, identities, edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from tablemirror.functions import scores
from tablemirror.operators import assoc, clean, encode, likelihood, models, nearest, pca, plotdata, profile, rankpair, sample, stats
from tablemirror.operators import report as reports
from tablemirror.operators.features import FeatureMaker
from tablemirror.schema import TableMeta, TablePair
from tablemirror.sources import tables as sources

MIXED = TableMeta({"x": "numerical", "c": "categorical", "o": "ordinal"})


@pytest.fixture(scope="module")
def tiny(spark):
    data = [(1, 1.0, "a", "1"), (2, 2.0, "a", "1"), (3, 3.0, "a", "2"), (4, 4.0, "b", "2"),
            (5, 5.0, "b", "3"), (6, 6.0, "b", "3"), (7, 7.0, "c", "3"), (8, 8.0, "c", "3")]
    return spark.createDataFrame(data, "id int, x double, c string, o string").cache()


@pytest.fixture(scope="module")
def same(tiny):
    return TablePair(tiny, tiny, MIXED)


def value(df, column="value", **where):
    for k, v in where.items():
        df = df.filter(F.col(k) == v)
    return df.first()[column]


def test_theils_u_by_hand(tiny):
    u = assoc.theils_u(tiny, ["c", "o"])
    # H(c) = 3/8, 3/8, 2/8; H(o) = 2/8, 2/8, 4/8; joint 2, 1, 1, 2, 2 of 8.
    h = lambda *p: -sum(v / 8 * math.log(v / 8) for v in p)
    hc, ho, both = h(3, 3, 2), h(2, 2, 4), h(2, 1, 1, 2, 2)
    assert math.isclose(value(u, col_a="c", col_b="o"), (hc + ho - both) / hc)
    assert math.isclose(value(u, col_a="o", col_b="c"), (hc + ho - both) / ho)


def test_correlation_ratio_by_hand(tiny):
    # Group means 2, 5, 7.5 around 4.5; total sum of squares 42.
    eta = math.sqrt((3 * 2.5 ** 2 + 3 * 0.5 ** 2 + 2 * 3 ** 2) / 42)
    assert math.isclose(value(assoc.correlation_ratio(tiny, ["c"], ["x"])), eta)


def test_cramers_v_of_equal_columns(tiny):
    df = tiny.withColumn("d", F.col("c"))
    assert math.isclose(value(assoc.cramers_v(df, ["c", "d"], bias_correction=False), col_a="c"), 1.0)


def test_constant_column(spark):
    df = spark.createDataFrame([(1.0, "a", "z")] * 6, "x double, c string, o string")
    assert value(assoc.theils_u(df, ["c", "o"]), col_a="c") == 1.0
    assert value(assoc.correlation_ratio(df, ["c"], ["x"])) == 0.0
    pair = TablePair(df, df, MIXED)
    assert value(rankpair.mean_column_correlation(pair)) is None
    assert nearest.neighbour_distance(pair).first()["neighbor_mean"] == 0.0


def test_record_distance_both_modes(spark):
    meta = TableMeta({"x": "numerical", "k": "categorical"})
    real = spark.createDataFrame([(0.0, 2), (10.0, 0)], "x double, k int")
    fake = spark.createDataFrame([(0.0, 1), (0.0, 1)], "x double, k int")
    pair = TablePair(real, fake, meta)
    # Against (0, 2): one code differs, real larger. Against (10, 0): numeric 1 (10 / 2 / 5), real code smaller.
    positive = nearest.record_distance(pair, rows=2).first()[0]
    assert math.isclose(positive, 1.0, rel_tol=1e-6)
    apart = TablePair(spark.createDataFrame([(0.0, 0), (10.0, 0)], "x double, k int"), fake, meta)
    assert nearest.record_distance(apart, rows=2).first()[0] == 0.0
    assert math.isclose(nearest.record_distance(apart, rows=2, mismatch="any").first()[0], 1.0, rel_tol=1e-6)


def test_record_distance_missing_values(spark):
    meta = TableMeta({"x": "numerical", "k": "categorical"})
    real = spark.createDataFrame([(0.0, 2), (10.0, 0), (None, 1)], "x double, k int")
    # A missing number stands at the mean 5 and 1 apart; a missing code is the smallest (positive) or its own (any).
    fake = spark.createDataFrame([(None, None)], "x double, k int")
    for mode in ("positive", "any"):
        assert math.isclose(nearest.record_distance(TablePair(real, fake, meta), rows=1, mismatch=mode).first()[0], 1.0, rel_tol=1e-6)
    nan = spark.createDataFrame([(float("nan"), 1)], "x double, k int")
    assert nearest.record_distance(TablePair(real, nan, meta), rows=1).first()[0] == 0.0
    known = spark.createDataFrame([(0.0, 5)], "x double, k int")
    # Against (0, 2) only: nothing missing, the real code is smaller.
    assert nearest.record_distance(TablePair(real, known, meta), rows=1).first()[0] == 0.0
    assert math.isclose(nearest.record_distance(TablePair(real, known, meta), rows=1, mismatch="any").first()[0], 1.0, rel_tol=1e-6)


def test_rank_pairing_native_order_and_missing_values(spark):
    meta = TableMeta({"k": "categorical"})
    real = spark.createDataFrame([(v,) for v in (1, 2, 2, 3, 10, 11)], "k int")
    fake = spark.createDataFrame([(v,) for v in (1, 2, 3, 3, 4, 10)], "k int")
    # Sorted as integers: (1,1) (2,2) (2,3) (3,3) (10,4) (11,10); as text 10 and 11 would come before 2.
    got = value(rankpair.column_correlations(TablePair(real, fake, meta)))
    assert math.isclose(got, 0.851959, abs_tol=1e-6)
    for bucket in (1, 2, 4):
        assert math.isclose(value(rankpair.column_correlations(TablePair(real, fake, meta), rows_per_bucket=bucket)), got, rel_tol=1e-9)
    nums = TableMeta({"x": "numerical"})
    full = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    gaps = spark.createDataFrame([(float(i) if i < 60 else None,) for i in range(100)], "x double")
    # Missing values sort last: positions 0..59 pair equal values, the rest have a missing side and are left out.
    assert math.isclose(value(rankpair.column_correlations(TablePair(full, gaps, nums))), 1.0, rel_tol=1e-12)
    short = spark.createDataFrame([(float(i),) for i in range(0, 120, 2)], "x double")
    # 100 against 60 rows: the 60 positions both have; the longer table's largest values are left out.
    assert math.isclose(value(rankpair.column_correlations(TablePair(full, short, nums))), 1.0, rel_tol=1e-12)
    cats = TableMeta({"c": "categorical"})
    a = spark.createDataFrame([("a",), ("b",), (None,), (None,)], "c string")
    b = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "c string")
    # Pairs (a,a) (b,b) (null,c) (null,null): U(real | fake) = 1.
    assert math.isclose(value(rankpair.column_correlations(TablePair(a, b, cats))), 1.0, rel_tol=1e-12)


def test_network_with_missing_parents(spark):
    from tablemirror.operators import likelihood, synth
    rows = [("a", "x"), (None, "y"), (None, None), ("a", None), (None, "y")] * 40
    df = spark.createDataFrame(rows, "p string, c string")
    net = {"p": [], "c": ["p"]}
    drawn = synth.bayes_net_rows(df, net, 200, seed=1)
    assert drawn.count() == 200
    seen = {(r["p"], r["c"]) for r in drawn.collect()}
    assert seen <= {("a", "x"), (None, "y"), (None, None), ("a", None)} and (None, "y") in seen
    # Every row of the table itself has a probability: p(p) * p(c | p), missing values as values of their own.
    tables = likelihood.conditional_tables(df, net)
    got = likelihood.bayes_net_log_likelihood(df, tables, net).first()["loglik"]
    want = sum(math.log(pp * pc + 1e-8) for pp, pc in [(0.4, 0.5), (0.6, 2 / 3), (0.6, 1 / 3), (0.4, 0.5), (0.6, 2 / 3)]) / 5
    assert math.isclose(got, want, rel_tol=1e-9)


def test_identities(same, tiny):
    difference = assoc.association_difference(same)
    found = {r["metric"]: r["value"] for r in assoc.association_distance(difference).collect()}
    assert found["rmse"] == 0 and found["mae"] == 0 and math.isclose(found["pearsonr"], 1.0)
    assert all(math.isclose(r["value"], 1.0) for r in rankpair.column_correlations(same).collect())
    assert stats.copied_row_count(same).first()[0] == 8
    assert nearest.neighbour_distance(same).first()["neighbor_mean"] < 1e-9
    assert math.isclose(value(pca.pca_similarity(same)), 1.0)
    assert math.isclose(value(stats.statistical_similarity(same)), 1.0)
    summary = {r["metric"]: r["value"] for r in reports.summary(same).collect()}
    assert math.isclose(summary["Similarity_Score"], 1.0)


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_pca_moments_with_nulls(spark, partitions):
    """Every entry over the rows where both columns are known, as covar_samp has it, on any partitioning."""
    df = spark.range(200).select(*[F.when((F.col("id") + i) % (i + 4) != 0, ((F.col("id") * (2 * i + 3)) % 31).cast("double"))
                                   .alias(f"c{i}") for i in range(9)]).repartition(partitions)
    cov = pca.moments(df, df.columns)[1]
    for r in pca.covariance_long(df, df.columns).collect():
        assert math.isclose(cov[int(r["col_a"][1:]), int(r["col_b"][1:])], r["value"], rel_tol=1e-9, abs_tol=1e-9)


def test_duplicates_and_copies_with_nulls(spark):
    real = spark.createDataFrame([(1, None), (1, None), (2, "b")], "x int, c string")
    fake = spark.createDataFrame([(1, None), (3, "c"), (3, "c"), (3, "c")], "x int, c string")
    pair = TablePair(real, fake, TableMeta({"x": "numerical", "c": "categorical"}))
    assert tuple(stats.duplicate_rows(pair).first()) == (2, 3)
    assert stats.copied_row_count(pair).first()[0] == 1
    assert stats.copied_rows_expanded(pair).count() == 1


def test_empty_fake(same, tiny):
    pair = TablePair(tiny, tiny.limit(0), MIXED)
    assert stats.copied_row_count(pair).first()[0] == 0
    assert tuple(stats.duplicate_rows(pair).first()) == (0, 0)
    assert stats.numeric_statistics(pair).first()["mean_fake"] is None
    assert plotdata.category_proportions(pair, ["c"]).count() == 3
    assert sample.equal_length(pair, ["x"]).real.count() == 0


def test_median_of_even_and_odd(spark):
    df = spark.createDataFrame([(float(v), float(v % 3)) for v in range(10)], "a double, b double")
    got = {r["name"]: r["median"] for r in stats.exact_medians(df, ["a", "b"]).collect()}
    assert got == {"a": 4.5, "b": 1.0}


def test_scores_by_hand(spark):
    df = spark.createDataFrame([(1, 1, .9), (0, 1, .8), (1, 0, .4), (0, 0, .4), (1, 1, .7)], "y int, p int, s double")
    y, p = F.col("y"), F.col("p")
    row = df.agg(scores.precision(y, p).alias("a"), scores.recall(y, p).alias("b"), scores.f1(y, p).alias("c"),
                 scores.accuracy(y, p).alias("d"), scores.jaccard_micro(y, p).alias("e"), scores.mape(y, p).alias("f"),
                 scores.zero_truth(y, p).alias("g")).first()
    assert row["a"] == pytest.approx(2 / 3) and row["b"] == pytest.approx(2 / 3) and row["c"] == pytest.approx(2 / 3)
    assert row["d"] == 0.6 and row["e"] == pytest.approx(0.6 / 1.4) and row["f"] == pytest.approx(1 / 3) and row["g"] == 2
    # Positives .9 .7 .4 against negatives .8 .4: wins 1 + 1 + .. = 1,1 / 0,1 / 0,.5
    assert scores.roc_auc(df, "y", "s").first()[0] == pytest.approx(3.5 / 6)


def test_precision_without_predictions_is_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    assert df.agg(scores.precision(F.col("y"), F.col("p"))).first()[0] == 0.0


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1., 3.), (2., 3.), (2., 1.), (4., 9.)], "y double, p double")
    # Ranks 1, 2.5, 2.5, 4 and 2.5, 2.5, 1, 4: products of the deviations 1.5 * 1.5, squares 4.5 each.
    assert scores.spearman(df, "y", "p").first()[0] == pytest.approx(2.25 / 4.5)


@pytest.mark.parametrize("lam", [-1.5, 0.0, 0.7, 2.0, 2.6])
def test_yeo_johnson_round_trip(spark, lam):
    df = spark.createDataFrame([(float(v),) for v in (-5.5, -1, 0, 0.3, 2, 40)], "x double")
    back = df.select("x", encode.yeo_johnson_inverse(encode.yeo_johnson(F.col("x"), lam), lam).alias("b"))
    assert all(math.isclose(r["x"], r["b"], rel_tol=1e-6, abs_tol=1e-9) for r in back.collect())


def test_encoders_round_trip(spark, tiny):
    fitted = encode.fit_table(tiny, MIXED, {"numerical": "minmax_norm"})
    back = fitted.decode(fitted.encode(tiny, ["id"], keep=["id"]), keep=["id"])
    for a, b in zip(back.orderBy("id").collect(), tiny.orderBy("id").collect()):
        assert math.isclose(a["x"], b["x"]) and a["c"] == b["c"] and a["o"] == b["o"]
    again = encode.TableEncoder.from_parameters(fitted.parameters(spark))
    assert again == fitted and again.width == 1 + 3 + 1


@pytest.mark.parametrize("bayesian", [True, False])
def test_mixture_encoder(spark, bayesian):
    df = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, F.lit(100.0)).otherwise(0.0).alias("base"))
    df = df.select("id", (F.col("base") + F.sin(F.col("id"))).alias("x"))
    (e,) = encode.fit_mixture(df, ["x"], bayesian, components=4, max_iter=15)
    coded = df.select("x", e.encode(["id"]).alias("v"))
    worst = coded.select(F.max(F.abs(e.decode(F.col("v")) - F.col("x"))), F.max(F.abs(F.element_at("v", 1)))).first()
    assert worst[1] <= 0.99 and worst[0] < 5
    assert any(abs(m) < 3 for m in e.means) and any(abs(m - 100) < 3 for m in e.means)


def test_unseen_categories(spark):
    real = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "c")], "x double, c string")
    fake = spark.createDataFrame([(1.0, "z"), (2.0, "a")], "x double, c string")
    meta = TableMeta({"x": "numerical", "c": "categorical"})
    a, b, columns = clean.numeric_encoding(TablePair(real, fake, meta))
    assert a.columns == b.columns == columns == ["c_a", "c_b", "c_c", "x"]
    assert [r["c_a"] + r["c_b"] + r["c_c"] for r in b.orderBy("x").collect()] == [0.0, 1.0]
    _, coded = clean.shared_target(TablePair(real, fake, meta), "c", order_by="x")
    assert [r["c"] for r in coded.orderBy("x").collect()] == [None, 0]
    made = FeatureMaker.fit(real, TableMeta(meta.kinds, label="x"), classes=False).flat(fake)
    assert made.filter(F.col("label") == 1.0).first()["c=a"] == 0.0


def test_impute(spark):
    df = spark.createDataFrame([(1.0, None), (None, "a"), (float("nan"), "b"), (3.0, "[NAN]")], "x double, c string")
    out = clean.impute_numerical(clean.impute_categorical(df, ["c"]), ["x"])
    assert sorted(r["x"] for r in out.collect()) == [1.0, 2.0, 2.0, 3.0]
    assert out.filter(F.col("c") == "[NAN]").count() == 2


def test_vocabulary_order_and_limits(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "c string")
    got = [(r["value"], r["rank"]) for r in profile.vocabulary(df, ["c"]).orderBy("rank").collect()]
    assert got == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(ValueError):
        profile.fitted_vocabularies(df, ["c"], limit=2)


def test_conditions_hold(spark, tiny):
    requests = spark.range(60).select(F.col("id").alias("request"), F.lit("c").alias("name"), F.when(F.col("id") % 2 == 0, "a").otherwise("c").alias("value"))
    got = sample.conditional_sample(tiny, requests, ["c", "o"], ["id"]).join(tiny, "id")
    assert got.count() == 60 and got.filter(F.col("value") != F.col("c")).count() == 0
    assert math.isclose(sample.category_pmf(tiny, ["c"]).agg(F.sum("p")).first()[0], 1.0)
    drawn = sample.condition_draws(tiny, ["c", "o"], 500, 1, vectors=True)
    assert drawn.count() == 500
    assert drawn.filter(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v) != 1).count() == 0


def test_bayes_net_unseen_is_floor(spark):
    real = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "p string, q string")
    other = spark.createDataFrame([("c", "x")], "p string, q string")
    net = {"p": [], "q": ["p"]}
    tables = likelihood.conditional_tables(real, net)
    assert likelihood.bayes_net_log_likelihood(other, tables, net).first()[0] == pytest.approx(math.log(1e-8))
    with pytest.raises(ValueError):
        likelihood.topological({"p": ["q"], "q": ["p"]})


def test_models_learn_a_separable_label(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), F.when(F.col("id") % 20 < 10, "no").otherwise("yes").alias("y"))
    meta = TableMeta({"x": "numerical", "y": "categorical"}, label="y", problem_type="binary_classification")
    for name, params in (("logistic_regression", {}), ("decision_tree", {}), ("adaboost", {"rounds": 3})):
        seen = models.fake_to_real(TablePair(df, df, meta), df, [name], params={name: params})
        assert seen.first()["accuracy"] >= 0.95
    grid = models.utility_grid(df, df, df, df, meta, ["decision_tree"], ["id"])
    scored = models.grid_scores(grid, ["accuracy", "f1_score"])
    assert models.utility_score(scored, ["accuracy", "f1_score"]).first()[0] == pytest.approx(1.0)
    assert models.prediction_agreement(grid, ["id"]).first()["jaccard"] == 1.0


def test_adaboost_multiclass_labels(spark):
    df = spark.range(300).select((F.col("id") % 30).cast("double").alias("x"), F.floor((F.col("id") % 30) / 10).cast("string").alias("y"))
    meta = TableMeta({"x": "numerical", "y": "categorical"}, label="y")
    made = FeatureMaker.fit(df, meta).transform(df)
    model = models.fit_classifier("adaboost", made, rounds=8)
    seen = model.transform(made)
    assert seen.filter(F.col("label") == F.col("prediction")).count() / 300 >= 0.6


def test_spec_text_rejects_unknown_value(spark, tmp_path):
    (tmp_path / "meta").write_text("C 0 500\nD {A B C}\n")
    (tmp_path / "rows").write_text("100 \t A\n200\tB\n")
    spec = sources.read_spec(spark, str(tmp_path / "meta"))
    assert [tuple(r) for r in sources.read_spec_table(spark, str(tmp_path / "rows"), spec).collect()] == [(100.0, 0.0), (200.0, 1.0)]
    (tmp_path / "bad").write_text("1 X\n")
    with pytest.raises(Exception, match="unknown value X"):
        sources.read_spec_table(spark, str(tmp_path / "bad"), spec).collect()


def test_align_by_position(spark):
    real = spark.createDataFrame([(1, 2.0)], "a int, b double")
    fake = spark.createDataFrame([("7", "8.5", "x")], "p string, q string, junk string")
    a, b = stats.align_tables(real, fake, drop=["junk"])
    assert b.columns == ["a", "b"] and b.dtypes == a.dtypes and tuple(b.first()) == (7, 8.5)
    with pytest.raises(ValueError):
        stats.align_tables(real, fake)


def test_numbers_are_ordered_as_numbers(spark):
    from tablemirror.operators import profile
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("n"), F.col("id").cast("string").alias("t"))
    codes = {(r["name"], r["value"]): r["code"] for r in profile.sorted_vocabulary(df, ["n", "t"]).collect()}
    assert [codes["n", str(i)] for i in range(1, 13)] == list(range(12)) and codes["t", "10"] == 1
    assert profile.fitted_vocabularies(df, ["n"])["n"] == [str(i) for i in range(1, 13)]


def test_feature_rows_are_not_lost(spark):
    from tablemirror.operators.features import FeatureMaker
    meta = TableMeta({"x": "numerical", "c": "categorical", "o": "ordinal", "y": "categorical"}, label="y")
    real = spark.createDataFrame([(1.0, "a", "p", "yes"), (3.0, "b", "q", "no"), (None, "c", None, "no")], "x double, c string, o string, y string")
    fake = spark.createDataFrame([(None, None, "z", "never"), (2.0, "a", "p", "yes"), (1.0, "d", None, "no")], real.schema)
    maker = FeatureMaker.fit(real, meta)
    assert maker.transform(real).count() == 3
    assert sorted(r["label"] for r in maker.transform(fake).collect())[0] == -1.0 and maker.transform(fake).count() == 3


def test_keys_of_other_parts_hash_apart(spark):
    from tablemirror.functions.hashing import key_hash
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("\\N", "x"), ("-", "x")], "a string, b string")
    assert df.select(key_hash(0, "s", "a", "b")).distinct().count() == 5


def test_score_files_of_other_columns(spark, tmp_path):
    from tablemirror.sources import tables
    (tmp_path / "v1.csv").write_text("name,accuracy,f1\na,0.5,0.25\n")
    (tmp_path / "v2.csv").write_text("f1,name\n0.75,b\n")
    got = {r["name"]: (r["accuracy"], r["f1"], r["version"]) for r in tables.read_scores(spark, str(tmp_path)).collect()}
    assert got == {"a": (0.5, 0.25, "v1"), "b": (None, 0.75, "v2")}


def test_mixtures_of_both_tables_are_fitted_in_shared_jobs(spark):
    import numpy as np

    from tablemirror.operators import mixture

    data = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(5.0)).otherwise(0.0).alias("c"), (F.col("id") * 37 % 101 / 101).alias("x"))
    low = data.select((F.col("c") + F.col("x")).alias("a"), (F.col("x") - F.col("c")).alias("b"))
    high = low.select((F.col("a") + 100).alias("a"), "b")
    both = mixture.fit_tables({"low": low, "high": high}, ["a", "b"], [1, 2])
    for name, df in (("low", low), ("high", high)):
        for k in (1, 2):
            alone = mixture.fit_rows(df, ["a", "b"], k)
            assert np.allclose(alone.means, both[name, k].means) and np.allclose(alone.weights, both[name, k].weights)
    assert np.allclose(both["low", 1].means, [[3.0, -2.0]], atol=0.1)
    assert np.allclose(np.sort(both["high", 2].means[:, 0]), [100.5, 105.5], atol=0.1)
    assert math.isclose(mixture.mean_log_likelihood(low, ["a", "b"], both["low", 2]).first()[0],
                        mixture.mean_log_likelihood(high, ["a", "b"], both["high", 2]).first()[0], rel_tol=1e-6)


def test_adaboost_rounds_are_sums_over_counted_bins(spark, monkeypatch):
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    # An interval in the middle: one stump cannot tell it, a vote of several can.
    df = spark.range(3000).select((F.col("id") * 37 % 1009 / 1009).alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    df = df.select(array_to_vector(F.array("a", "b")).alias("features"), ((F.col("a") > 0.3) & (F.col("a") < 0.7)).cast("double").alias("label"))
    tries = []
    best = models._best_stump
    monkeypatch.setattr(models, "_best_stump", lambda w, n, t: tries.append((w, n)) or best(w, n, t))
    fitted = models.fit_classifier("adaboost", df, rounds=8)
    # Weights always add up to one, every row is counted, and a round's wrong and right weights are then even.
    assert len(tries) == 8 and all(np.allclose(w.sum(axis=(1, 2)), 1.0) and (n.sum(axis=(1, 2)) == 3000).all() for w, n in tries)
    for (stump, _), (w, _) in zip(fitted.votes, tries[1:]):
        low, high = w[stump.feature, :stump.bin + 1].sum(axis=0), w[stump.feature, stump.bin + 1:].sum(axis=0)
        right = (low[stump.left] + high[stump.right]) if stump.feature >= 0 else w[0].sum(axis=0)[stump.left]
        assert math.isclose(right, 0.5, rel_tol=1e-6)
    seen = fitted.transform(df)
    assert seen.columns == ["features", "label", "prediction"]
    assert seen.filter("label = prediction").count() > 2800


def test_report_with_models_has_the_distances(spark, monkeypatch):
    from functools import partial

    from tablemirror.plans import closed_form_queries

    monkeypatch.setattr(closed_form_queries, "report_with_models",
                        partial(reports.report_with_models, models=["logistic_regression"], params={"logistic_regression": {"max_iter": 2}}))
    rows = closed_form_queries.a15_models(spark, "/root/testdata/sf0.001").collect()
    assert {r["name"] for r in rows} == {"logistic_regression_real", "logistic_regression_fake"}
    assert all(r["Record_Distance"] > 0 and r["Neighbor_Mean"] > 0 and r["Neighbor_Std"] > 0 for r in rows)


def test_mixture_passes_read_packed_blocks(spark, monkeypatch):
    import numpy as np

    from tablemirror.operators import mixture

    monkeypatch.setattr(mixture, "PACKED_ROWS", 700)
    monkeypatch.setattr(mixture, "TASK_BLOCKS", 2)
    # More different numbers than a block lists, few, and equal rows: 3000 different ones, 500 of them twice.
    ids = spark.range(3500).select((F.col("id") % 3000).alias("i"))
    low = ids.select((F.col("i") * 37 % 2999 / 7).alias("a"), (F.col("i") % 5).cast("double").alias("b"))
    high = low.select((F.col("a") * 3 + 1000).alias("a"), "b")
    data = mixture.packed_tables({"low": low, "high": high}, ["a", "b"])
    assert data.count() <= 2 * (3000 // 700 + 1) + 8 and data.agg(F.sum("n")).first()[0] == 6000
    seen = {}
    for name, x, w in mixture._blocks(data.toArrow().to_batches()):
        seen.setdefault(name, []).append(np.repeat(x, w.astype(int), axis=1))
    for name, df in (("low", low), ("high", high)):
        rows = np.array(df.collect())
        assert np.array_equal(np.array(sorted(np.concatenate(seen[name], axis=1).T.tolist())), np.array(sorted(rows.tolist())))
        # One step of three components against the densities written out.
        model = mixture.Mixture(np.array([0.2, 0.3, 0.5]), np.quantile(rows, [0.2, 0.5, 0.8], axis=0), np.array([[9e3, 2.0]] * 3) * rows.var(axis=0).mean() / 9e3,
                                np.zeros(3))
        model = mixture.Mixture(model.weights, model.means, model.variances, mixture.plain_offsets(model.weights, model.variances))
        dense = np.exp(-((rows[:, None] - model.means) ** 2 / model.variances).sum(axis=2) / 2) * model.weights / np.sqrt(
            (2 * math.pi * model.variances).prod(axis=1))
        share = dense / dense.sum(axis=1, keepdims=True)
        centre = rows.mean(axis=0)
        moved = mixture.Mixture(model.weights, model.means - centre, model.variances, model.offsets)
        r, rx, rxx, loglik = mixture._step(data, {name: moved}, {name: centre}, {name: name})[name]
        assert np.allclose(r, share.sum(axis=0)) and np.allclose(rx, share.T @ (rows - centre)) and np.allclose(rxx, share.T @ (rows - centre) ** 2)
        assert math.isclose(loglik, np.log(dense.sum(axis=1)).sum(), rel_tol=1e-9)
        found = mixture.packed_log_likelihoods(data, {"m": (name, model)}).first()
        assert math.isclose(found["loglik"], np.log(dense.sum(axis=1)).mean(), rel_tol=1e-9)
        assert math.isclose(found["loglik"], mixture.mean_log_likelihood(df, ["a", "b"], model).first()[0], rel_tol=1e-9)
