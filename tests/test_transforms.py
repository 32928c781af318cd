"""Imputers, encoders, scalers, features: small hand-made cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableprep.functions.columns import Roles
from tableprep.operators import encode, features, guards, impute, scale

ROLES = Roles(keys=("k",))


@pytest.fixture
def table(spark):
    return spark.createDataFrame([
        (0, 1.0, None, 5.0, "a", "train", 0), (1, None, None, 5.0, "b", "train", 1),
        (2, 3.0, None, 5.0, None, "train", 0), (3, 8.0, None, 5.0, "b", "train", 1),
        (4, float("nan"), 7.0, 6.0, "z", "test", 0)], "k int, x double, y double, c double, s string, split string, label int")


def column(df, name):
    return [r[0] for r in df.orderBy("k").select(f"`{name}`").collect()]


def test_imputers(table):
    assert column(impute.mean_imputer(table, ROLES), "x") == [1.0, 4.0, 3.0, 8.0, 4.0]
    assert column(impute.median_imputer(table, ROLES), "x") == [1.0, 3.0, 3.0, 8.0, 3.0]
    assert column(impute.mode_imputer(table, ROLES), "x") == [1.0, 1.0, 3.0, 8.0, 1.0]
    assert column(impute.category_imputer(table, ROLES), "s") == ["a", "b", "b", "b", "z"]
    assert column(impute.constant_fill(table, ROLES, 1.0), "x") == [1.0, 1.0, 3.0, 8.0, 1.0]


def test_column_without_train_values_is_kept(table):
    assert column(impute.median_imputer(table, ROLES), "y") == [None, None, None, None, 7.0]


def test_imputer_refit_on_test(spark):
    df = spark.createDataFrame([(0, 1.0, "train"), (1, None, "train"), (2, 9.0, "test"), (3, None, "test")],
                               "k int, x double, split string")
    assert column(impute.mean_imputer(df, ROLES), "x") == [1.0, 1.0, 9.0, 1.0]
    assert column(impute.mean_imputer(df, ROLES, refit_test=True), "x") == [1.0, 1.0, 9.0, 9.0]


def test_nothing_missing_is_a_no_op(table):
    df = table.select("k", "c", "split", "label")
    assert impute.mean_imputer(df, ROLES) is df


def test_one_hot(table):
    out = encode.one_hot_encoder(table, ROLES)
    assert [c for c in out.columns if c.startswith("s_")] == ["s_MISSING", "s_a", "s_b"]
    assert column(out, "s_b") == [0.0, 1.0, 0.0, 1.0, 0.0]
    assert [sum(r) for r in out.orderBy("k").select("s_MISSING", "s_a", "s_b").collect()] == [1, 1, 1, 1, 0]
    sparse = encode.one_hot_encoder(table, ROLES, sparse=True)
    assert column(sparse, "s_hot") == [1.0, 2.0, 0.0, 2.0, -1.0]


@pytest.mark.parametrize("cases", [64, 1])
def test_label_encoder(table, monkeypatch, cases):
    monkeypatch.setattr(encode, "MAX_CASES", cases)
    # sorted: MISSING, Unknown, a, b
    assert column(encode.label_encoder(table, ROLES), "s") == [2.0, 3.0, 0.0, 3.0, 1.0]


def test_scalers_leave_constants_alone(table):
    assert column(scale.min_max_scaler(table, ROLES), "c") == [0.0, 0.0, 0.0, 0.0, 1.0]
    assert column(scale.standard_scaler(table, ROLES), "c") == [0.0, 0.0, 0.0, 0.0, 1.0]
    assert column(scale.robust_scaler(table, ROLES), "c") == [0.0, 0.0, 0.0, 0.0, 1.0]
    assert column(scale.max_abs_scaler(table, ROLES), "c") == [1.0, 1.0, 1.0, 1.0, 1.2]
    assert column(scale.power_transformer(table, ROLES), "c")[:4] == [5.0] * 4


def test_scalers_take_missing_as_zero(table):
    assert column(scale.min_max_scaler(table, ROLES), "x") == [0.125, 0.0, 0.375, 1.0, 0.0]
    assert column(scale.log_transformer(table, ROLES), "x") == pytest.approx([math.log(2), 0, math.log(4), math.log(9), 0])


def test_log_keeps_negative_columns(spark):
    df = spark.createDataFrame([(0, -1.0, "train"), (1, 2.0, "train")], "k int, x double, split string")
    assert column(scale.log_transformer(df, ROLES), "x") == [-1.0, 2.0]


def test_row_normalizer(spark):
    df = spark.createDataFrame([(0, 3.0, 4.0, "train"), (1, 0.0, None, "train")], "k int, x double, y double, split string")
    out = scale.row_normalizer(df, ROLES)
    assert column(out, "x") == [0.6, 0.0] and column(out, "y") == [0.8, 0.0] and out.columns == df.columns


def test_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(i, float(v), "train") for i, v in enumerate([1, 1, 1, 1, 1, 1, 2, 3, 4, 5])]
                               + [(10, -9.0, "test"), (11, 99.0, "test")], "k int, x double, split string")
    edges = np.unique(np.quantile([1, 1, 1, 1, 1, 1, 2, 3, 4, 5], np.linspace(0, 1, 6)))
    want = np.clip(np.searchsorted(edges[1:-1], [1] * 6 + [2, 3, 4, 5, -9, 99], side="right"), 0, len(edges) - 2)
    assert column(scale.quantile_bins(df, ROLES), "x") == want.tolist()


def test_quantile_transformer_follows_interpolation_both_ways(spark):
    values = [1.0, 2.0, 2.0, 2.0, 5.0, 9.0, 9.0]
    df = spark.createDataFrame([(i, v, "train") for i, v in enumerate(values)] + [(7, 3.5, "test"), (8, 100.0, "test"),
                                                                                 (9, -4.0, "test")],
                               "k int, x double, split string")
    asked = np.array(values + [3.5, 100.0, -4.0])
    knots, places = np.quantile(values, np.linspace(0, 1, 7)), np.linspace(0, 1, 7)
    want = (np.interp(asked, knots, places) - np.interp(-asked, -knots[::-1], -places[::-1])) / 2
    assert column(scale.quantile_transformer(df, ROLES), "x") == pytest.approx(want.tolist())


def test_power_transformer_finds_the_likeliest_lambda(spark):
    rng = np.random.default_rng(0)
    x = rng.lognormal(size=400)
    df = spark.createDataFrame([(i, float(v), "train") for i, v in enumerate(x)], "k int, x double, split string")
    lam, mean, std = scale.fit_power(df, {"x": F.col("x")})["x"]

    def likelihood(t):
        y = np.log1p(x) if abs(t) < 1e-12 else ((x + 1) ** t - 1) / t
        return -len(x) / 2 * np.log(y.var()) + (t - 1) * np.log1p(x).sum()

    best = max(np.linspace(-4, 4, 8001), key=likelihood)
    assert lam == pytest.approx(best, abs=2e-3)
    out = np.array(column(scale.power_transformer(df, ROLES), "x"))
    assert out.mean() == pytest.approx(0, abs=1e-9) and out.std() == pytest.approx(1)


def test_products(table):
    poly = features.polynomial_features(table, ROLES)
    assert [c for c in poly.columns if "*" in c] == ["x*x", "x*y", "x*c", "y*y", "y*c", "c*c"]
    assert column(poly, "x*c") == [5.0, 5.0, 15.0, 40.0, 6.0]
    assert "x*x" not in features.interaction_features(table, ROLES).columns


@pytest.fixture
def numbers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 3
    rows = [(i, *map(float, r), "train" if i < 150 else "test") for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "k int, a double, b double, c double, d double, split string")


def test_pca_matches_numpy(numbers):
    x, df = numbers
    center = x[:150].mean(axis=0)
    values, axes = np.linalg.eigh(np.cov(x[:150].T))
    axes = axes[:, ::-1]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), range(4)])
    want = (x - center) @ axes
    out = features.pca_auto(df, ROLES).orderBy("k").toPandas()
    np.testing.assert_allclose(out[["PC1", "PC2", "PC3", "PC4"]].to_numpy(), want, atol=1e-9)
    two = features.kernel_pca(df, ROLES).orderBy("k").toPandas()
    np.testing.assert_allclose(two[["PC1", "PC2"]].to_numpy(), want[:, :2], atol=1e-9)
    assert features.pca_auto(df.select("k", "a", "b", "split"), ROLES).columns == ["k", "a", "b", "split"]


def test_svd_matches_numpy(numbers):
    x, df = numbers
    axes = np.linalg.svd(x[:150])[2].T[:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(2)])
    out = features.truncated_svd(df, ROLES).orderBy("k").toPandas()
    np.testing.assert_allclose(out[["SVD1", "SVD2"]].to_numpy(), x @ axes, atol=1e-9)


def test_tree_embedding_has_one_leaf_per_tree(numbers):
    out = features.random_trees_embedding(numbers[1], ROLES, trees=7, depth=3).toPandas()
    hot = out[[c for c in out.columns if c.startswith("embed_")]].to_numpy()
    assert (hot.sum(axis=1) == 7).all() and set(np.unique(hot)) == {0.0, 1.0}


def test_variance_filter(table):
    assert features.variance_filter(table, ROLES).columns == ["k", "x", "s", "split", "label"]


def test_guards(spark):
    df = spark.createDataFrame([(1.0, 2), (float("inf"), 3)], "x double, y int")
    assert guards.table_guards(df) == {"a": True, "b": True, "c": False, "c1": True, "c2": False, "d": False}
    assert guards.table_guards(df.filter("y < 3"))["d"]
    assert not any(guards.table_guards(df.limit(0)).values())
    assert [tuple(r) for r in guards.clean_numbers(df).collect()] == [(1.0, 2.0), (0.0, 3.0)]


@pytest.mark.parametrize("text,number,letters", [("12.5", True, False), ("+3%", True, True), ("abc", False, True),
                                                 ("12:30", True, True), (" 7 ", False, False), ("", True, True)])
def test_value_tests(spark, text, number, letters):
    row = spark.createDataFrame([(text,)], "s string").select(
        guards.is_number_text(F.col("s")), guards.is_not_a_number(F.col("s"))).first()
    assert tuple(row) == (number, letters)


def test_empty_train_table(spark):
    df = spark.createDataFrame([], "k int, x double, s string, split string")
    for operator in (impute.mean_imputer, impute.category_imputer, scale.min_max_scaler, scale.robust_scaler,
                     scale.quantile_bins, scale.power_transformer, scale.quantile_transformer, encode.one_hot_encoder,
                     encode.label_encoder, features.polynomial_features, features.variance_filter):
        assert operator(df, ROLES).count() == 0
