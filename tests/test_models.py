"""Predictors: formulas against numpy where there is one, else a floor on the accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.functions.columns import Roles
from tableprep.operators.models import bayes, common, linear, neighbors, svc, trees

ROLES = Roles(keys=("k",))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    centers = np.array([[0, 0, 0], [4, 0, 1], [0, 4, -1]])
    y = rng.choice(3, 300, p=[0.6, 0.3, 0.1])
    return centers[y] + rng.normal(size=(300, 3)), y, np.arange(300) < 240


@pytest.fixture(scope="module")
def table(spark, data):
    x, y, train = data
    rows = [(i, *map(float, x[i]), "abc"[y[i]], "train" if train[i] else "test") for i in range(300)]
    return spark.createDataFrame(rows, "k int, p double, q double, r double, label string, split string")


@pytest.mark.parametrize("model,params", [
    (trees.random_forest, {"trees": 5, "depth": 5}), (trees.bagging, {"trees": 3, "depth": 5}),
    (trees.decision_tree, {"depth": 5}), (trees.extra_trees, {"trees": 5, "depth": 5}),
    (trees.ada_boost, {"rounds": 8}), (trees.rus_boost, {"rounds": 8}), (trees.gradient_boosting, {"rounds": 3}),
    (trees.easy_ensemble, {"subsets": 2, "rounds": 4}), (trees.balanced_forest, {"trees": 4, "depth": 5}),
    (linear.logistic_regression, {}), (linear.sgd_classifier, {}), (linear.linear_svc, {}),
    (svc.kernel_svc, {}), (linear.passive_aggressive, {}), (linear.ridge_classifier_cv, {}),
    (neighbors.k_neighbors, {}), (bayes.bernoulli_nb, {})])
def test_accuracy_floor(table, model, params):
    out = model(table, ROLES, **params)
    assert out.count() == 60 and set(out.columns) == {*table.columns, "prediction"}
    assert common.accuracy(out) >= (0.5 if model in (bayes.bernoulli_nb, trees.rus_boost, trees.easy_ensemble) else 0.8)


def predictions(out):
    return ["abc".index(r["prediction"]) for r in out.orderBy("k").collect()]


def test_gaussian_formulas(table, data):
    x, y, train = data
    a, b, t = x[train], y[train], x[~train]
    mean = np.array([a[b == c].mean(axis=0) for c in range(3)])
    var = np.array([a[b == c].var(axis=0) for c in range(3)]) + 1e-9 * a.var(axis=0).max()
    prior = np.log(np.bincount(b) / len(b))
    score = prior - 0.5 * (np.log(2 * np.pi * var).sum(1) + ((t[:, None] - mean) ** 2 / var).sum(-1))
    assert predictions(bayes.gaussian_nb(table, ROLES)) == score.argmax(1).tolist()
    distance = ((t[:, None] - mean) ** 2).sum(-1)
    assert predictions(bayes.nearest_centroid(table, ROLES)) == distance.argmin(1).tolist()
    within = sum((a[b == c] - mean[c]).T @ (a[b == c] - mean[c]) for c in range(3)) / (len(a) - 3)
    inverse = np.linalg.inv(within)
    score = prior + t @ inverse @ mean.T - 0.5 * np.einsum("ij,jk,ik->i", mean, inverse, mean)
    assert predictions(bayes.linear_discriminant(table, ROLES)) == score.argmax(1).tolist()


def test_ridge_formula(table, data):
    x, y, train = data
    a, t = x[train], x[~train]
    target = np.where(y[train][:, None] == np.arange(3), 1.0, -1.0)
    c, m = a - a.mean(axis=0), target - target.mean(axis=0)
    w = np.linalg.solve(c.T @ c + np.eye(3), c.T @ m)
    score = (t - a.mean(axis=0)) @ w + target.mean(axis=0)
    assert predictions(linear.ridge_classifier(table, ROLES)) == score.argmax(1).tolist()


def test_neighbors_vote(table, data):
    x, y, train = data
    d = ((x[~train][:, None] - x[train][None]) ** 2).sum(-1)
    near = y[train][d.argsort(axis=1, kind="stable")[:, :5]]
    want = [np.bincount(row, minlength=3).argmax() for row in near]
    assert predictions(neighbors.k_neighbors(table, ROLES)) == want


def test_single_class(table):
    one = table.filter("label = 'a'")
    for model in (bayes.gaussian_nb, linear.logistic_regression, trees.ada_boost):
        assert {r["prediction"] for r in model(one, ROLES).collect()} == {"a"}


def test_missing_and_infinite_inputs(table):
    dirty = table.withColumn("p", F.when(F.col("k") < 5, float("nan")).when(F.col("k") < 9, float("inf"))
                             .when(F.col("k") < 12, None).otherwise(F.col("p")))
    assert common.accuracy(linear.logistic_regression(dirty, ROLES)) > 0.8


@pytest.fixture(scope="module")
def regression(spark, data):
    x, _, train = data
    rows = [(i, *map(float, x[i]), float(3 * x[i, 0] - 2 * x[i, 1] + 1), "train" if train[i] else "test")
            for i in range(300)]
    return spark.createDataFrame(rows, "k int, p double, q double, r double, label double, split string")


def test_ard_finds_the_weights(regression):
    assert common.rmse(linear.ard_regression(regression, ROLES)) < 1e-3


def test_tree_regressors(regression):
    spread = regression.filter("split = 'test'").agg(F.stddev_pop("label")).first()[0]
    assert common.rmse(trees.bagging_regressor(regression, ROLES, trees=4, depth=6)) < 0.5 * spread
    assert common.rmse(trees.ada_boost_regressor(regression, ROLES, rounds=4)) < 0.6 * spread


def test_too_many_classes(table, monkeypatch):
    monkeypatch.setattr(common, "MAX_CLASSES", 2)
    with pytest.raises(ValueError):
        bayes.gaussian_nb(table, ROLES)


def test_two_classes_are_fitted_without_a_second_copy(spark, monkeypatch):
    seen, fit = [], linear.LogisticRegression.fit
    monkeypatch.setattr(linear.LogisticRegression, "fit", lambda self, rows: seen.append(rows.storageLevel.useMemory) or fit(self, rows))
    rows = spark.range(60).select(F.col("id").cast("double").alias("v"), (F.col("id") < 30).alias("label"), F.when(F.col("id") % 3 > 0, "train").otherwise("test").alias("split"))
    out = linear.logistic_regression(rows)
    assert seen == [False] and out.where("label = prediction").count() >= 18
