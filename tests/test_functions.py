"""Shared functions against numpy, pandas or a plain window, with limits set low so that every path runs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tableprep.functions import counts, moments, nearest, ordered, quantiles
from tableprep.functions.columns import Roles, is_missing, numeric_columns

PROBS = [0.0, 0.05, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0]


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


@pytest.fixture
def low_limits(monkeypatch):
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    monkeypatch.setattr(quantiles, "COLLECT_ROWS", 10)


@pytest.mark.parametrize("values", [
    np.random.default_rng(0).normal(size=4000),
    np.random.default_rng(1).exponential(size=3001) ** 6,
    np.repeat([1.0, 5.0, 5.5], [2000, 10, 990]),
    np.concatenate([np.full(1500, 7.0), np.random.default_rng(2).uniform(-1e300, 1e300, 1500)]),
    10.0 ** np.linspace(-200, 200, 1000),
    np.array([3.0]), np.array([2.0, 1.0]),
])
def test_exact_quantiles(spark, low_limits, values):
    got = quantiles.exact_quantiles(frame(spark, x=values), ["x"], PROBS)["x"]
    np.testing.assert_allclose(got, np.quantile(values / 2, PROBS) * 2, rtol=1e-12)


def test_quantiles_skip_missing_values(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None), (None, None)], "x double, y double")
    assert quantiles.exact_quantiles(df, ["x", "y"], [0.5]) == {"x": [2.0], "y": [None]}
    assert quantiles.exact_quantiles(df, [], [0.5]) == {}


@pytest.mark.parametrize("points", [3, 50, 1000])
def test_quantile_grid(spark, points):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=500), rng.integers(0, 4, 500).astype(float)
    grids = quantiles.quantile_grid(frame(spark, x=x, y=y), ["x", "y"], points)
    for name, values in (("x", x), ("y", y)):
        np.testing.assert_allclose(grids[name], np.quantile(values, np.linspace(0, 1, min(points, 500))), rtol=1e-12)


def test_modes_take_the_smallest_on_ties(spark):
    df = frame(spark, a=["b", "a", "b", "a", "c"], x=[2.0, 1.0, 2.0, 1.0, 0.0])
    assert counts.modes(df, {"a": F.col("a")}, "string") == {"a": ("a", 2)}
    assert counts.modes(df, {"x": F.col("x")}, "double") == {"x": (1.0, 2)}


@pytest.mark.parametrize("small", [True, False])
def test_dense_codes(spark, monkeypatch, small):
    monkeypatch.setattr(counts, "is_small", lambda df, limit=0: small)
    words = [f"w{i:04d}" for i in range(300)]
    rows = counts.dense_codes(frame(spark, v=words).repartition(7), ["v"]).collect()
    assert sorted((r["v"], r["code"]) for r in rows) == [(w, i) for i, w in enumerate(words)]


@pytest.fixture
def log(spark):
    rng = np.random.default_rng(4)
    # one key holds a third of all rows, many of them at the same instant
    users = np.where(rng.random(900) < 0.33, 1, rng.integers(2, 30, 900))
    seconds = np.where(rng.random(900) < 0.3, 500, rng.integers(0, 5000, 900))
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(seconds, unit="s")
    return spark.createDataFrame(pd.DataFrame({"id": range(900), "user": users, "ts": ts}))


@pytest.mark.parametrize("rows", [20, 100_000])
def test_number_rows_in_blocks(log, rows):
    got = ordered.number_rows(log, ["user"], ["ts", "id"], ordered.time_block(log, "ts", rows), "n")
    want = log.withColumn("n", F.row_number().over(Window.partitionBy("user").orderBy("ts", "id")))
    assert sorted(got.select("id", "n").collect()) == sorted(want.select("id", "n").collect())


@pytest.mark.parametrize("rows", [20, 100_000])
def test_previous_in_order_across_blocks(log, rows):
    times = log.select("user", "ts").distinct()
    got = ordered.previous_in_order(times, ["user"], "ts", ordered.time_block(times, "ts", rows), "p")
    want = times.withColumn("p", F.lag("ts").over(Window.partitionBy("user").orderBy("ts")))
    key = lambda r: (r["user"], r["ts"])
    assert sorted(map(tuple, got.select("user", "ts", "p").collect()), key=str) == sorted(
        map(tuple, want.select("user", "ts", "p").collect()), key=str)


@pytest.mark.parametrize("size", [5, 7, 10_000])
def test_overlapping_blocks(spark, size):
    steps = spark.range(1, 61).select(F.col("id").alias("step"), (F.col("id") * 7 % 11).alias("v"))
    rows = ordered.overlapping_blocks(steps, "step", 4, size)
    w = Window.partitionBy("_block").orderBy("step").rowsBetween(-4, 0)
    got = ordered.drop_context(rows.withColumn("s", F.sum("v").over(w)))
    want = steps.withColumn("s", F.sum("v").over(Window.orderBy("step").rowsBetween(-4, 0)))
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


@pytest.mark.parametrize("block_rows", [7, 4000])
@pytest.mark.parametrize("width", [2, 12])
def test_nearest_and_radius(spark, monkeypatch, block_rows, width):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(nearest, "CHUNK_VALUES", 500)
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(size=(150, width)), np.full((60, width), 2.0)])  # a hot cell of equal points
    asked = rng.normal(size=(40, width)) * 2
    make = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    far = np.sqrt(((asked[:, None] - points[None]) ** 2).sum(-1))
    hits = nearest.nearest(make(asked), make(points), 6).orderBy("qid", "rank").collect()
    got = np.array([r["id"] for r in hits]).reshape(40, 6)
    assert (got == far.argsort(axis=1, kind="stable")[:, :6]).all()
    radius = float(np.quantile(far, 0.1))
    near = {r["qid"]: r["near"] for r in nearest.neighbours_within(make(asked), make(points), radius).collect()}
    assert [near.get(i, 0) for i in range(40)] == (far <= radius).sum(axis=1).tolist()


def test_nearest_with_fewer_points_than_wanted(spark):
    make = lambda x: spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, vec array<double>")
    points = make([[0.0, 0.0], [5.0, 5.0]])
    rows = nearest.nearest(make([[1.0, 0.0]]), points, 5).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [0, 1]
    assert nearest.nearest(points, points.limit(0), 5).isEmpty()
    assert nearest.neighbours_within(points, points.limit(0), 1.0).isEmpty()


def test_gram_and_skewness(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).repartition(5)
    exprs = {c: F.col(c) for c in "abc"}
    np.testing.assert_allclose(moments.gram(df, exprs), x.T @ x)
    center = x.mean(axis=0)
    np.testing.assert_allclose(moments.gram(df, exprs, center), (x - center).T @ (x - center))
    skew = df.agg(moments.sample_skewness(F.col("a"))).first()[0]
    assert skew == pytest.approx(pd.Series(x[:, 0]).skew())
    assert df.limit(2).agg(moments.sample_skewness(F.col("a"))).first()[0] is None


def test_roles_and_missing(spark):
    df = spark.createDataFrame([(1, 1.0, "a", True, "train", 0)], "k int, x double, s string, b boolean, split string, "
                                                                   "label int")
    roles = Roles(keys=("k",))
    assert roles.numeric(df) == ["x"] and roles.categorical(df) == ["s", "b"]
    assert numeric_columns(df) == ["k", "x", "label"]
    nan = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    assert nan.filter(is_missing(nan, "x")).count() == 2
