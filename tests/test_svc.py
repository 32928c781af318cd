"""Kernel support vectors against a plain solver of the dual problem."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.functions.columns import Roles
from tableprep.operators.models import svc


def plain(x, y, gamma, c):
    """Decision values on x: the dual by projected coordinate pairs, to a tolerance far below the operator's."""
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    a, n = np.zeros(len(y)), len(y)
    for _ in range(200_000):
        force = y - k @ (a * y)
        up = [i for i in range(n) if (a[i] < c if y[i] > 0 else a[i] > 0)]
        low = [i for i in range(n) if (a[i] > 0 if y[i] > 0 else a[i] < c)]
        i, j = max(up, key=lambda m: force[m]), min(low, key=lambda m: force[m])
        if force[i] - force[j] < 1e-7:
            break
        step = (force[i] - force[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        for m in (i, j):
            a[m] = 0 if a[m] < 1e-13 else c if a[m] > c - 1e-13 else a[m]
    free = (a > 0) & (a < c)
    return k @ (a * y) + force[free].mean(), a


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 2))
    y = np.where((x ** 2).sum(axis=1) + rng.normal(scale=0.4, size=160) > 1.5, 1.0, -1.0)
    return x, y


def state(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), float(s)) for i, (v, s) in enumerate(zip(x, y))], "id long, x array<double>, sign double").repartition(3)


@pytest.mark.parametrize("working, block", [(1000, 1000), (40, 1000), (30, 25)])
def test_decision_values_match_the_dual(spark, cloud, working, block):
    x, y = cloud
    want, a = plain(x, y, 0.5, 1.0)
    vectors, constant, gap = svc.fit(state(spark, x, y), 0.5, 1.0, 1e-6, working=working, block=block)
    assert gap <= 1e-6
    rows = state(spark, x, y)
    got = rows.select("id", svc.decision(vectors, constant, 0.5, F.col("x")).alias("d")).orderBy("id").toPandas()["d"].to_numpy()
    np.testing.assert_allclose(got, want, atol=1e-4)
    assert {r["id"] for r in vectors.collect()} == set(np.flatnonzero(a > 0))


def test_cascade_ends_when_all_rows_support(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 2)), np.where(rng.random(60) < 0.5, 1.0, -1.0)
    assert svc.cascade(state(spark, x * 100, y), 5.0, 1.0, 1e-4, block=10) is None
    _, _, gap = svc.fit(state(spark, x * 100, y), 5.0, 1.0, 1e-4, working=20, block=10)
    assert gap <= 1e-4


def test_blocks_of_one_class_keep_their_rows(spark, cloud):
    x, y = cloud
    rare = np.where(np.arange(160) < 3, 1.0, -1.0)
    vectors, constant, gap = svc.fit(state(spark, x, rare), 0.5, 1.0, 1e-5, working=50, block=20)
    want, _ = plain(x, rare, 0.5, 1.0)
    got = state(spark, x, rare).select("id", svc.decision(vectors, constant, 0.5, F.col("x")).alias("d")).orderBy("id").toPandas()["d"].to_numpy()
    np.testing.assert_allclose(got, want, atol=1e-3)


def test_predictor_on_rings(spark, cloud):
    x, _ = cloud
    ring = np.digitize((x ** 2).sum(axis=1), [0.8, 2.5])
    rows = [(i, *map(float, v), "abc"[c], "test" if i % 4 == 0 else "train") for i, (v, c) in enumerate(zip(x, ring))]
    df = spark.createDataFrame(rows, "k long, u double, v double, label string, split string")
    out = svc.kernel_svc(df, Roles(keys=("k",)), c=10.0)
    assert out.selectExpr("avg(int(label = prediction))").first()[0] > 0.85
    one = svc.kernel_svc(df.where("label = 'b'"), Roles(keys=("k",)))
    assert {r["prediction"] for r in one.collect()} == {"b"}


@pytest.mark.parametrize("working, block", [(1000, 1000), (40, 25)])
def test_equal_rows_are_one_with_their_number(spark, cloud, working, block):
    x, y = cloud[0].round(0), cloud[1]  # many equal rows, some of both signs
    want, _ = plain(x, y, 0.5, 1.0)
    merged = state(spark, x, y).groupBy("x", "sign").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    vectors, constant, gap = svc.fit(merged, 0.5, 1.0, 1e-6, working=working, block=block)
    assert gap <= 1e-6
    got = state(spark, x, y).select("id", svc.decision(vectors, constant, 0.5, F.col("x")).alias("d")).orderBy("id").toPandas()["d"].to_numpy()
    np.testing.assert_allclose(got - got.mean(), want - want.mean(), atol=1e-4)


def test_the_work_is_on_different_rows(spark, monkeypatch):
    sizes, fit = [], svc.fit
    monkeypatch.setattr(svc, "fit", lambda rows, *a, **k: sizes.append(rows.count()) or fit(rows, *a, **k))
    rows = spark.range(3000).select((F.col("id") % 30).cast("double").alias("v"), (F.col("id") % 30 < 12).alias("label"),
                                    F.when(F.col("id") < 2900, "train").otherwise("test").alias("split"))
    out = svc.kernel_svc(rows, Roles())
    assert sizes == [30] and out.where("label = prediction").count() == out.count() == 100
