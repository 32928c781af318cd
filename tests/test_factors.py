"""Decompositions without a matrix of columns by columns, and mergeable ones, against numpy."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F, types as T

from tableprep.functions import factors
from tableprep.functions.columns import Roles
from tableprep.operators import features

ROLES = Roles(keys=("k",))


def arrays(spark, x, parts=3):
    return spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(parts)


def signed(axes):
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])


@pytest.mark.parametrize("center", [True, False])
def test_leading_directions_match_numpy(spark, center):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 40)) @ np.diag(np.linspace(3, 1, 40)) @ rng.normal(size=(40, 40)) + 50
    found = factors.leading(arrays(spark, x), 40, 3, center)
    y = x - x.mean(axis=0) if center else x
    values, axes = np.linalg.eigh(y.T @ y)
    np.testing.assert_allclose(found.values, values[::-1][:3], rtol=1e-10)
    np.testing.assert_allclose(found.axes, signed(axes[:, ::-1][:, :3]), atol=1e-7)
    assert found.rows == 300 and found.residual < 1e-8


def test_restart_keeps_converging(spark, monkeypatch):
    monkeypatch.setattr(factors, "SPAN", 20)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 120))
    found = factors.leading(arrays(spark, x), 120, 2, True)
    y = x - x.mean(axis=0)
    np.testing.assert_allclose(found.values, np.linalg.eigvalsh(y.T @ y)[::-1][:2], rtol=1e-9)


def test_twenty_thousand_one_hot_columns(spark):
    rng = np.random.default_rng(6)
    d, n = 20_000, 600
    weights = 1.0 / np.arange(1, 301) ** 0.7
    one = rng.choice(300, n, p=weights / weights.sum()) * 41  # few places are taken, all are columns
    two = 12_500 + one // 41 // 10 + rng.integers(0, 3, n)
    hot = [Vectors.sparse(d, sorted({int(a), int(b)}), [1.0] * len({a, b})) for a, b in zip(one, two)]
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", VectorUDT()), T.StructField("split", T.StringType())])
    df = spark.createDataFrame([(i, v, "train") for i, v in enumerate(hot)] + [(n, None, "train")], schema).repartition(3)
    for center in (False, True):
        out = features.truncated_svd_vectors(df, "v", ROLES, center=center).orderBy("k").collect()
        assert out[n]["svd"] is None and out[0].asDict().keys() == {"k", "split", "svd"}
        got = np.array([r["svd"] for r in out[:n]])
        x = np.zeros((n, d))
        for i, v in enumerate(hot):
            x[i, v.indices] = v.values
        x = x - x.mean(axis=0) if center else x
        u, s, axes = np.linalg.svd(x, full_matrices=False)
        np.testing.assert_allclose(got, x @ signed(axes[:2].T), atol=1e-6)


def test_dense_vectors_and_empty_rows(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", VectorUDT()), T.StructField("split", T.StringType())])
    rows = [(0, Vectors.dense([1.0, 2.0, 0.0]), "train"), (1, Vectors.sparse(3, [], []), "train"), (2, Vectors.dense([2.0, 4.0, 0.5]), "test")]
    out = features.truncated_svd_vectors(spark.createDataFrame(rows, schema), "v", ROLES, components=1).orderBy("k").collect()
    np.testing.assert_allclose([r["svd"][0] for r in out], [5 ** 0.5, 0.0, 10 / 5 ** 0.5], atol=1e-9)


def test_states_merge_to_the_same_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(factors, "GROUP", 2)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(230, 6)) @ rng.normal(size=(6, 6)) + 1e4
    whole = factors.factor_of(arrays(spark, x, 5), 6)
    first = factors.factor_of(arrays(spark, x[:3]), 6)
    factors.save_factor(spark, first, str(tmp_path / "state"))
    both = factors.load_factor(spark, str(tmp_path / "state")).merge(factors.factor_of(arrays(spark, x[3:]), 6))
    for state in (whole, both):
        values, axes = state.directions()
        want, vectors = np.linalg.eigh(np.cov(x.T))
        assert state.rows == 230 and state.root.shape[0] <= 6
        np.testing.assert_allclose(state.mean, x.mean(axis=0), rtol=1e-13)
        np.testing.assert_allclose(values, want[::-1], rtol=1e-8)
        np.testing.assert_allclose(axes, signed(vectors[:, ::-1]), atol=1e-6)
    assert factors.factor_of(arrays(spark, x[:0]), 6).rows == 0


def test_kept_directions_follow_the_batches(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2)) @ rng.normal(size=(2, 9)) * 5 + rng.normal(size=(400, 9)) * 1e-4
    state = None
    for part in np.array_split(x, 4):
        new = factors.factor_of(arrays(spark, part), 9, most=2)
        state = new if state is None else state.merge(new)
    assert state.root.shape == (2, 9)
    values, axes = state.directions()
    want, vectors = np.linalg.eigh(np.cov(x.T))
    np.testing.assert_allclose(values, want[::-1][:2], rtol=1e-5)
    np.testing.assert_allclose(np.abs(axes.T @ vectors[:, ::-1][:, :2]), np.eye(2), atol=1e-4)


def test_incremental_operator(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 4)) + 3
    rows = [(i, *map(float, r), "train" if i < 60 else "test") for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, split string")
    one = features.incremental_pca(df, ROLES).orderBy("k").toPandas()
    state = features.incremental_fit(df.where("k < 20"), ROLES)
    state = features.incremental_fit(df.where("k >= 20"), ROLES, state)
    two = features.incremental_transform(df, ROLES, state).orderBy("k").toPandas()
    full = features.pca_full(df, ROLES).orderBy("k").toPandas()
    for c in ("PC1", "PC2", "PC3", "PC4"):
        np.testing.assert_allclose(one[c], full[c], atol=1e-8)
        np.testing.assert_allclose(two[c], full[c], atol=1e-8)
    with pytest.raises(ValueError):
        features.incremental_transform(df.drop("d"), ROLES, state)
    small = df.select("k", "a", "b", "split")
    for f in (features.pca_auto, features.pca_two, features.incremental_pca, features.truncated_svd, features.kernel_pca):
        assert f(small, ROLES).columns == small.columns


@pytest.mark.parametrize("per, center", [(2, True), (30, False)])
def test_directions_of_very_many_columns_stay_in_tables(spark, monkeypatch, per, center):
    monkeypatch.setattr(factors, "_pass", lambda *_: pytest.fail("vectors of every column on the driver"))
    rng, d = np.random.default_rng(3), factors.WIDE + 7
    x, rows = np.zeros((300, 60)), []
    for r in range(300):
        places = rng.choice(50, per, replace=False)
        x[r, places] = rng.normal(size=per) * (1 + (places < 3) * 4) + (places < 10)
        rows.append(([int(p) for p in places * 1_000], [float(v) for v in x[r, places]]))
    found = factors.leading(spark.createDataFrame(rows, "i array<int>, v array<double>"), d, 2, center)
    values, axes = np.linalg.eigh((y := x - x.mean(axis=0) * center).T @ y)
    assert found.rows == 300 and found.axes.shape == (d, 2) and found.residual <= factors.TOLERANCE
    assert np.allclose(found.values, values[::-1][:2], rtol=1e-9)
    assert np.allclose(found.axes[np.arange(60) * 1_000 % d], factors.positive(axes[:, ::-1][:, :2]), atol=1e-6)


def test_very_many_columns_without_a_number(spark):
    empty = spark.createDataFrame([([], [])], "i array<int>, v array<double>")
    assert factors.leading(empty, factors.WIDE + 1, 2, False).values.tolist() == [0, 0]


def test_wide_rows_are_projected_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(r, sorted(rng.choice(12, 3, replace=False).tolist()), (rng.normal(size=3) * [9, 3, 1]).tolist(), "train" if r < 60 else "test") for r in range(80)]
    rows += [(80, [], [], "train"), (81, None, [1.0], "train"), (82, None, None, "test"), (83, [1, 1, 4], [1.0, 2.0, 5.0], "test")]
    df = spark.createDataFrame(rows, "k int, i array<int>, v array<double>, split string").repartition(3)

    def made(df, center):
        out = features.truncated_svd_sparse(df, F.col("i"), F.col("v"), 12, ROLES, 2, center=center)
        assert out.columns == ["k", "i", "v", "split", "svd"]
        return {r["k"]: r["svd"] for r in out.collect()}

    narrow = {center: made(df, center) for center in (False, True)}
    monkeypatch.setattr(factors, "WIDE", 5)
    monkeypatch.setattr(factors, "_leading_wide", None)  # no direction is brought to the driver
    monkeypatch.setattr(factors, "project", None)
    for center, want in narrow.items():
        got = made(df, center)
        assert got.keys() == want.keys() and got[81] is None and got[82] is None
        for k in got.keys() - {81, 82}:
            np.testing.assert_allclose(got[k], want[k], atol=1e-6)
    empty = made(df.where("k >= 80"), False)
    assert [list(empty[k]) for k in (80, 83)] == [[0, 0], [0, 3]]
