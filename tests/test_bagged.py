"""Bagged trees grown from different rows, upper levels together and the rest of each tree in a task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.functions.columns import Roles
from tableprep.operators.models import bagged, growing, trees

ROLES = Roles(keys=("k",))


def frame(spark, label):
    rows = spark.range(4_000).select(F.col("id").alias("k"), (F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                     (F.xxhash64("id") % 3).cast("double").alias("c"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    return rows.withColumn("label", F.expr(label))


def test_a_node_is_split_until_it_is_pure():
    x = np.array([[a, b] for a in range(9) for b in range(5)], np.int16)
    y = (x[:, 0] * 3 + x[:, 1]) % 4
    stats = np.eye(4)[y]
    shape, held = bagged.grow_node(x, stats, growing.gini_gain, lambda s: (s > 0).sum(axis=-1) <= 1, 1, 30, np.random.default_rng(1))
    assert (held[growing.place(shape, x)].argmax(axis=1) == y).all() and held[0].sum() == len(x)
    shape, held = bagged.grow_node(x, stats, growing.gini_gain, lambda s: (s > 0).sum(axis=-1) <= 1, 2, 1, np.random.default_rng(1))
    assert len(shape[0]) == 3 and held[1:].sum() == len(x)


@pytest.mark.parametrize("local", [400_000, 40])
def test_predictions_follow_a_rule_of_two_columns(spark, monkeypatch, local):
    monkeypatch.setattr(bagged, "LOCAL", local)
    df = frame(spark, "CASE WHEN a > 24 AND b > 2 THEN 'x' WHEN a > 24 THEN 'y' ELSE 'z' END")
    for model, options in ((trees.random_forest, {"trees": 12}), (trees.bagging, {"trees": 3})):
        got = model(df, ROLES, **options)
        assert got.count() == 800 and got.where("label <> prediction OR prediction IS NULL").count() == 0
    got = trees.bagging_regressor(frame(spark, "CAST(a * 2 + IF(b > 3, 100, 0) AS double)"), ROLES, trees=4)
    assert got.count() == 800 and got.where("abs(label - prediction) < 8").count() == 800


def test_equal_rows_are_one_in_all_trees(spark, monkeypatch):
    sizes, kept = [], bagged.cut_lineage
    monkeypatch.setattr(bagged, "cut_lineage", lambda df: sizes.append((made := kept(df)).count()) or made)
    df = frame(spark, "IF(a > 24, 'x', 'z')").drop("b", "c")
    assert trees.random_forest(df, ROLES, trees=2).where("label <> prediction").count() == 0
    assert sizes[0] <= 50  # of 3,200 train rows


def test_a_label_that_no_column_tells_and_no_columns(spark):
    assert trees.random_forest(frame(spark, "IF(k % 3 = 0, 'x', 'z')").select("k", "label", "split"), ROLES).where("prediction = 'z'").count() == 800
    flat = frame(spark, "IF(k % 3 = 0, 'x', 'z')").select("k", F.lit(1.0).alias("a"), "label", "split")
    assert trees.bagging(flat, ROLES, trees=5).where("prediction = 'z'").count() == 800
    assert trees.bagging_regressor(flat.withColumn("label", F.lit(4.0)), ROLES, trees=2).where("abs(prediction - 4) < 1e-9").count() == 800
