"""Trees grown level by level, against plain versions."""

import math

import numpy as np
import pytest

from tableprep.functions.columns import Roles
from tableprep.operators.models import growing, trees
from tableprep.operators.models.common import classification

ROLES = Roles(keys=("k",))


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.integers(0, 12, 700), rng.integers(0, 5, 700), rng.integers(0, 3, 700)]).astype(float)
    y = np.where(x[:, 0] > 8, 2, np.where(x[:, 1] > 2, 1, 0))
    y = np.where(rng.random(700) < 0.1, rng.integers(0, 3, 700), y)
    split = np.where(rng.random(700) < 0.8, "train", "test")
    return x, y, split


def frame(spark, table, names="abc"):
    x, y, split = table
    rows = [(i, *map(float, v), "nml"[c], s) for i, (v, c, s) in enumerate(zip(x, y, split))]
    return spark.createDataFrame(rows, f"k long, {', '.join(f'{n} double' for n in names)}, label string, split string").repartition(5)


def cuts_of(x):
    return [np.unique(c)[:-1] for c in x.T]


def plain_boost(x, y, k, rounds, depth, rate):
    """Softmax boosting with every distinct value as a cut; scores of the rows."""
    f = np.tile(np.log(np.bincount(y, minlength=k) / len(y)), (len(y), 1))

    def grow(rows, g, h, left_depth):
        best = None
        if left_depth and len(rows) >= 2:
            for j, cuts in enumerate(cuts_of(x)):
                for c in cuts:
                    go = x[rows, j] <= c
                    a, b = go.sum(), (~go).sum()
                    if a and b:
                        gain = (g[rows][go].mean() - g[rows][~go].mean()) ** 2 * a * b / (a + b)
                        if best is None or gain > best[0] * (1 + 1e-12):
                            best = (gain, j, c, go)
        if best is None:
            out = np.zeros(len(x))
            out[rows] = g[rows].sum() / h[rows].sum() if h[rows].sum() > 1e-150 else 0
            return out
        return grow(rows[best[3]], g, h, left_depth - 1) + grow(rows[~best[3]], g, h, left_depth - 1)

    for _ in range(rounds):
        p = np.exp(f - f.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        step = np.column_stack([grow(np.arange(len(x)), (y == c) - p[:, c], p[:, c] * (1 - p[:, c]), depth) for c in range(k)])
        f = f + rate * (k - 1) / k * step
    return f


def test_softmax_boosting_matches_a_plain_version(spark, table):
    x, y, split = table
    task = classification(frame(spark, table), ROLES)
    assert task.classes == ["l", "m", "n"]
    code = np.array([2, 1, 0])[y]
    train = split == "train"
    edges = growing.quantile_edges(task)
    base = growing.bucketed(growing.raw_base(task), edges)
    sizes = np.bincount(code[train], minlength=3).astype(float)
    model = growing.boost_softmax(base, sizes, 3, 5, 2, 0.3, 0, keep=2)
    assert len(model.trees) == 15
    got = model.start + growing.valued(model, edges).scores(x[train])
    np.testing.assert_allclose(got, plain_boost(x[train], code[train], 3, 5, 2, 0.3), atol=1e-9)


def test_two_classes_and_missing_parts(spark, table):
    x, y, split = table
    two = (x, (y > 0).astype(int), split)
    out = trees.gradient_boosting(frame(spark, two), ROLES, rounds=5)
    hit = out.selectExpr("avg(int(label = prediction))").first()[0]
    assert hit > 0.8 and sorted(out.columns) == sorted(["k", "a", "b", "c", "label", "split", "prediction"])
    one = frame(spark, (x, y * 0, split))
    assert {r["prediction"] for r in trees.gradient_boosting(one, ROLES).collect()} == {"n"}
    bare = frame(spark, table).select("k", "label", "split")
    most = max("nml", key=lambda c: sum((split == "train") & (np.array(list("nml"))[y] == c)))
    assert {r["prediction"] for r in trees.gradient_boosting(bare, ROLES).collect()} == {most}
    assert len({r["prediction"] for r in trees.extra_trees(bare, ROLES, trees=3).collect()}) == 1


@pytest.mark.parametrize("rows, draws", [(10, 7), (5_000, 5_000), (2_049, 3), (1, 4)])
def test_draws_are_exact_and_the_same_in_parts(rows, draws):
    whole = growing.draw_counts(3, 1, 0, rows, draws, 0, rows)
    assert whole.sum() == draws
    cuts = sorted({0, rows // 3, rows // 2, rows})
    assert np.array_equal(np.concatenate([growing.draw_counts(3, 1, 0, rows, draws, a, b) for a, b in zip(cuts, cuts[1:])]), whole)
    assert rows < 100 or not np.array_equal(whole, growing.draw_counts(3, 2, 0, rows, draws, 0, rows))


def test_draws_are_even():
    total = sum(growing.draw_counts(5, t, 1, 3_000, 3_000, 0, 3_000) for t in range(200))
    assert abs(total.mean() - 200) < 1e-9 and abs(total.std() / math.sqrt(200) - 1) < 0.1
    assert abs(total[:1024].mean() - 200) < 3 and abs(total[2048:].mean() - 200) < 3


def test_balanced_trees_draw_equal_classes(spark, table):
    x, y, split = table
    task = classification(frame(spark, table), ROLES)
    least = min(np.bincount(y[split == "train"]))
    forest = trees.balanced_trees(task, 12, 4, 1, None)
    assert all(np.array_equal(stats[0], [least] * 3) for stats in forest.stats)
    for column, stats, left, right in zip(forest.column, forest.stats, forest.left, forest.right):
        assert all(np.array_equal(stats[n], stats[left[n]] + stats[right[n]]) for n, c in enumerate(column) if c >= 0)
    assert len({tuple(c) for c in forest.column}) > 1
    assert trees.balanced_trees(task, 3, 4, 1, None).cut == trees.balanced_trees(task, 3, 4, 1, None).cut


def test_bucket_trees_take_the_best_cut(spark, table):
    x, y, split = table
    task = classification(frame(spark, table), ROLES)
    code, train = np.array([2, 1, 0])[y], split == "train"
    edges = growing.quantile_edges(task)
    base = growing.bucketed(growing.raw_base(task), edges)
    g = growing.Growth(base, 3, 3, growing.gini_gain, lambda batch, t, s: [(batch.column(1).to_numpy(), None)],
                       lambda s: not growing.impure(s), 3, 3)
    forest = growing.unbucketed(growing.grow(g, 1), edges)

    def check(node, rows):
        assert np.array_equal(forest.stats[0][node], np.bincount(code[rows], minlength=3))
        if forest.column[0][node] < 0:
            return
        j, c = forest.column[0][node], forest.cut[0][node]
        gain = lambda j, c: growing.gini_gain(*[np.bincount(code[rows][go], minlength=3)[None] for go in (x[rows, j] <= c, x[rows, j] > c)])
        best = max(v[0] for jj, cuts in enumerate(cuts_of(x[rows])) for v, ok in [gain(jj, cc) for cc in cuts] if ok[0])
        assert gain(j, c)[0][0] >= best - 1e-9
        check(forest.left[0][node], rows[x[rows, j] <= c])
        check(forest.right[0][node], rows[x[rows, j] > c])

    check(0, np.flatnonzero(train))


def test_extra_trees_cut_at_random_inside_the_node(spark, table):
    x, y, split = table
    df = frame(spark, table)
    task = classification(df, ROLES)
    base = growing.raw_base(task)
    g = growing.Growth(base, 3, 3, growing.gini_gain, lambda batch, t, s: [(batch.column(1).to_numpy(), None)],
                       lambda s: not growing.impure(s), 1, 30, buckets=2, random_cuts=True)
    forest = growing.grow(g, 6)
    rows = x[split == "train"]
    code = np.array([2, 1, 0])[y][split == "train"]
    roots = {(c[0], v[0]) for c, v in zip(forest.column, forest.cut)}
    assert len(roots) == 6
    for t, tree in enumerate(forest.shape()):
        leaf = growing.place(tree, rows)
        for n in np.unique(leaf):
            mine = leaf == n
            assert np.array_equal(forest.stats[t][n], np.bincount(code[mine], minlength=3))
            assert len(np.unique(code[mine])) == 1 or len(np.unique(rows[mine], axis=0)) == 1  # grown to the end
    got = trees.extra_trees(df, ROLES, trees=20)
    assert got.selectExpr("avg(int(label = prediction))").first()[0] > 0.75


def test_passes_are_cut_when_many_nodes_are_open(spark, table, monkeypatch):
    task = classification(frame(spark, table), ROLES)
    whole = trees.balanced_trees(task, 5, 5, 2, 3)
    monkeypatch.setattr(growing, "CELLS", 1_000)
    parts = trees.balanced_trees(task, 5, 5, 2, 3)
    assert whole.column == parts.column and whole.cut == parts.cut


def _plain_median(x, y, rounds, depth):
    """AdaBoost.R2 with linear loss on all values as cuts: predictions of the rows themselves."""
    def tree(rows, w, level):
        mean, best = (w[rows] @ y[rows]) / w[rows].sum(), (0.0, None)
        for j in range(x.shape[1]):
            for c in np.unique(x[rows, j])[:-1]:
                a, b = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                p, q = w[a].sum(), w[b].sum()
                gain = (w[a] @ y[a] / p - w[b] @ y[b] / q) ** 2 * p * q / (p + q)
                if gain > best[0] * (1 + 1e-12):
                    best = gain, (a, b)
        if level == 0 or best[1] is None:
            return [(rows, mean)]
        return [leaf for side in best[1] for leaf in tree(side, w, level - 1)]

    w, found, votes = np.ones(len(y)), [], []
    for _ in range(rounds):
        p = np.zeros(len(y))
        for rows, mean in tree(np.arange(len(y)), w, depth):
            p[rows] = mean
        error = np.abs(p - y)
        loss = (w @ error) / error.max() / w.sum()
        if loss >= 0.5:
            break
        beta = loss / (1 - loss)
        found, votes, w = [*found, p], [*votes, -np.log(beta)], w * beta ** (1 - error / error.max())
    found, votes = np.array(found), np.array(votes)
    order = found.argsort(axis=0)
    at = (votes[order].cumsum(axis=0) >= votes.sum() / 2 - 1e-12).argmax(axis=0)
    return found[order[at, np.arange(len(y))], np.arange(len(y))]


def test_ada_boost_regressor_is_the_plain_one_in_one_job_a_level(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 12, 400), rng.integers(0, 7, 400)], axis=1).astype(float)
    y = 100 + x[:, 0] ** 2 - 9 * x[:, 1] + rng.normal(0, 6, 400)
    rows = [(i, *map(float, v), float(t), s) for s in ("train", "test") for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, a double, b double, label double, split string").repartition(3)
    context, rounds, depth = spark.sparkContext, 12, 3  # more rounds than trees that are carried along
    context.setJobGroup("boost", "")
    out = trees.ada_boost_regressor(df, Roles(keys=("id",)), rounds=rounds, depth=depth)
    context.setJobGroup("after", "")
    assert len(context.statusTracker().getJobIdsForGroup("boost")) <= rounds * (depth + 1) + 10
    got = {r["id"]: r["prediction"] for r in out.collect()}
    assert np.allclose([got[i] for i in range(400)], _plain_median(x, y, rounds, depth))
    flat = df.selectExpr("id", "'x' AS a", "label", "split")
    assert len({r["prediction"] for r in trees.ada_boost_regressor(flat, Roles(keys=("id",)), rounds=3).collect()}) == 1
