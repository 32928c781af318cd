"""Bagged trees: every tree on a bootstrap of its own, as deep as asked for, predictions averaged.

Columns are cut into buckets once, and rows that no cut can tell apart are one from then on, so the work follows the number of
different rows. The upper levels of all trees are grown in shared passes (`growing.grow`) until a node has at most LOCAL of
them; where the whole table has no more, that is the root. Then the rows of each such node meet in one task, which grows the
rest of that tree and passes the test rows of the node down, in batches. No finished tree reaches the driver: it gets the
upper levels alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tableprep.operators.models import growing
from tableprep.operators.models.common import TARGET, Task, argmax
from tableprep.session import Kept, cut_lineage

LOCAL = 400_000    # different rows of a node that one task grows the rest of a tree from
TOGETHER = 25      # trees dealt out at the same time
CELLS = 4_000_000  # numbers of one table of statistics


def edges_of(task: Task, buckets: int = growing.BUCKETS) -> list[np.ndarray]:
    """Places where columns may be cut: all values but the last where there are few, else quantiles."""
    d = len(task.names)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * d
        for batch in batches:
            for j in range(d):
                if len(seen[j]) <= buckets:
                    seen[j] = np.unique(np.concatenate((seen[j], batch.column(j).to_numpy(zero_copy_only=False))))[:buckets + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d, dtype=np.int32), [len(s) for s in seen])),
                                          pa.array(np.concatenate(seen))], ["j", "value"])

    rows = task.train.select(*[x.cast("double").alias(f"x{j}") for j, x in enumerate(task.x)])
    found = rows.mapInArrow(values, "j int, value double").distinct().toPandas()
    few = [np.unique(found["value"][found["j"] == j]) for j in range(d)]
    wide = [task.names[j] for j in range(d) if len(few[j]) > buckets]
    quantiles = task.train.approxQuantile(wide, [i / buckets for i in range(1, buckets)], 0.001) if wide else []
    named = dict(zip(wide, quantiles))
    return [np.unique(np.array(named[n], dtype=float)) if n in named else few[j][:-1] for j, n in enumerate(task.names)]


def _bucket(edges: np.ndarray):
    @F.pandas_udf("short")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(dtype=float), "left").astype(np.int16))

    return place


def with_buckets(task: Task, rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    return rows.withColumns({f"_b{j}": _bucket(e)(x.cast("double")) for j, (e, x) in enumerate(zip(edges, task.x))})


# --- one node in one task ------------------------------------------------------------------------------------------

def grow_node(x: np.ndarray, stats: np.ndarray, gain, done, look: int, depth: int, rng: np.random.Generator):
    """A tree from bucket numbers (rows, columns) and statistics (rows, numbers), level by level, as the arrays of
    `growing.place` and the statistics of every node. A node looks at `look` columns, at more if none of them can be cut."""
    d, s, buckets = x.shape[1], stats.shape[1], int(x.max(initial=0)) + 1
    column, cut, left, right, held = [np.full(1, -1, np.int32)], [np.zeros(1)], [np.zeros(1, np.int32)], [np.zeros(1, np.int32)], [stats.sum(axis=0)[None]]
    made, at = 1, np.zeros(len(x), np.int64)  # nodes so far; the open node of each row that is left
    first, many = 0, 0 if done(held[0])[0] or not d else 1  # the open nodes are numbered in a row
    open_ = np.zeros(many, np.int64)
    rows = np.arange(len(x)) if many else np.zeros(0, int)
    step = max(1, CELLS // (buckets * s))
    for _ in range(depth):
        if not len(open_):
            break
        order = rng.random((len(open_), d)).argsort(axis=1) if look < d else np.tile(np.arange(d), (len(open_), 1))
        best, where, spot = np.full(len(open_), -np.inf), np.full(len(open_), -1), np.zeros(len(open_), np.int64)
        lower = np.zeros((len(open_), s))
        sort = np.argsort(at, kind="stable")
        rows, at = rows[sort], at[sort]
        for a in range(0, len(open_), step):
            b = min(a + step, len(open_))
            low, high = np.searchsorted(at, (a, b))
            mine, node = rows[low:high], at[low:high] - a
            for p in range(d):
                if p >= look and np.isfinite(best[a:b]).all():
                    break
                some = slice(None) if p < look else np.flatnonzero(~np.isfinite(best[a:b])[node])
                r, n = mine[some], node[some]
                flat = n * buckets + x[r, order[a + n, p]]
                table = np.stack([np.bincount(flat, stats[r, i], (b - a) * buckets) for i in range(s)], axis=1).reshape(b - a, buckets, s)
                one = table.cumsum(axis=1)
                two = one[:, -1:] - one
                worth, valid = gain(one[:, :-1], two[:, :-1])
                worth = np.where(valid, worth, -np.inf)
                if not worth.shape[1]:
                    continue
                c = worth.argmax(axis=1)
                i = np.arange(b - a)
                better = np.flatnonzero(worth[i, c] > best[a:b])
                best[a + better], where[a + better], spot[a + better] = worth[better, c[better]], order[a + better, p], c[better]
                lower[a + better] = one[better, c[better]]
        split = np.flatnonzero(where >= 0)
        every, ids = np.concatenate(held), open_[split]
        columns, cuts, lefts, rights = map(np.concatenate, (column, cut, left, right))
        columns[ids], cuts[ids] = where[split], spot[split]
        lefts[ids] = made + 2 * np.arange(len(split))
        rights[ids] = lefts[ids] + 1
        children = np.stack((lower[split], every[ids] - lower[split]), axis=1).reshape(-1, s)
        new = len(children)
        column, cut = [columns, np.full(new, -1, np.int32)], [cuts, np.zeros(new)]
        left, right = [lefts, np.zeros(new, np.int32)], [rights, np.zeros(new, np.int32)]
        held = [every, children]
        going = np.flatnonzero(~done(children)) if new else np.zeros(0, int)
        number = np.full(2 * len(open_), -1)
        place = np.full(len(open_), -1)
        place[split] = np.arange(len(split))
        rank = np.full(new, -1)
        rank[going] = np.arange(len(going))
        on = place[at] >= 0
        rows, at = rows[on], at[on]
        child = 2 * place[at] + (x[rows, where[at]] > spot[at])
        at = rank[child]
        rows, at = rows[at >= 0], at[at >= 0]
        open_ = made + going
        made += new
    return tuple(map(np.concatenate, (column, cut, left, right))), np.concatenate(held)


def _rest(task_seed: int, gain, done, look: int, depth: int, value):
    """The function over rows (tree, node, deep, test, x, stats), sorted by the first four, that grows the rest of every node
    and gives (x, v) of its test rows: what the leaf adds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, model = None, [], None
        for batch in growing._filled(batches):
            tree, node, deep, test = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x, stats = growing._values(batch.column(4), batch.num_rows), growing._values(batch.column(5), max(1, int((~test).sum())))
            before = np.cumsum(~test) - ~test  # test rows have no statistics
            begin = np.flatnonzero((np.diff(tree, prepend=-1) != 0) | (np.diff(node, prepend=-1) != 0) | (np.diff(test.astype(int), prepend=-1) != 0))
            out = []
            for a, b in zip(begin, [*begin[1:], batch.num_rows]):
                if (tree[a], node[a]) != key:
                    key, held, model = (tree[a], node[a]), [], None
                if not test[a]:
                    held.append((x[a:b], stats[before[a]:before[a] + b - a]))
                    continue
                if model is None and held:
                    rng = np.random.default_rng([task_seed, int(tree[a]), int(node[a])])
                    shape, every = grow_node(*map(np.concatenate, zip(*held)), gain, done, look, depth - int(deep[a]), rng)
                    held, model = [], (shape, value(every))
                if model is not None:
                    out.append((x[a:b], model[1][growing.place(model[0], x[a:b])]))
            if out:
                xs, vs = map(np.concatenate, zip(*out))
                yield pa.RecordBatch.from_arrays([_lists(xs), _lists(vs)], ["x", "v"])

    return run


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


# --- all trees -----------------------------------------------------------------------------------------------------

def _deal(forest: growing.Forest, trees: range, depth: int, open_, draw, value, s: int):
    """(function over train rows, function over test rows): where rows go on in a task, and what ended leaves add."""
    shape = forest.shape()
    ended = {t: np.array([forest.column[t][n] < 0 and not open_(forest, t, n) for n in range(len(forest.column[t]))]) for t in trees}
    deep = {t: np.array(forest.depth[t], np.int32) for t in trees}
    adds = {t: value(np.array([np.zeros(s) if v is None else v for v in forest.stats[t]])) for t in trees}

    def batch_of(t: int, node, test: bool, x, stats, v) -> pa.RecordBatch:
        n = len(node)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, t, np.int32)), pa.array(node.astype(np.int32)), pa.array(deep[t][node]), pa.array(np.full(n, test)),
             _lists(x), _lists(stats), _lists(v)], ["tree", "node", "deep", "test", "x", "stats", "v"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in growing._filled(batches):
            x = growing._values(batch.column(0), batch.num_rows)
            for t in trees:
                stats = draw(batch, t, state)
                node = growing.place(shape[t], x)
                rows = np.flatnonzero(stats.any(axis=1) & ~ended[t][node])
                if len(rows):
                    yield batch_of(t, node[rows], False, x[rows], stats[rows], np.zeros((len(rows), 0)))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in growing._filled(batches):
            x = growing._values(batch.column(0), batch.num_rows)
            for t in trees:
                node = growing.place(shape[t], x)
                over = ended[t][node]
                for rows, v in ((np.flatnonzero(~over), None), (np.flatnonzero(over), adds[t])):
                    if len(rows):
                        yield batch_of(t, node[rows], True, x[rows], np.zeros((len(rows), 0)), np.zeros((len(rows), 0)) if v is None else v[node[rows]])

    return train, test


def _sums(task: Task, base: DataFrame, size: int, trees: int, depth: int, seed: int, look: int, gain, done, draw, value, width: int,
          edges: list[np.ndarray]) -> DataFrame:
    """(_b0, …, v0, …, n): per different test row, sums over the trees of what its leaves give, and the number of trees. draw: from
    a batch, the tree and a state to the statistics (rows, size) of the rows in that tree's sample."""
    d = len(task.names)

    def measures(batch: pa.RecordBatch, tree: int, state):
        stats = draw(batch, tree, state)
        return [*[(i, stats[:, i]) for i in range(size)], (size, stats.any(axis=1).astype(float))]

    def few(stats: np.ndarray) -> bool:
        return stats[-1] <= LOCAL or bool(done(stats[None, :-1])[0])

    if base.count() > LOCAL:
        forest = growing.grow(growing.Growth(base, d, size + 1, lambda a, b: gain(a[..., :-1], b[..., :-1]), measures, few, look, depth, seed, start=dict), trees)
        forest.stats = [[None if v is None else v[:-1] for v in stats] for stats in forest.stats]
    else:
        forest = growing.Forest(trees)

    def open_(forest: growing.Forest, t: int, node: int) -> bool:
        stats = forest.stats[t][node]
        return stats is None or not (done(stats[None])[0] or forest.depth[t][node] >= depth)

    fields = "tree int, node int, deep int, test boolean, x array<short>, stats array<double>, v array<double>"
    order = ["tree", "node", "test"]
    keys = [f"_b{j}" for j in range(d)]
    cells = cut_lineage(with_buckets(task, task.test, edges).select(*keys).distinct().select(F.array(*keys).alias("x")))
    totals = [F.sum(F.col("v")[c]).alias(f"v{c}") for c in range(width)] + [F.count("*").alias("n")]
    with ExitStack() as held:
        parts = []
        for first in range(0, trees, TOGETHER):
            train, test = _deal(forest, range(first, min(first + TOGETHER, trees)), depth, open_, draw, value, size)
            dealt = base.mapInArrow(train, fields).unionByName(cells.mapInArrow(test, fields))
            rest = dealt.where("size(v) = 0").drop("v").repartition("tree", "node").sortWithinPartitions(*order)
            grown = rest.mapInArrow(_rest(seed, gain, done, look, depth, value), "x array<short>, v array<double>")
            parts.append(held.enter_context(Kept(grown.groupBy("x").agg(*totals))))
            if base.count() > LOCAL:
                ended = cells.mapInArrow(test, fields).where("size(v) > 0").select("x", "v")
                parts.append(held.enter_context(Kept(ended.groupBy("x").agg(*totals))))
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        summed = every.groupBy("x").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in range(width)], F.sum("n").alias("n"))
        return cut_lineage(summed.select(*[F.col("x")[j].alias(k) for j, k in enumerate(keys)], *[f"v{c}" for c in range(width)], "n"))


def _joined(task: Task, sums: DataFrame, edges: list[np.ndarray], prediction) -> DataFrame:
    keys = [f"_b{j}" for j in range(len(task.names))]
    return task.predicted(with_buckets(task, task.test, edges).join(sums, keys, "left"), prediction)


def classify(task: Task, trees: int, depth: int, seed: int, look: int) -> DataFrame:
    """Mean class shares of the leaves; the first class on ties. How often a row of several equal ones is drawn is Poisson with
    their number as mean, as for each of them alone."""
    k = len(task.classes)
    if not task.names:
        sizes = {int(r[TARGET]): r["count"] for r in task.train.groupBy(TARGET).count().collect()}
        return task.predicted(task.test, task.class_of(F.lit(max(range(k), key=lambda c: sizes.get(c, 0)))))
    edges = edges_of(task)
    keys = [f"_b{j}" for j in range(len(edges))]
    rows = with_buckets(task, task.train, edges).groupBy(*keys, F.col(TARGET).cast("int").alias("y")).agg(F.count("*").cast("double").alias("n"))
    base = cut_lineage(rows.select(F.array(*keys).alias("x"), "y", "n"))

    def draw(batch: pa.RecordBatch, tree: int, state: dict) -> np.ndarray:
        if state.get("batch") is not batch:
            state.update(batch=batch, number=state.get("number", 0) + 1)
        rng = np.random.default_rng([seed, tree, TaskContext.get().partitionId(), state["number"]])
        stats = np.zeros((batch.num_rows, k))
        stats[np.arange(batch.num_rows), batch.column(1).to_numpy()] = rng.poisson(batch.column(2).to_numpy())
        return stats

    def done(stats: np.ndarray) -> np.ndarray:
        return (stats > 0).sum(axis=-1) <= 1

    def shares(stats: np.ndarray) -> np.ndarray:
        return stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300)

    sums = _sums(task, base, k, trees, depth, seed, look, growing.gini_gain, done, draw, shares, k, edges)
    best = argmax([F.coalesce(F.round(f"v{c}", 9), F.lit(0.0)) for c in range(k)])
    return _joined(task, sums, edges, task.class_of(best))


def mean_gain(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gain, valid) of cuts from (weight, sum): how far apart the means lie; differences of rounding are none."""
    gain, valid = growing.spread_gain(left, right)
    with np.errstate(divide="ignore", invalid="ignore"):
        level = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0]
    return gain, valid & (gain > 1e-24 * level)


def regress(task: Task, trees: int, depth: int, seed: int, look: int) -> DataFrame:
    """Mean of the leaves' means. Every row's draws are made before equal rows become one, so that each tree adds up the
    targets of its own sample."""
    if not task.names:
        mean = task.train.agg(F.avg(TARGET)).first()[0]
        return task.predicted(task.test, F.lit(mean))
    edges = edges_of(task)
    d = len(edges)
    keys = [f"_b{j}" for j in range(d)]
    counted = [f"{c}{t}" for t in range(trees) for c in "ws"]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in growing._filled(batches):
            y = batch.column(d).to_numpy()
            drawn = [rng.poisson(1.0, len(y)).astype(float) for _ in range(trees)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:d], *[pa.array(v) for w in drawn for v in (w, w * y)]], [*keys, *counted])

    rows = with_buckets(task, task.train, edges).select(*keys, F.col(TARGET).alias("y"))
    rows = rows.mapInArrow(sample, ", ".join([*[f"{c} short" for c in keys], *[f"{c} double" for c in counted]]))
    merged = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counted])
    base = cut_lineage(merged.select(F.array(*keys).alias("x"), *counted))

    def draw(batch: pa.RecordBatch, tree: int, state: dict) -> np.ndarray:
        return np.column_stack([batch.column(1 + 2 * tree).to_numpy(), batch.column(2 + 2 * tree).to_numpy()])

    def done(stats: np.ndarray) -> np.ndarray:
        return np.zeros(len(stats), bool)

    def means(stats: np.ndarray) -> np.ndarray:
        return stats[:, 1:] / np.maximum(stats[:, :1], 1e-300)

    sums = _sums(task, base, 2, trees, depth, seed, look, mean_gain, done, draw, means, 1, edges)
    return _joined(task, sums, edges, F.col("v0") / F.col("n"))
