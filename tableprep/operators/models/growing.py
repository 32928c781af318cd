"""Decision trees grown level by level, many trees in the same pass.

A level is one job. Every task places its rows in all trees (from the tree structures alone, so a task that is run again
gives the same), adds up statistics by open node, column and bucket, and sends one row per node and column. These rows meet
by node and column, the best cut of each is found there, and the driver reads one short row per node and column. It holds
the trees, never rows of the table.

Balanced bootstraps are counted, not copied: the number of draws of a class is split over partitions, batches and rows at
random, so that every tree gets exactly as many draws. Equal rows are one with their number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame, functions as F

from tableprep.operators.models.common import TARGET, Task
from tableprep.session import cut_lineage

CELLS = 4_000_000  # numbers of one pass's statistics; more open nodes are worked on in several passes
STRETCH = 1_024    # rows of a class whose draws are placed together
BUCKETS = 64       # places where a bucketed column may be cut, plus 1

#: Rows of a partition as (bucket numbers by column and row, targets, logarithms of weights).
Chunk = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Forest:
    """Trees as lists by node: column (-1 in leaves), cut (rows with values up to it go left), left, right, depth, and the
    statistics of the node."""

    trees: int
    column: list[list[int]] = field(default_factory=list)
    cut: list[list[float]] = field(default_factory=list)
    left: list[list[int]] = field(default_factory=list)
    right: list[list[int]] = field(default_factory=list)
    depth: list[list[int]] = field(default_factory=list)
    stats: list[list[np.ndarray | None]] = field(default_factory=list)

    def __post_init__(self):
        if not self.column:
            for name, first in (("column", -1), ("cut", 0.0), ("left", 0), ("right", 0), ("depth", 0), ("stats", None)):
                setattr(self, name, [[first] for _ in range(self.trees)])

    def split(self, t: int, node: int, column: int, cut: float, left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
        at = len(self.column[t])
        self.column[t][node], self.cut[t][node] = column, cut
        self.left[t][node], self.right[t][node] = at, at + 1
        if self.stats[t][node] is None:
            self.stats[t][node] = left + right
        for s in (left, right):
            for name, first in (("column", -1), ("cut", 0.0), ("left", 0), ("right", 0), ("depth", self.depth[t][node] + 1), ("stats", s)):
                getattr(self, name)[t].append(first)
        return at, at + 1

    def shape(self) -> list[tuple[np.ndarray, ...]]:
        """Per tree (column, cut, left, right) as arrays: what placing rows needs."""
        return [(np.array(c, np.int32), np.array(v), np.array(a, np.int32), np.array(b, np.int32))
                for c, v, a, b in zip(self.column, self.cut, self.left, self.right)]


def place(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    column, cut, left, right = tree
    node = np.zeros(len(x), np.int32)
    here = np.arange(len(x)) if column[0] >= 0 else np.zeros(0, int)
    while len(here):
        n = node[here]
        node[here] = np.where(x[here, column[n]] <= cut[n], left[n], right[n])
        here = here[column[node[here]] >= 0]
    return node


def _values(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def order_columns(tree: int, node: int, d: int, seed: int) -> np.ndarray:
    """The columns in the order in which a node looks at them."""
    return np.random.default_rng([seed, tree, node]).permutation(d)


# --- statistics and cuts -------------------------------------------------------------------------------------------

def gini_gain(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gain, valid) of cuts from class counts (…, classes): falling impurity, up to a constant of the node."""
    a, b = left.sum(axis=-1), right.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left ** 2).sum(axis=-1) / a + (right ** 2).sum(axis=-1) / b
    return gain, (a > 0) & (b > 0)


def spread_gain(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from (count, sum of gradients, …): how far apart the means lie."""
    a, b = left[..., 0], right[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[..., 1] / a - right[..., 1] / b) ** 2 * a * b / (a + b)
    return gain, (a > 0) & (b > 0)


@dataclass
class Growth:
    """What a kind of tree needs to grow. base: (x array, …); d: columns; size: statistics per bucket; buckets; measures:
    from a batch and the tree to [(offset, weights)] whose bincounts are the statistics, or None for no rows; gain: as above;
    look: columns a node looks at; done: whether a node with these statistics stays a leaf; start: makes per-task state."""

    base: DataFrame
    d: int
    size: int
    gain: Callable
    measures: Callable
    done: Callable[[np.ndarray], bool]
    look: int
    depth: int
    seed: int = 0
    buckets: int = BUCKETS
    start: Callable = lambda: None
    random_cuts: bool = False


def _sums(g: Growth, shape, frontier: list[tuple[int, int]], columns: np.ndarray, bounds: np.ndarray | None):
    """The function over Arrow batches that adds up (node, column) statistics. bounds: one cut per open node and place, where
    cuts are drawn at random; else x holds bucket numbers."""
    places, B, s = columns.shape[1], g.buckets, g.size
    tree_of = np.array([t for t, _ in frontier])
    first = {int(t): int(i) for t, i in zip(*np.unique(tree_of, return_index=True))}
    many = {int(t): int(n) for t, n in zip(*np.unique(tree_of, return_counts=True))}
    nodes = np.array([n for _, n in frontier])
    measures, start = g.measures, g.start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {t: np.zeros(many[t] * places * B * s) for t in first}
        state = start()
        for batch in _filled(batches):
            x = _values(batch.column(0), batch.num_rows)
            for t in first:
                what = measures(batch, t, state)
                if what is None:
                    continue
                at = np.full(len(shape[t][0]), -1)
                at[nodes[first[t]:first[t] + many[t]]] = np.arange(many[t])
                node = at[place(shape[t], x)]
                rows = np.flatnonzero(node >= 0)
                node = node[rows]
                for p in range(places):
                    column = columns[first[t] + node, p]
                    keep = column >= 0
                    r, n, c = rows[keep], node[keep], column[keep]
                    value = x[r, c]
                    bucket = value.astype(np.int64) if bounds is None else (value > bounds[first[t] + n, p]).astype(np.int64)
                    flat = ((n * places + p) * B + bucket) * s
                    for offset, weight in what:
                        spot = flat + (offset[r] if isinstance(offset, np.ndarray) else offset)
                        total[t] += np.bincount(spot, None if weight is None else weight[r], len(total[t]))
        part = TaskContext.get().partitionId()
        for t in first:
            cells = total[t].reshape(many[t] * places, B * s)
            used = np.flatnonzero(cells.any(axis=1))
            if len(used):
                offsets = pa.array(np.arange(len(used) + 1, dtype=np.int32) * (B * s))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((used // places + first[t]).astype(np.int32)), pa.array((used % places).astype(np.int32)),
                     pa.array(np.full(len(used), part, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(cells[used].ravel()))],
                    ["node", "place", "part", "cells"])

    return run


def _best(g: Growth):
    """The function that finds the best cut of every (node, place) whose rows it gets."""
    B, s, gain = g.buckets, g.size, g.gain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _values(b.column(3), b.num_rows))
                for b in _filled(batches)]
        if not held:
            return
        node, place_, part, cells = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((part, place_, node))  # sums in one order, whatever came first
        node, place_, cells = node[order], place_[order], cells[order]
        begin = np.flatnonzero((np.diff(node, prepend=-1) != 0) | (np.diff(place_, prepend=-1) != 0))
        sums = np.add.reduceat(cells, begin, axis=0).reshape(len(begin), B, s)
        left = sums.cumsum(axis=1)
        right = left[:, -1:, :] - left
        worth, valid = gain(left[:, :-1], right[:, :-1])
        worth = np.where(valid, worth, -np.inf)
        cut = worth.argmax(axis=1)
        row = np.arange(len(begin))
        pack = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * s), pa.array(a.ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[begin]), pa.array(place_[begin]), pa.array(worth[row, cut]), pa.array(cut.astype(np.int32)),
             pack(left[row, cut]), pack(right[row, cut])], ["node", "place", "gain", "cut", "lower", "upper"])

    return run


def _ranges(g: Growth, shape, frontier: list[tuple[int, int]]) -> np.ndarray:
    """(nodes, columns, 2): least and largest value of every column in every open node."""
    tree_of = np.array([t for t, _ in frontier])
    nodes = np.array([n for _, n in frontier])
    trees, d, measures, start = np.unique(tree_of), g.d, g.measures, g.start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, most = np.full((len(nodes), d), np.inf), np.full((len(nodes), d), -np.inf)
        state = start()
        for batch in _filled(batches):
            x = _values(batch.column(0), batch.num_rows)
            for t in trees:
                if measures(batch, t, state) is None:
                    continue
                mine = np.flatnonzero(tree_of == t)
                at = np.full(len(shape[t][0]), -1)
                at[nodes[mine]] = mine
                node = at[place(shape[t], x)]
                rows = np.flatnonzero(node >= 0)
                if not len(rows):
                    continue
                rows = rows[np.argsort(node[rows], kind="stable")]
                begin = np.flatnonzero(np.diff(node[rows], prepend=-1))
                found = node[rows][begin]
                least[found] = np.minimum(least[found], np.minimum.reduceat(x[rows], begin, axis=0))
                most[found] = np.maximum(most[found], np.maximum.reduceat(x[rows], begin, axis=0))
        n, c = np.nonzero(np.isfinite(least))
        yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(least[n, c]), pa.array(most[n, c])],
                                         ["node", "col", "least", "most"])

    out = np.zeros((len(frontier), d, 2))
    parts = g.base.mapInArrow(run, "node int, col int, least double, most double")
    found = parts.groupBy("node", "col").agg(F.min("least").alias("least"), F.max("most").alias("most")).toPandas()
    out[found["node"], found["col"], 0], out[found["node"], found["col"], 1] = found["least"], found["most"]
    return out


def _columns(g: Growth, shape, frontier, skip: dict) -> tuple[np.ndarray, np.ndarray | None]:
    """(columns each open node looks at, random cuts of them); -1 fills up."""
    columns = np.full((len(frontier), g.look), -1)
    if not g.random_cuts:
        for i, (t, n) in enumerate(frontier):
            order = order_columns(t, n, g.d, g.seed) if g.look < g.d else np.arange(g.d)
            some = order[skip.get((t, n), 0):][:g.look]
            columns[i, :len(some)] = some
        return columns, None
    bounds = np.zeros((len(frontier), g.look))
    ranges = _ranges(g, shape, frontier)
    for i, (t, n) in enumerate(frontier):
        rng = np.random.default_rng([g.seed, t, n])
        order = rng.permutation(g.d)
        some = order[ranges[i, order, 0] < ranges[i, order, 1]][:g.look]
        columns[i, :len(some)] = some
        low, high = ranges[i, some, 0], ranges[i, some, 1]
        drawn = low + rng.random(len(some)) * (high - low)
        bounds[i, :len(some)] = np.where(drawn < high, drawn, low)  # a sum may round up to the end
    return columns, bounds


def grow(g: Growth, trees: int) -> Forest:
    """Grows all trees side by side, one level a pass."""
    forest = Forest(trees)
    frontier = [(t, 0) for t in range(trees)] if g.d and g.depth > 0 else []
    skip: dict[tuple[int, int], int] = {}
    step = max(1, CELLS // (g.look * g.buckets * g.size))
    out = "node int, place int, gain double, cut int, lower array<double>, upper array<double>"
    while frontier:
        shape, next_ = forest.shape(), []
        for start in range(0, len(frontier), step):
            some = frontier[start:start + step]
            columns, bounds = _columns(g, shape, some, skip)
            sums = g.base.mapInArrow(_sums(g, shape, some, columns, bounds), "node int, place int, part int, cells array<double>")
            found = sums.repartition("node", "place").mapInArrow(_best(g), out).collect()
            best: dict[int, tuple] = {}
            for r in found:
                entry = (-r["gain"], r["place"], r)
                if math.isfinite(r["gain"]) and (r["node"] not in best or entry[:2] < best[r["node"]][:2]):
                    best[r["node"]] = entry
            for r in found:  # a root that cannot be cut still has statistics
                t, n = some[r["node"]]
                if forest.stats[t][n] is None:
                    forest.stats[t][n] = np.array(r["lower"]) + np.array(r["upper"])
            for i, (t, n) in enumerate(some):
                if i not in best:
                    if not g.random_cuts and skip.get((t, n), 0) + g.look < g.d:
                        skip[t, n] = skip.get((t, n), 0) + g.look  # other columns, next time
                        next_.append((t, n))
                    continue
                r = best[i][2]
                cut = float(r["cut"]) if bounds is None else float(bounds[i, r["place"]])
                lower, upper = np.array(r["lower"]), np.array(r["upper"])
                for child, stats in zip(forest.split(t, n, int(columns[i, r["place"]]), cut, lower, upper), (lower, upper)):
                    if forest.depth[t][child] < g.depth and not g.done(stats):
                        next_.append((t, child))
        frontier = sorted(next_)
    return forest


# --- inputs and votes ----------------------------------------------------------------------------------------------

def raw_base(task: Task) -> DataFrame:
    """(x, y) of the train rows."""
    return task.train.select(F.array(*[c.cast("double") for c in task.x]).alias("x"), F.col(TARGET).cast("int").alias("y"))


def quantile_edges(task: Task, buckets: int = BUCKETS) -> list[np.ndarray]:
    found = task.train.approxQuantile(task.names, [i / buckets for i in range(1, buckets)], 0.001)
    return [np.unique(np.array(e, dtype=float)) for e in found]


def bucketed(base: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """x as bucket numbers: a value up to an edge has that edge's number or less."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _filled(batches):
            x = _values(batch.column(0), batch.num_rows)
            cells = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(edges))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(cells.astype(np.int16).ravel())),
                                              *batch.columns[1:]], batch.schema.names)

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[1:])
    return base.mapInArrow(run, f"x array<short>, {rest}")


def merged(base: DataFrame) -> DataFrame:
    """(x, y, n): rows of the same buckets and class as one, with their number."""
    return base.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))


def unbucketed(forest: Forest, edges: list[np.ndarray]) -> Forest:
    """Cuts at bucket numbers become cuts at values."""
    for columns, cuts in zip(forest.column, forest.cut):
        for n, c in enumerate(columns):
            if c >= 0:
                cuts[n] = float(edges[c][int(cuts[n])]) if int(cuts[n]) < len(edges[c]) else math.inf
    return forest


def impure(stats: np.ndarray) -> bool:
    return (stats > 0).sum() > 1


def _matrix(columns: tuple[pd.Series, ...]) -> np.ndarray:
    return np.stack([c.to_numpy(dtype=float) for c in columns], axis=1)


def forest_vote(task: Task, forest: Forest) -> DataFrame:
    """Mean class shares of the leaves; the first class on ties."""
    k = len(task.classes)
    shape = forest.shape()
    shares = []
    for stats in forest.stats:
        s = np.array([np.zeros(k) if v is None else v for v in stats])
        shares.append(s / np.maximum(s.sum(axis=1, keepdims=True), 1e-300))

    @F.pandas_udf("int")
    def winner(*columns: pd.Series) -> pd.Series:
        x = _matrix(columns)
        total = sum(s[place(tree, x)] for tree, s in zip(shape, shares))
        return pd.Series(np.round(total, 9).argmax(axis=1).astype(np.int32))

    if not task.names:
        largest = max(range(k), key=lambda c: shares[0][0][c]) if forest.stats[0][0] is not None else 0
        return task.predicted(task.test, task.class_of(F.lit(largest)))
    return task.predicted(task.test, task.class_of(winner(*[c.cast("double") for c in task.x])))


# --- balanced bootstraps -------------------------------------------------------------------------------------------

def draw_counts(seed: int, tree: int, label: int, rows: int, draws: int, low: int, high: int) -> np.ndarray:
    """How often rows low..high-1 of a class of `rows` rows come up in `draws` draws with replacement. The whole class gets
    exactly `draws`; any part of it can be computed on its own."""
    out = np.zeros(high - low, np.int64)
    stack = [(0, -(-rows // STRETCH), draws)]
    while stack:
        a, b, n = stack.pop()  # stretches a..b-1 share n draws
        if n == 0 or b * STRETCH <= low or a * STRETCH >= high:
            continue
        rng = np.random.default_rng([seed, tree, label, a, b])
        if b - a == 1:
            size = min(STRETCH, rows - a * STRETCH)
            spots = a * STRETCH + rng.integers(0, size, n)
            spots = spots[(spots >= low) & (spots < high)] - low
            out += np.bincount(spots, minlength=len(out))
            continue
        middle = (a + b) // 2
        share = (middle - a) * STRETCH / (min(b * STRETCH, rows) - a * STRETCH)
        lower = int(rng.binomial(n, share))
        stack += [(a, middle, lower), (middle, b, n - lower)]
    return out


def class_parts(base: DataFrame, k: int) -> np.ndarray:
    """Rows of each class by partition of (x, y, n). The base is written, so partitions keep their rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in _filled(batches):
            total += np.bincount(batch.column(1).to_numpy(), batch.column(2).to_numpy(), minlength=k)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(total)], ["part", "y", "n"])

    found = base.mapInArrow(run, "part int, y int, n double").toPandas()
    counts = np.zeros((int(found["part"].max()) + 1 if len(found) else 1, k))
    counts[found["part"], found["y"]] = found["n"]
    return counts


def balanced_draws(base: DataFrame, k: int, seed: int) -> tuple[Callable, Callable, int]:
    """(start, measures, draws per class): each tree's own bootstrap with the size of the rarest class for every class. base:
    (x, y, n), n equal rows as one. Draws are split over partitions, then over batches, then over rows by their numbers."""
    counts = class_parts(base, k)
    sizes = counts.sum(axis=0)
    draws = int(sizes[sizes > 0].min()) if (sizes > 0).any() else 0

    def start():
        return {"batch": None, "number": 0, "left": {}}

    def measures(batch: pa.RecordBatch, tree: int, state):
        part = TaskContext.get().partitionId()
        if state["batch"] is not batch:
            y, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            state.update(batch=batch, number=state["number"] + 1, y=y, mine=[(c, r, n[r]) for c in range(k) if len(r := np.flatnonzero(y == c))])
        if tree not in state["left"]:
            state["left"][tree] = {c: [np.random.default_rng([seed, tree, c]).multinomial(draws, counts[:, c] / sizes[c])[part], counts[part, c]]
                                   for c in range(k) if sizes[c]}
        weight = np.zeros(len(state["y"]))
        for c, rows, n in state["mine"]:
            rng, left = np.random.default_rng([seed, tree, c, part, state["number"]]), state["left"][tree][c]
            total = n.sum()
            drawn = rng.binomial(left[0], total / left[1]) if total < left[1] else left[0]
            weight[rows] = rng.multinomial(drawn, n / total)
            left[0], left[1] = left[0] - drawn, left[1] - total
        return [(state["y"], weight)]

    return start, measures, draws


# --- boosting ------------------------------------------------------------------------------------------------------

@dataclass
class Boosted:
    """Trees of all rounds, one per class in each (one alone for two classes), with the value of every node."""

    start: np.ndarray
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        """Sums of the trees from round `first` on, one column per class (one alone for two classes)."""
        k = len(self.start)
        out = np.zeros((len(x), k))
        for i in range(first * k, len(self.trees)):
            out[:, i % k] += self.values[i][place(self.trees[i], x)]
        return out


def chances(scores: np.ndarray) -> np.ndarray:
    """Class probabilities from scores (for one column: of the second of two classes)."""
    if scores.shape[1] == 1:
        return 1 / (1 + np.exp(-scores))
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _with_scores(base: DataFrame, model: Boosted, first: int) -> DataFrame:
    """(x, y, f, n): f grown by the rounds from `first` on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _filled(batches):
            x = _values(batch.column(0), batch.num_rows)
            f = _values(batch.column(2), batch.num_rows) + model.scores(x, first)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * f.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(f.ravel())), batch.column(3)],
                                             ["x", "y", "f", "n"])

    return cut_lineage(base.mapInArrow(run, "x array<short>, y int, f array<double>, n double"))


def boost_softmax(base: DataFrame, sizes: np.ndarray, d: int, rounds: int, depth: int, rate: float, seed: int, keep: int = 20) -> Boosted:
    """Gradient boosting of the softmax loss (logistic for two classes). base: (x as buckets, y).

    A round grows the trees of all classes in the same passes, one job a level. Nodes are cut where the gradients lie
    furthest apart and take a Newton step. Equal rows are one with their number. Rows carry their scores; every `keep` rounds these are written anew, in between
    tasks add the few latest trees.
    """
    k = len(sizes) if len(sizes) > 2 else 1
    share = np.maximum(sizes, 1e-9) / sizes.sum()
    start = np.log(share) if k > 1 else np.log(share[1:] / share[:1])
    model = Boosted(start)
    factor = rate * ((k - 1) / k if k > 1 else 1.0)
    rows = cut_lineage(merged(base).select("x", "y", F.array(*[F.lit(float(s)) for s in start]).alias("f"), "n"))
    kept = 0
    for i in range(rounds):
        if i - kept >= keep:
            rows, kept = _with_scores(rows, model, kept), i
        first = kept

        def measures(batch: pa.RecordBatch, tree: int, state):
            if state.get("batch") is not batch:
                x = _values(batch.column(0), batch.num_rows)
                p = chances(_values(batch.column(2), batch.num_rows) + model.scores(x, first))
                y = batch.column(1).to_numpy()
                hit = (y[:, None] == np.arange(k)) if k > 1 else (y[:, None] == 1)
                n = batch.column(3).to_numpy()
                state.update(batch=batch, n=n, g=(hit - p) * n[:, None], h=p * (1 - p) * n[:, None])
            return [(0, state["n"]), (1, state["g"][:, tree]), (2, state["h"][:, tree])]

        def done(stats: np.ndarray) -> bool:
            return stats[0] < 2

        g = Growth(rows, d, 3, spread_gain, measures, done, d, depth, seed, start=dict)
        forest = grow(g, k)
        if all(len(c) == 1 for c in forest.column):
            break
        for t in range(k):
            stats = np.array([np.zeros(3) if s is None else s for s in forest.stats[t]])
            step = np.where(stats[:, 2] > 1e-150, stats[:, 1] / np.maximum(stats[:, 2], 1e-150), 0.0)
            model.trees.append(forest.shape()[t])
            model.values.append(factor * step)
    return model


def walked(tree: tuple[np.ndarray, ...], value: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The value of each row's leaf; x: (columns, rows). For small trees, whose conditions are cheaper than moving rows about."""
    column, cut, left, right = tree

    def walk(node: int) -> np.ndarray:
        if column[node] < 0:
            return value[node]
        return np.where(x[column[node]] <= cut[node], walk(left[node]), walk(right[node]))

    return np.broadcast_to(walk(0), x.shape[1:])


@dataclass
class Voters:
    """Regression trees with the value of every node and the weight of each in a median. losses: (beta, largest error) of each,
    from which the weights of rows follow."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    losses: list[tuple[float, float]] = field(default_factory=list)

    def carried(self, chunk: Chunk, first: int) -> np.ndarray:
        """Logarithms of the rows' weights after the rounds from `first` on."""
        x, y, log = chunk
        for tree, value, (beta, worst) in list(zip(self.trees, self.values, self.losses))[first:]:
            log = log + math.log(beta) * (1 - np.abs(walked(tree, value, x) - y) / worst)
        return log

    def median(self, x: np.ndarray) -> np.ndarray:
        """The least prediction that, with all smaller ones, has half of the weight."""
        found = np.stack([walked(tree, value, x) for tree, value in zip(self.trees, self.values)], axis=1)
        order = found.argsort(axis=1, kind="stable")
        weight = np.array(self.weights)
        upto = weight[order].cumsum(axis=1) >= weight.sum() / 2 - 1e-12
        return np.take_along_axis(found, np.take_along_axis(order, upto.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]


def chunks(rows: DataFrame, edges: list[np.ndarray]) -> RDD:
    """Chunks of rows (x0, x1, ..., y), with columns as bucket numbers and weights of 1."""
    d, kind = len(edges), np.uint8 if max(map(len, edges)) < 256 else np.int16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _filled(batches):
            x = np.stack([np.searchsorted(e, batch.column(j).to_numpy(), "left") for j, e in enumerate(edges)]).astype(kind)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]), pa.array([batch.column(d).to_numpy().tobytes()])], ["x", "y"])

    def unpacked(row) -> Chunk:
        y = np.frombuffer(bytes(row[1]))
        return np.frombuffer(bytes(row[0]), kind).reshape(d, -1), y, np.zeros(len(y))

    return rows.mapInArrow(run, "x binary, y binary").rdd.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)


def _level(model: Voters, first: int, tree: tuple[np.ndarray, ...], open_: list[int], buckets: int):
    """The function over a partition's chunks that adds up (weight, weighted target) by column, open node and bucket."""
    spot = np.full(len(tree[0]), -1)
    spot[open_] = np.arange(len(open_))

    def run(part: Iterator[Chunk]) -> Iterator[np.ndarray]:
        total: np.ndarray | int = 0
        for chunk in part:
            x, y, _ = chunk
            weight, node = np.exp(model.carried(chunk, first)), walked(tree, spot, x)
            if node.min() < 0:
                rows = np.flatnonzero(node >= 0)
                x, y, weight, node = x[:, rows], y[rows], weight[rows], node[rows]
            flat = [node * buckets + column for column in x]
            total = total + np.array([[np.bincount(at, w, len(open_) * buckets) for at in flat] for w in (weight, weight * y)])
        if not isinstance(total, int):
            yield total.reshape(2, -1, len(open_), buckets)

    return run


def _errors(model: Voters, first: int, tree: tuple[np.ndarray, ...], value: np.ndarray):
    """The function over a partition's chunks that gives (largest error, weighted sum of errors, sum of weights) of a tree."""
    def run(part: Iterator[Chunk]) -> Iterator[tuple[float, float, float]]:
        for chunk in part:
            weight, error = np.exp(model.carried(chunk, first)), np.abs(walked(tree, value, chunk[0]) - chunk[1])
            yield float(error.max()), float(weight @ error), float(weight.sum())

    return run


def _median_tree(rows: RDD, model: Voters, first: int, depth: int, buckets: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """A weighted regression tree and the means of its nodes; one job a level."""
    forest, open_ = Forest(1), [0]
    for _ in range(depth):
        sums = rows.mapPartitions(_level(model, first, forest.shape()[0], open_, buckets)).treeReduce(np.add)
        left = np.moveaxis(sums, 0, -1).cumsum(axis=2)  # (column, node, bucket, statistic)
        right = left[:, :, -1:] - left
        gain, valid = spread_gain(left[:, :, :-1], right[:, :, :-1])
        gain = np.where(valid, gain, -np.inf)
        next_ = []
        for i, node in enumerate(open_):
            forest.stats[0][node] = left[0, i, -1]
            if gain[:, i].size and gain[:, i].max() > 0:
                j, c = np.unravel_index(gain[:, i].argmax(), gain[:, i].shape)
                next_ += forest.split(0, node, int(j), float(c), left[j, i, c], right[j, i, c])
        open_ = next_
        if not open_:
            break
    return forest.shape()[0], np.array([s[1] / s[0] for s in forest.stats[0]])


def boost_median(rows: RDD, spread: float, buckets: int, rounds: int, depth: int, keep: int = 5) -> Voters:
    """AdaBoost.R2 with linear loss on chunks of rows, targets at most `spread` away from zero.

    A round is one job a level of its tree, and one for the errors. Rows carry their weights; every `keep` rounds these are
    made anew, in between tasks carry them on by the few latest trees.
    """
    model, first = Voters(), 0
    try:
        for i in range(rounds):
            if i - first >= keep:
                before, at = rows, first
                rows = before.map(lambda chunk: (*chunk[:2], model.carried(chunk, at))).persist(StorageLevel.MEMORY_AND_DISK)
                rows.count()  # the closure is sent with the trees so far
                before.unpersist()
                first = i
            tree, value = _median_tree(rows, model, first, depth, buckets)
            worst, lost, total = rows.mapPartitions(_errors(model, first, tree, value)).treeReduce(
                lambda a, b: (max(a[0], b[0]), a[1] + b[1], a[2] + b[2]))
            loss = 0.0 if worst <= 1e-12 * spread else lost / worst / total
            if loss >= 0.5 and model.trees:
                break
            model.trees.append(tree)
            model.values.append(value)
            if loss <= 0 or loss >= 0.5:
                model.weights.append(1.0)
                break
            beta = loss / (1 - loss)
            model.weights.append(math.log(1 / beta))
            model.losses.append((beta, worst))
    finally:
        rows.unpersist()
    return model


def boosted_class(task: Task, model: Boosted) -> DataFrame:
    """The class of the largest score; the first one on ties. The model's cuts are values."""
    @F.pandas_udf("int")
    def winner(*columns: pd.Series) -> pd.Series:
        x = _matrix(columns) if columns else np.zeros((0, 0))
        f = model.start + model.scores(x)
        best = (f[:, 0] > 0) if f.shape[1] == 1 else f.argmax(axis=1)
        return pd.Series(best.astype(np.int32))

    return task.predicted(task.test, task.class_of(winner(*[c.cast("double") for c in task.x])))


def valued(model: Boosted | Voters, edges: list[np.ndarray]) -> Boosted | Voters:
    """Cuts at bucket numbers become cuts at values."""
    trees = []
    for column, cut, left, right in model.trees:
        value = [float(edges[c][int(b)]) if c >= 0 and int(b) < len(edges[c]) else math.inf for c, b in zip(column, cut)]
        trees.append((column, np.array(value), left, right))
    return replace(model, trees=trees)
