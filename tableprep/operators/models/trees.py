"""Trees, forests and boosting."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import DataFrame, functions as F

from tableprep.functions.columns import Roles
from tableprep.operators.models import bagged, growing
from tableprep.operators.models.common import FEATURES, TARGET, Task, classification, regression
from tableprep.session import cut_lineage

DEEP = 30     # the deepest tree Spark grows; stands for an unlimited one
BUCKETS = 64  # places where a stump may cut a column, plus 1


def _seeded(classifier):
    return classifier.setFeaturesCol(FEATURES).setLabelCol(TARGET)


def _direct(task: Task, classifier) -> DataFrame:
    model = _seeded(classifier).fit(task.vectors(task.train).select(FEATURES, TARGET))
    scored = model.transform(task.vectors(task.test).drop(TARGET))
    return task.predicted(scored, task.class_of(F.col("prediction")))


def random_forest(df: DataFrame, roles: Roles = Roles(), trees: int = 100, depth: int = DEEP, seed: int = 0):
    """Trees on bootstrap samples that try the square root of the columns, rounded up, at each node."""
    task = classification(df, roles)
    return bagged.classify(task, trees, depth, seed, math.ceil(math.sqrt(len(task.names))))


def bagging(df: DataFrame, roles: Roles = Roles(), trees: int = 10, depth: int = DEEP, seed: int = 0) -> DataFrame:
    """Trees on bootstrap samples over all columns; their class shares are averaged."""
    task = classification(df, roles)
    return bagged.classify(task, trees, depth, seed, len(task.names))


def decision_tree(df: DataFrame, roles: Roles = Roles(), depth: int = DEEP, seed: int = 0) -> DataFrame:
    return _direct(classification(df, roles), DecisionTreeClassifier(maxDepth=depth, seed=seed))


def gradient_boosting(df: DataFrame, roles: Roles = Roles(), rounds: int = 100, depth: int = 3, rate: float = 0.1,
                      seed: int = 0) -> DataFrame:
    """Boosting of the softmax loss: every round grows one tree a class (one alone for two classes) in shared passes.

    Columns are cut at quantiles. Without numeric columns, or with one class, the most frequent class is predicted.
    """
    task = classification(df, roles)
    sizes = _class_sizes(task.train)
    counts = np.array([sizes[float(c)] for c in range(len(task.classes))], float)
    if not task.names or len(counts) == 1:
        return task.predicted(task.test, task.class_of(F.lit(int(counts.argmax()))))
    edges = growing.quantile_edges(task)
    base = growing.bucketed(growing.raw_base(task), edges)
    model = growing.boost_softmax(base, counts, len(task.names), rounds, depth, rate, seed)
    return growing.boosted_class(task, growing.valued(model, edges))


def bagging_regressor(df: DataFrame, roles: Roles = Roles(), trees: int = 10, depth: int = DEEP, seed: int = 0):
    """Regression trees on bootstrap samples over all columns; their predictions are averaged."""
    task = regression(df, roles)
    return bagged.regress(task, trees, depth, seed, len(task.names))


def _class_sizes(rows: DataFrame) -> dict[float, int]:
    return {r[TARGET]: r["count"] for r in rows.groupBy(TARGET).count().collect()}


@dataclass
class Stump:
    """Predicts `left` where the column is at most `cut`, else `right`; counts `weight` in a vote."""

    column: int
    place: int
    cut: float
    left: int
    right: int
    weight: float


def _predictions(stumps: list[Stump], below) -> np.ndarray:
    """Predicted class of every row by every stump; `below(stump)` tells which rows go left."""
    return np.array([np.where(below(s), s.left, s.right) for s in stumps])


def _best_stump(sample: np.ndarray, whole: np.ndarray, edges: list[np.ndarray]) -> tuple[Stump, float] | None:
    """The stump of least Gini impurity on (column, bucket, class) weights, and its error on the whole weights."""
    best, found = math.inf, None
    for j, cuts in enumerate(edges):
        left = sample[j].cumsum(axis=0)[:len(cuts)]
        sides = left, sample[j].sum(axis=0) - left
        mass = [side.sum(axis=1) for side in sides]
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = sum(np.where(m > 0, m - (side ** 2).sum(axis=1) / m, 0.0) for m, side in zip(mass, sides))
        impurity = np.where((mass[0] > 0) & (mass[1] > 0), impurity, math.inf)
        c = int(impurity.argmin()) if len(cuts) else 0
        if len(cuts) and impurity[c] < best:
            best = impurity[c]
            found = Stump(j, c, float(cuts[c]), int(sides[0][c].argmax()), int(sides[1][c].argmax()), 1.0)
    if found is None:
        return None
    kept = whole[found.column]
    right = kept[:found.place + 1, found.left].sum() + kept[found.place + 1:, found.right].sum()
    return found, float(1 - right / kept.sum())


def boost(task: Task, rounds: int, seed: int, subsets: int = 1, balanced: bool = False, fresh: bool = False) -> list[list[Stump]]:
    """SAMME boosting of stumps, for several ensembles side by side.

    Columns are cut at quantiles once and rows keep bucket numbers alone; rows of the same buckets and class are one from
    then on, with their number in the table and in every sample. A round is one job: every task adds up the weights by
    column, bucket and class for all ensembles (the weight of a row follows from the stumps so far), and the driver reads
    these sums. `balanced` gives each ensemble its own class-balanced sample, `fresh` a new one each round; a hash of the row
    decides, so a partition that is computed again gives the same rows.
    """
    k, d = len(task.classes), len(task.names)
    train = task.train
    found = train.approxQuantile(task.names, [i / BUCKETS for i in range(1, BUCKETS)], 0.001) if d else []
    edges = [np.unique(np.array(e, dtype=float)) for e in found]
    sizes = _class_sizes(train) if balanced or fresh else {}
    share = np.array([min(sizes.values()) / sizes[float(c)] if sizes.get(float(c)) else 1.0 for c in range(k)]) if sizes else np.ones(k)

    salts = [((e if balanced else 0) * 1_000 + (turn if fresh else 0) + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
             for e in range(subsets if balanced else 1) for turn in range(rounds if fresh else 1)] if balanced or fresh else []
    cell = [*[f"b{j}" for j in range(d)], "y"]

    def buckets(batches):
        for pdf in batches:
            y, h = pdf["y"].to_numpy().astype(np.int32), pdf["h"].to_numpy().view(np.uint64)
            made = {f"b{j}": np.searchsorted(e, pdf[f"x{j}"].to_numpy(), "left").astype(np.int16) for j, e in enumerate(edges)}
            made |= {"y": y, "n": np.ones(len(y), np.int64)}
            for i, salt in enumerate(salts):
                mixed = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
                made[f"s{i}"] = ((mixed >> np.uint64(11)) / float(1 << 53) < share[y]).astype(np.int64)
            yield pd.DataFrame(made).groupby(cell, as_index=False, sort=False).sum()

    counts = ["n", *[f"s{i}" for i in range(len(salts))]]
    rows = train.select(*[x.alias(f"x{j}") for j, x in enumerate(task.x)], F.col(TARGET).alias("y"), F.xxhash64(*task.x, F.lit(seed)).alias("h"))
    base = rows.mapInPandas(buckets, ", ".join([*[f"b{j} short" for j in range(d)], "y int", *[f"{c} long" for c in counts]])).groupBy(
        *cell).agg(*[F.sum(c).alias(c) for c in counts]).persist()
    ensembles: list[list[Stump]] = [[] for _ in range(subsets)]
    going = set(range(subsets if d else 0))
    try:
        for i in range(rounds):
            if not going:
                break
            part = base.mapInPandas(_weigher(ensembles, sorted(going), i, k, d, rounds, balanced, fresh), "e int, w int, c int, v double")
            sums = np.zeros((subsets, 2, d, BUCKETS, k))
            for e, w, c, v in part.groupBy("e", "w", "c").agg(F.sum("v")).collect():
                sums[e, w].reshape(-1)[c] = v
            for e in sorted(going):
                best = _best_stump(sums[e, 1], sums[e, 0], edges)
                stump, error = best if best else (None, 1.0)
                if stump is None or (error > 0 and (1 - error) * (k - 1) <= error):
                    if stump is not None and not ensembles[e]:
                        ensembles[e].append(stump)
                    going.discard(e)
                    continue
                if error > 0:
                    stump.weight = math.log((1 - error) / error) + math.log(k - 1)
                else:
                    going.discard(e)
                ensembles[e].append(stump)
    finally:
        base.unpersist()
    return ensembles


def _weigher(ensembles, going, turn, k, d, rounds, balanced, fresh):
    def run(batches):
        sums = np.zeros((len(going), 2, d, BUCKETS, k))
        for pdf in batches:
            y, n = pdf["y"].to_numpy(), pdf["n"].to_numpy()
            cells = [pdf[f"b{j}"].to_numpy().astype(np.int64) for j in range(d)]
            for at, e in enumerate(going):
                weight = np.ones(len(y))
                if ensembles[e]:
                    wrong = _predictions(ensembles[e], lambda s: cells[s.column] <= s.place) != y
                    weight = np.exp(np.array([s.weight for s in ensembles[e]]) @ wrong)
                sample = (e if balanced else 0) * (rounds if fresh else 1) + (turn if fresh else 0)
                drawn = pdf[f"s{sample}"].to_numpy() if balanced or fresh else n
                whole = drawn if balanced else n  # its own sample is all that an ensemble sees
                for w, times in enumerate((whole, drawn)):
                    for j in range(d):
                        sums[at, w, j] += np.bincount(cells[j] * k + y, weights=weight * times, minlength=BUCKETS * k).reshape(BUCKETS, k)
        flat = sums.reshape(len(going), 2, -1)
        e, w, c = np.nonzero(flat)
        yield pd.DataFrame({"e": np.array(going)[e], "w": w, "c": c, "v": flat[e, w, c]})
    return run


def _vote(task: Task, ensembles: list[list[Stump]]) -> DataFrame:
    """Weighted vote of the stumps of each ensemble, then one vote each; ties go to the first class."""
    k = len(task.classes)

    @F.pandas_udf("int")
    def winner(*columns: pd.Series) -> pd.Series:
        x = [c.to_numpy() for c in columns]
        rows = np.arange(len(x[0]))
        total = np.zeros((len(rows), k))
        for stumps in ensembles:
            votes = np.zeros((len(rows), k))
            for s in stumps:
                votes[rows, np.where(x[s.column] <= s.cut, s.left, s.right)] += s.weight
            total[rows, votes.argmax(axis=1)] += 1
            if len(ensembles) == 1:
                total = votes
        return pd.Series(total.argmax(axis=1).astype(np.int32))

    return task.predicted(task.test, task.class_of(winner(*task.x) if task.names else F.lit(0)))


def ada_boost(df: DataFrame, roles: Roles = Roles(), rounds: int = 50, seed: int = 0) -> DataFrame:
    task = classification(df, roles)
    return _vote(task, boost(task, rounds, seed))


def rus_boost(df: DataFrame, roles: Roles = Roles(), rounds: int = 50, seed: int = 0) -> DataFrame:
    """Boosting with a fresh class-balanced sample in every round."""
    task = classification(df, roles)
    return _vote(task, boost(task, rounds, seed, fresh=True))


def easy_ensemble(df: DataFrame, roles: Roles = Roles(), subsets: int = 10, rounds: int = 50, seed: int = 0):
    """Boosting on several class-balanced samples, each with one vote."""
    task = classification(df, roles)
    return _vote(task, boost(task, rounds, seed, subsets, balanced=True))


def _look(task: Task, look: int | None) -> int:
    """Columns that a node looks at: the square root of all, if no number is asked for."""
    d = max(1, len(task.names))
    return max(1, int(math.sqrt(d))) if look is None else min(look, d)


def balanced_trees(task: Task, trees: int, depth: int, seed: int, look: int | None) -> growing.Forest:
    """The trees of `balanced_forest`, with cuts at values; the statistics of their nodes are class counts."""
    edges = growing.quantile_edges(task) if task.names else []
    base = growing.bucketed(growing.raw_base(task), edges) if edges else growing.raw_base(task)
    base = cut_lineage(growing.merged(base))
    start, measures, _ = growing.balanced_draws(base, len(task.classes), seed)
    grown = growing.grow(growing.Growth(base, len(task.names), len(task.classes), growing.gini_gain, measures,
                                        lambda s: not growing.impure(s), _look(task, look), depth, seed, start=start), trees)
    return growing.unbucketed(grown, edges)


def balanced_forest(df: DataFrame, roles: Roles = Roles(), trees: int = 100, depth: int = DEEP, seed: int = 0,
                    look: int | None = None) -> DataFrame:
    """A forest in which every tree has a bootstrap sample of its own that draws, from every class, as many rows as the
    rarest class has. Draws are counted by row number, the table is not copied. `look` columns are tried at each node."""
    task = classification(df, roles)
    return growing.forest_vote(task, balanced_trees(task, trees, depth, seed, look))


def extra_trees(df: DataFrame, roles: Roles = Roles(), trees: int = 100, depth: int = DEEP, seed: int = 0,
                look: int | None = None) -> DataFrame:
    """Trees on all rows whose nodes draw one random cut for each column they look at, between the column's least and largest
    value in the node, and keep the best. A level is two passes for all trees: ranges, then class counts."""
    task = classification(df, roles)
    base = cut_lineage(growing.raw_base(task))
    grown = growing.grow(growing.Growth(base, len(task.names), len(task.classes), growing.gini_gain,
                                        lambda batch, tree, state: [(batch.column(1).to_numpy(), None)],
                                        lambda s: not growing.impure(s), _look(task, look), depth, seed, buckets=2, random_cuts=True), trees)
    return growing.forest_vote(task, grown)


def ada_boost_regressor(df: DataFrame, roles: Roles = Roles(), rounds: int = 50, depth: int = 3, seed: int = 0):
    """AdaBoost.R2 with linear loss: weighted trees, combined by their weighted median. Columns are cut at quantiles, or at all
    values where there are few."""
    task = regression(df, roles)
    y = F.col(TARGET)
    middle, least, most = task.train.agg(F.avg(y), F.min(y), F.max(y)).first()
    if middle is None:
        raise ValueError("no labelled train row")
    cut = bool(task.names) and depth > 0  # without a place to cut, a column that is the same everywhere leaves the root alone
    edges = bagged.edges_of(task) if cut else [np.zeros(0)]
    columns = [c.cast("double") for c in task.x] if cut else [F.lit(0.0)]
    rows = growing.chunks(task.train.select(*[c.alias(f"x{j}") for j, c in enumerate(columns)], (y - F.lit(middle)).alias("y")), edges)
    model = growing.boost_median(rows, max(most - middle, middle - least), max(map(len, edges)) + 1, rounds, depth if cut else 1)
    model = growing.valued(model, edges)

    @F.pandas_udf("double")
    def median(*x: pd.Series) -> pd.Series:
        return pd.Series(middle + model.median(np.stack([c.to_numpy(dtype=float) for c in x])))

    return task.predicted(task.test, median(*columns))
