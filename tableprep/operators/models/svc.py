"""Support vectors with an RBF kernel, solved to the optimality conditions over all rows.

A cascade finds a good start: blocks of rows are solved side by side, only their support vectors go on, and these are
dealt into blocks again until one block is left. Then every row keeps its weight and its output. A round takes the rows that
break the optimality conditions most, solves their weights on the driver with all others fixed, and adds the change to the
outputs of all rows in the tasks. It ends when no pair of rows breaks the conditions by more than the tolerance, so the
result is that of the whole dual problem, however many support vectors it has. Rows of equal numbers and sign are one with
their number: their weights add up, to at most that many times the bound of one. The driver holds one working set and, for
predicting, the support vectors; a kernel matrix of all rows is never made.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tableprep.functions.columns import Roles
from tableprep.operators.models.common import TARGET, Task, class_sums, classification
from tableprep.session import cut_lineage

BLOCK = 1_000    # rows of a block of the cascade
WORKING = 1_000  # rows of a working set
CHUNK = 5_000    # support vectors that one function of the prediction holds
KEPT = 0.9       # a layer of the cascade that keeps a larger share is the last one
TINY = 1e-12


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(square, 0.0))


def solve(k: np.ndarray, sign: np.ndarray, weight: np.ndarray, output: np.ndarray, c: float | np.ndarray, tol: float,
          steps: int = 200_000) -> np.ndarray:
    """Weights of rows with kernel matrix `k` that are optimal while all other rows keep theirs; pairs are moved one after the
    other, the pair of largest gain first. output: what the decision function without its constant gives for the rows now; c: the
    bound of the weights, one for all or one a row."""
    weight, pull = weight.copy(), sign - output
    c = np.broadcast_to(c, weight.shape)
    diagonal = np.diag(k)
    for _ in range(steps):
        up = np.where(sign > 0, weight < c, weight > 0)
        down = np.where(sign > 0, weight > 0, weight < c)
        if not up.any() or not down.any():
            break
        i = int(np.where(up, pull, -np.inf).argmax())
        gap = np.where(down, pull[i] - pull, -np.inf)
        if gap.max() <= tol:
            break
        bend = np.maximum(diagonal[i] + diagonal - 2 * k[i], TINY)
        j = int(np.where(gap > 0, gap * gap / bend, -np.inf).argmax())
        room = min(c[i] - weight[i] if sign[i] > 0 else weight[i], weight[j] if sign[j] > 0 else c[j] - weight[j])
        step = min(gap[j] / bend[j], room)
        for n, move in ((i, sign[i] * step), (j, -sign[j] * step)):
            weight[n] += move
            weight[n] = 0.0 if weight[n] < TINY * c[n] else c[n] if weight[n] > c[n] - TINY * c[n] else weight[n]
        pull -= step * (k[i] - k[j])
    return weight


def _layer(gamma: float, c: float, tol: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sign = pdf["sign"].to_numpy()
        if len(set(sign)) < 2:  # nothing to tell apart here: another block may need these rows
            return pdf.assign(weight=0.0)[["id", "x", "sign", "n", "weight"]]
        x = np.stack(pdf["x"].to_numpy())
        weight = solve(kernel(x, x, gamma), sign, np.zeros(len(x)), np.zeros(len(x)), c * pdf["n"].to_numpy(), tol)
        return pdf.assign(weight=weight)[weight > 0][["id", "x", "sign", "n", "weight"]]
    return run


def _numbered(rows: DataFrame) -> DataFrame:
    """(id, x, sign, n); rows without a number n stand for themselves alone."""
    return rows.select("id", "x", "sign", F.col("n") if "n" in rows.columns else F.lit(1).cast("long").alias("n"))


def cascade(rows: DataFrame, gamma: float, c: float, tol: float, block: int = BLOCK) -> DataFrame | None:
    """(id, x, sign, n, weight) of the support vectors of the last layer, at most one block of them; None if the layers do not
    get there because nearly all rows are support vectors."""
    rows = _numbered(rows)
    size, layer = rows.count(), 0
    while True:
        blocks = -(-size // block)
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(layer)), F.lit(max(blocks, 1))))
        found = cut_lineage(dealt.groupBy("block").applyInPandas(_layer(gamma, c, tol), "id long, x array<double>, sign double, n long, weight double"))
        left = found.count()
        if blocks <= 1:
            return found.where("weight > 0")
        if left > KEPT * size:
            return None
        rows, size, layer = found.drop("weight"), left, layer + 1


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _moved(state: DataFrame, ids: np.ndarray, x: np.ndarray, weight: np.ndarray, change: np.ndarray, gamma: float) -> DataFrame:
    """The state after the rows `ids` took new weights; change: of weight times sign."""
    order = np.argsort(ids)
    ids, weight, moved = ids[order], weight[order], change != 0
    x, change = x[moved], change[moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(1), batch.num_rows)
            f = batch.column(5).to_numpy() + kernel(rows, x, gamma) @ change
            mine, own = batch.column(0).to_numpy(), batch.column(4).to_numpy().copy()
            spot = np.minimum(np.searchsorted(ids, mine), len(ids) - 1)
            hit = ids[spot] == mine
            own[hit] = weight[spot[hit]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(own), pa.array(f)], ["id", "x", "sign", "n", "weight", "f"])

    return cut_lineage(state.mapInArrow(run, "id long, x array<double>, sign double, n long, weight double, f double"))


def _sides(c: float) -> tuple[Column, Column]:
    """Whether a row's weight times its sign may rise, and may fall."""
    more, less = F.col("weight") < F.col("n") * c, F.col("weight") > 0
    return F.when(F.col("sign") > 0, more).otherwise(less), F.when(F.col("sign") > 0, less).otherwise(more)


def fit(rows: DataFrame, gamma: float, c: float = 1.0, tol: float = 1e-3, rounds: int = 10_000, working: int = WORKING,
        block: int = BLOCK) -> tuple[DataFrame, float, float]:
    """(support vectors as (id, x, coef), constant, gap) of (id, x, sign[, n]) with unique ids and signs of 1 and -1, both present;
    n is how many equal rows a row stands for. `rows` is read several times."""
    start = cascade(rows, gamma, c, tol, block)
    state = _numbered(rows).withColumns({"weight": F.lit(0.0), "f": F.lit(0.0)})
    first = [] if start is None else start.collect()
    if first:
        ids, x, sign, weight = (np.array([r[n] for r in first]) for n in ("id", "x", "sign", "weight"))
        state = _moved(state, ids, x, weight, weight * sign, gamma)
    else:
        state = cut_lineage(state)
    up, down = _sides(c)
    pull = F.col("sign") - F.col("f")
    gap = 0.0
    for _ in range(rounds):
        high = state.where(up).orderBy(F.desc(pull), "id").limit(working // 2)
        low = state.where(down).orderBy(pull, "id").limit(working // 2)
        some = {r["id"]: r for r in high.unionByName(low).collect()}
        ids, x, sign, count, weight, f = (np.array([r[n] for r in some.values()]) for n in ("id", "x", "sign", "n", "weight", "f"))
        force, most = sign - f, c * count
        rises, falls = np.where(sign > 0, weight < most, weight > 0), np.where(sign > 0, weight > 0, weight < most)
        gap = float(force[rises].max() - force[falls].min()) if rises.any() and falls.any() else 0.0
        if gap <= tol:
            break
        new = solve(kernel(x, x, gamma), sign, weight, f, most, tol / 2)
        state = _moved(state, ids, x, new, (new - weight) * sign, gamma)
    free = (F.col("weight") > 0) & (F.col("weight") < F.col("n") * c)
    mean, top, bottom = state.agg(F.sum(F.when(free, pull * F.col("n"))) / F.sum(F.when(free, F.col("n"))), F.max(F.when(up, pull)), F.min(F.when(down, pull))).first()
    constant = mean if mean is not None else (top + bottom) / 2
    return state.where("weight > 0").select("id", "x", (F.col("weight") * F.col("sign")).alias("coef")), float(constant), gap


def _part(points: np.ndarray, coef: np.ndarray, gamma: float):
    """The function that gives what some support vectors add to decision values."""
    @F.pandas_udf("double")
    def values(column: pd.Series) -> pd.Series:
        out = [kernel(np.stack(column.iloc[i:i + CHUNK].to_numpy()), points, gamma) @ coef for i in range(0, len(column), CHUNK)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return values


def decision(vectors: DataFrame, constant: float, gamma: float, x: Column) -> Column:
    """Decision values of rows whose numbers are the array `x`."""
    total = F.lit(constant)
    rows = vectors.select("x", "coef").toLocalIterator()
    while some := list(itertools.islice(rows, CHUNK)):
        total = total + _part(np.array([r["x"] for r in some]), np.array([r["coef"] for r in some]), gamma)(x)
    return total


def kernel_svc(df: DataFrame, roles: Roles = Roles(), c: float = 1.0, tol: float = 1e-3, working: int = WORKING, block: int = BLOCK) -> DataFrame:
    """RBF support vectors for every pair of classes; the class with most votes wins, the first one on ties.

    gamma is 1 / (columns * variance of all numbers). Without numeric columns, or with one class, the first class is predicted.
    """
    task: Task = classification(df, roles)
    k = len(task.classes)
    if not task.names or k == 1:
        return task.predicted(task.test, task.class_of(F.lit(0)))
    sums = class_sums(task)
    center, variance = sums.center, sums.pooled_var
    spread = float(variance.mean() + center.var())
    gamma = 1.0 / (len(task.names) * (spread or 1.0))
    x = F.array(*[v.cast("double") for v in task.x])
    equal = task.train.groupBy(x.alias("x"), F.col(TARGET).cast("int").alias("y")).agg(F.count("*").alias("n"))
    base = cut_lineage(equal.select(F.monotonically_increasing_id().alias("id"), "x", "y", "n"))
    votes = [F.lit(0)] * k
    for a, b in itertools.combinations(range(k), 2):
        pair = base.where(F.col("y").isin(a, b)).select("id", "x", F.when(F.col("y") == a, 1.0).otherwise(-1.0).alias("sign"), "n")
        vectors, constant, _ = fit(pair, gamma, c, tol, working=working, block=block)
        first = (decision(vectors, constant, gamma, x) > 0).cast("int")
        votes[a], votes[b] = votes[a] + first, votes[b] + 1 - first
    ranked = F.array(*[F.struct((-v).alias("v"), F.lit(i).alias("i")) for i, v in enumerate(votes)])
    return task.predicted(task.test, task.class_of(F.array_min(ranked)["i"]))
