"""Leading directions of tables of any width, without a matrix of columns by columns.

`leading` is a block Krylov method: a pass multiplies every row with a few vectors and the transposed table with the
results, tasks add up tall thin matrices, and the driver solves a small problem on the space spanned so far. It works on
dense arrays and on sparse rows (indices and values); centring never fills in a sparse row. Sparse rows of more than WIDE
columns keep their vectors in tables (`_leading_wide`): the driver gets sums of a few numbers and the directions asked for.

`Factor` is the mergeable state of an incremental decomposition: row count, means, and a short matrix with the scatter of the
rows seen. Two states merge by one small decomposition, so batches, tasks and tables can be added in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tableprep.session import Kept

EXTRA = 6        # vectors carried beyond those asked for
SPAN = 200       # vectors of the space after which it starts again from the best ones
PASSES = 300     # most passes over the table
TOLERANCE = 1e-9
PART = 4_096     # columns of one summed piece
GROUP = 32       # about as many states meet in one task
WIDE = 50_000    # columns of sparse rows beyond which vectors are kept in tables
GUARDS = 4       # vectors such a search carries beyond those asked for
PAIRS = 8        # pairs of cells per cell up to which the products of columns are added up once, for all passes


def sparse_row(vector: Column) -> tuple[Column, Column]:
    """(indices, values) of a Spark ML vector, dense or sparse."""
    held = F.unwrap_udt(vector)
    every = F.sequence(F.lit(0), F.size(held["values"]) - 1)
    return F.coalesce(held["indices"], F.when(F.size(held["values"]) > 0, every)), held["values"]


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of every entry, entries) of a list column without nulls."""
    ends = column.offsets.to_numpy()
    return np.repeat(np.arange(len(column)), np.diff(ends)), column.flatten().to_numpy(zero_copy_only=False)


def _times(batch: pa.RecordBatch, q: np.ndarray):
    """(rows times q, function that gives the transposed rows times a matrix) of dense (x) or sparse (i, v) rows."""
    if batch.num_columns == 1:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        return x @ q, lambda b: x.T @ b
    (row, i), (_, v) = _ragged(batch.column(0)), _ragged(batch.column(1))
    product = np.zeros((batch.num_rows, q.shape[1]))
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    if len(row):
        product[row[begin]] = np.add.reduceat(q[i] * v[:, None], begin, axis=0)

    def back(b: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(i, v * b[row, j], len(q)) for j in range(b.shape[1])])

    return product, back


def _lists(pieces: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces)))


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Cells by block from pieces (block, task, cells), added in the order of the tasks."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [(b.column(0)[k].as_py(), b.column(1)[k].as_py(), b.column(2)[k].values.to_numpy()) for b in batches for k in range(b.num_rows)]
        total: dict[int, np.ndarray] = {}
        for block, _, cells in sorted(pieces, key=lambda p: p[:2]):
            total[block] = total[block] + cells if block in total else cells
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), _lists(list(total.values()))], ["block", "cells"])

    rows = parts.repartition("block").mapInArrow(add, "block int, cells array<double>").collect()
    return {r["block"]: np.array(r["cells"]) for r in rows}


def _pass(rows: DataFrame, q: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """(X - mean)' (X - mean) q over all rows."""
    d, width = q.shape
    shift = mean @ q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lean = np.zeros((d, width)), np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                product, back = _times(batch, q)
                product -= shift
                total += back(product)
                lean += product.sum(axis=0)
        total -= np.outer(mean, lean)
        task = TaskContext.get().partitionId()
        blocks = range(-(-d // PART))
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([task] * len(blocks), pa.int32()),
                                          _lists([total[b * PART:b * PART + PART].ravel() for b in blocks])], ["block", "task", "cells"])

    found = _summed(rows.mapInArrow(run, "block int, task int, cells array<double>"))
    return np.concatenate([found[b] for b in sorted(found)]).reshape(d, width) if found else np.zeros((d, width))


def column_means(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """(rows, means of the columns)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((d, 1)), 0
        for batch in batches:
            if batch.num_rows:
                total += _times(batch, np.zeros((d, 1)))[1](np.ones((batch.num_rows, 1)))
                n += batch.num_rows
        task = TaskContext.get().partitionId()
        blocks = range(-(-d // PART))
        cells = [total[b * PART:b * PART + PART, 0].tolist() for b in blocks] + [[float(n)]]
        yield pa.RecordBatch.from_arrays([pa.array([*blocks, len(blocks)], pa.int32()), pa.array([task] * len(cells), pa.int32()), pa.array(cells)],
                                         ["block", "task", "cells"])

    blocks = -(-d // PART)
    parts = rows.mapInArrow(run, "block int, task int, cells array<double>")
    found = _summed(parts)
    n = int(found[blocks][0]) if found else 0
    return n, np.concatenate([np.zeros(0), *[found[b] for b in range(blocks) if found]])[:d] / max(n, 1) if n else np.zeros(d)


@dataclass(frozen=True)
class Leading:
    """rows; mean (zeros if not centred); values: eigenvalues of the scatter, falling; axes: unit columns whose largest entry
    is positive; residual: length of what the scatter adds to an axis, relative to the largest value; passes."""

    rows: int
    mean: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    residual: float
    passes: int


def positive(axes: np.ndarray) -> np.ndarray:
    """Axes with a positive largest entry."""
    return axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)


def _against(w: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Orthonormal columns for the part of `w` outside `span`; columns with nothing left are dropped."""
    size = np.linalg.norm(w, axis=0)
    for _ in range(2):
        w = w - span @ (span.T @ w)
    w = w[:, np.linalg.norm(w, axis=0) > 1e-13 * np.maximum(size, 1e-300)]
    if not w.shape[1]:
        return w
    q, r = np.linalg.qr(w)
    q = q[:, np.abs(np.diag(r)) > 1e-13 * np.abs(np.diag(r)).max()]
    q = q - span @ (span.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def leading(rows: DataFrame, d: int, k: int, center: bool, tolerance: float = TOLERANCE, passes: int = PASSES, seed: int = 0) -> Leading:
    """The k leading directions of rows given as one column (arrays of d doubles) or two (indices, values); no nulls.

    Passes go on until the residual is below the tolerance. The driver holds a few hundred vectors of d numbers, or the k
    directions alone for sparse rows of more than WIDE columns.
    """
    if len(rows.columns) == 2 and d > WIDE:
        return _leading_wide(rows, d, k, center, tolerance, passes, seed)
    n, mean = column_means(rows, d)
    if not center:
        mean = np.zeros(d)
    k = min(k, d)
    width = min(d, k + EXTRA)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    span, image, residual, done = np.zeros((d, 0)), np.zeros((d, 0)), np.inf, 0
    while True:
        span, image = np.hstack((span, block)), np.hstack((image, _pass(rows, block, mean)))
        done += 1
        small = span.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        axes = span @ vectors[:, :k]
        rest = image @ vectors[:, :k] - axes * values[:k]
        residual = float(np.linalg.norm(rest, axis=0).max() / max(values[0], 1e-300)) if values[0] > 0 else 0.0
        block = _against(image[:, -block.shape[1]:], span)
        if residual <= tolerance or done >= passes or not block.shape[1]:
            return Leading(n, mean, np.maximum(values[:k], 0.0), positive(axes), residual, done)
        if span.shape[1] + block.shape[1] > min(SPAN, d):
            if span.shape[1] + block.shape[1] > d:
                block = block[:, :max(1, d - span.shape[1])]
            if span.shape[1] + block.shape[1] > SPAN:
                kept = vectors[:, :width]
                span, image = span @ kept, image @ kept


# --- sparse rows of very many columns ----------------------------------------------------------------------------------

def _doubles(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _block(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _scatter_times(cells: DataFrame, paired: bool):
    """The function that multiplies the scatter with a table (j, w: an array of `width` numbers), as (j, a0, a1, ...). cells:
    the scatter itself as (i, j, v), or the filled places of the rows as (r, j, v), which take two joins."""
    def summed(joined: DataFrame, by: str, width: int) -> DataFrame:
        return joined.groupBy(by).agg(*[F.sum(F.col("v") * F.col("w")[t]).alias(f"a{t}") for t in range(width)])

    def times(q: DataFrame, width: int) -> DataFrame:
        if paired:
            return summed(cells.join(q, "j"), "i", width).withColumnRenamed("i", "j")
        rows = summed(cells.join(q, "j"), "r", width).select("r", F.array(*[f"a{t}" for t in range(width)]).alias("w"))
        return summed(cells.join(rows, "r"), "j", width)

    return times


def _inner(basis: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(S'S, S'A, S'm) of a table (j, m, s, a)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                s, a = _block(batch.column(1), batch.num_rows), _block(batch.column(2), batch.num_rows)
                part = s.T @ np.column_stack((s, a, batch.column(0).to_numpy()))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), _doubles(total.reshape(1, -1))], ["task", "cells"])

    found = basis.select("m", "s", "a").mapInArrow(run, "task int, cells array<double>").collect()
    if not found:
        return np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0)
    cells = sum(np.array(r["cells"]) for r in sorted(found, key=lambda r: r["task"]))
    b = int((np.sqrt(1 + 8 * len(cells)) - 1) / 4 + 0.5)  # b * (2 b + 1) numbers
    cells = cells.reshape(b, 2 * b + 1)
    return cells[:, :b], cells[:, b:2 * b], cells[:, -1]


def _moved_on(basis: DataFrame, x: np.ndarray, p: np.ndarray, values: np.ndarray, pull: np.ndarray) -> DataFrame:
    """(j, m, x, p, ax, ap, w) from (j, m, s, a): the new vectors and steps, given by coefficients, and the residuals w. pull:
    what the means take from the products, per vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s, a = _block(batch.column(2), batch.num_rows), _block(batch.column(3), batch.num_rows)
                made, image = s @ x, a @ x
                rest = image - np.outer(batch.column(1).to_numpy(), pull) - made * values
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(_doubles, (made, s @ p, image, a @ p, rest))],
                                                 ["j", "m", "x", "p", "ax", "ap", "w"])

    return basis.select("j", "m", "s", "a").mapInArrow(run, "j int, m double, " + ", ".join(f"{c} array<double>" for c in ("x", "p", "ax", "ap", "w")))


def _best_of(inner: np.ndarray, images: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, coefficients of the leading vectors, coefficients of the steps) on a basis with these inner products; the first
    `width` vectors of the basis are the present ones."""
    size = 1 / np.sqrt(np.maximum(np.diag(inner), 1e-300))
    size[np.diag(inner) <= 0] = 0.0
    weight, turn = np.linalg.eigh(inner * np.outer(size, size))
    white = size[:, None] * turn[:, weight > 1e-11] / np.sqrt(weight[weight > 1e-11])
    values, vectors = np.linalg.eigh(white.T @ ((images + images.T) / 2) @ white)
    x = white @ vectors[:, ::-1][:, :width]
    step = x.copy()
    step[:width] = 0.0  # what came from the residuals and the steps before, then free of x
    step -= x @ (x.T @ inner @ step)
    weight, turn = np.linalg.eigh(step.T @ inner @ step)
    keep = weight > 1e-20
    return values[::-1][:width], x, step @ turn[:, keep] / np.sqrt(weight[keep])


def _leading_wide(rows: DataFrame, d: int, k: int, center: bool, tolerance: float, passes: int, seed: int) -> Leading:
    """`leading` by `_search_wide`, its directions brought to the driver."""
    k = min(k, d)
    axes, mean = np.zeros((d, k)), np.zeros(d)

    def bring(table: DataFrame, present: int) -> None:
        found = table.select("j", "m", *[F.col("s")[t].alias(f"x{t}") for t in range(present)]).toPandas()
        mean[found["j"]] = found["m"]
        for t in range(present):
            axes[found["j"], t] = found[f"x{t}"]

    n, values, residual, done = _search_wide(rows, d, k, center, tolerance, passes, seed, bring)
    if not done:
        return Leading(n, mean, values, np.eye(d, k), residual, done)
    return Leading(n, mean, values, positive(axes), residual, done)


def wide_axes(rows: DataFrame, d: int, k: int, center: bool) -> tuple[DataFrame, np.ndarray]:
    """(table (j, w) with the entries of the k leading directions by column number, shift of their projections) for sparse rows of
    any number of columns. The table stays in the checkpoint folder; the driver sees a few numbers of each direction. Without a
    filled place the directions are the first columns."""
    k = min(k, d)
    held, shift = [], np.zeros(k)

    def keep(table: DataFrame, present: int) -> None:
        x = [F.col("s")[t] for t in range(present)]
        tops = table.agg(*[F.max_by(v, F.struct(F.abs(v).alias("a"), (-F.col("j")).alias("j"))) for v in x]).first()
        signed = [v * (-1.0 if top < 0 else 1.0) for v, top in zip(x, tops)]
        shift[:present] = table.agg(*[F.sum(F.col("m") * v) for v in signed]).first()
        held.append(Kept(table.select("j", F.array(*signed, *[F.lit(0.0)] * (k - present)).alias("w"))).__enter__())

    _search_wide(rows, d, k, center, TOLERANCE, PASSES, 0, keep)
    first = held[0] if held else rows.sparkSession.createDataFrame(list(enumerate(np.eye(k).tolist())), "j int, w array<double>")
    return first, shift


def _search_wide(rows: DataFrame, d: int, k: int, center: bool, tolerance: float, passes: int, seed: int, finish) -> tuple[int, np.ndarray, float, int]:
    """(rows, values, residual, passes) of locally optimal block steps: every pass takes the best vectors out of the span of the
    present ones, their residuals and their last steps. These are rows by column number in a table; the driver sees their inner
    products. `finish` gets the table (j, m, s) of the last ones, s beginning with the directions, and the number of these; it is
    not called where no row has a filled place."""
    rows = rows.toDF("i", "v")
    size = F.size("i").cast("long")
    n, filled, squares = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(size * size), F.lit(0))).first()
    paired = squares <= PAIRS * filled
    if not filled:
        return n, np.zeros(k), 0.0, 0
    both = F.arrays_zip("i", "v")
    if paired:
        products = F.flatten(F.transform(both, lambda a: F.transform(both, lambda b: F.struct(
            a["i"].alias("i"), b["i"].alias("j"), (a["v"] * b["v"]).alias("v")))))
        cells = rows.select(F.explode(products).alias("c")).select("c.*").groupBy("i", "j").agg(F.sum("v").alias("v"))
    else:
        numbered = rows.withColumn("r", F.monotonically_increasing_id())  # before the explode, which would number cells
        cells = numbered.select("r", F.explode(both).alias("c")).select("r", F.col("c.i").alias("j"), "c.v")
    means = rows.select(F.explode(both).alias("c")).groupBy(F.col("c.i").alias("j")).agg(
        (F.sum("c.v") / n if center else F.lit(0.0)).alias("m"))
    width = min(d, k + GUARDS)
    start = F.array(*[F.xxhash64("j", F.lit(seed * width + t)) / float(1 << 63) for t in range(width)])

    with Kept(cells) as cells, Kept(means) as means:
        times = _scatter_times(cells, paired)

        def basis(made: DataFrame, q: str, old: list[str], images: list[str], wide: int) -> DataFrame:
            image = times(made.select("j", F.col(q).alias("w")), wide)
            held = made.join(image, "j", "left")
            a = F.array(*[F.coalesce(f"a{t}", F.lit(0.0)) for t in range(wide)])
            parts = {**{c: F.col(c) for c in made.columns}, "aw": a}
            return held.select("j", "m", F.concat(*[parts[c] for c in old]).alias("s"), F.concat(*[parts[c] for c in images]).alias("a"))

        now = Kept(basis(means.select("j", "m", start.alias("x")), "x", ["x"], ["aw"], width))
        done, values, residual, present = 1, np.zeros(width), np.inf, width
        try:
            while True:
                table = now.__enter__()
                inner, images, lean = _inner(table)
                if done > 1:
                    lengths = np.sqrt(np.maximum(np.diag(inner)[present:present + k], 0.0))
                    residual = float(lengths.max() / values[0]) if values[0] > 0 else 0.0
                    if residual <= tolerance or done >= passes:
                        break
                values, x, p = _best_of(inner, images - n * np.outer(lean, lean), width)
                present = x.shape[1]
                made = _moved_on(table, x, p, values, n * (lean @ x))
                after = Kept(basis(made, "w", ["x", "w", "p"], ["ax", "aw", "ap"], present))
                now.__exit__()
                now, done = after, done + 1
            finish(table, min(k, present))
        finally:
            now.__exit__()
    top = np.zeros(k)
    top[:min(k, present)] = values[:k]
    return n, np.maximum(top, 0.0), residual, done


def project_wide(rows: DataFrame, keep: list[Column], i: Column, v: Column, axes: DataFrame, shift: np.ndarray, name: str) -> DataFrame:
    """`project` for sparse rows and axes as `wide_axes` gives them. The rows are written with a number, in the checkpoint folder,
    so that it stays the same where their places meet the axes and where the sums come back."""
    staged = rows.select(F.struct(*keep).alias("row"), i.alias("_i"), v.alias("_v"), F.monotonically_increasing_id().alias("_n"))
    none = F.array(*[F.lit(-float(s)) for s in shift])
    stored = Kept(staged).__enter__()
    cells = stored.select("_n", F.explode(F.arrays_zip(F.col("_i").alias("j"), F.col("_v").alias("v"))).alias("c")).select("_n", "c.j", "c.v")
    sums = cells.join(axes, "j").groupBy("_n").agg(F.array(*[F.sum(F.col("v") * F.col("w")[t]) - float(s) for t, s in enumerate(shift)]).alias(name))
    return stored.select("row", "_n").join(sums, "_n", "left").select("row.*", F.coalesce(name, none).alias(name))


def project(rows: DataFrame, keep: list[Column], x: list[Column], axes: np.ndarray, mean: np.ndarray, name: str) -> DataFrame:
    """The columns `keep` and the array `name` of projections of rows given as for `leading`."""
    shift = mean @ axes
    staged = rows.select(*keep, *[c.alias(f"_x{i}") for i, c in enumerate(x)])
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.RecordBatch.from_arrays(batch.columns[kept:], batch.schema.names[kept:])
            made = (_times(part, axes)[0] - shift) if batch.num_rows else np.zeros((0, axes.shape[1]))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * axes.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))],
                                             [*batch.schema.names[:kept], name])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in staged.schema.fields[:kept]]
    return staged.mapInArrow(run, ", ".join([*fields, f"`{name}` array<double>"]))


# --- incremental -----------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Factor:
    """rows; mean; root: at most as many rows as columns, with root' root = the scatter of all rows seen. With `most`, only
    that many leading directions are kept at each merge."""

    rows: int
    mean: np.ndarray
    root: np.ndarray
    most: int | None = None

    def merge(self, other: "Factor") -> "Factor":
        if not self.rows or not other.rows:
            return self if self.rows else other
        n = self.rows + other.rows
        gap = np.sqrt(self.rows / n * other.rows) * (other.mean - self.mean)
        mean = self.mean + (other.mean - self.mean) * (other.rows / n)
        return Factor(n, mean, _shorten(np.vstack((self.root, other.root, gap)), self.most), self.most)

    def directions(self) -> tuple[np.ndarray, np.ndarray]:
        """(variances with divisor rows - 1, unit axes as columns with a positive largest entry)."""
        _, size, axes = np.linalg.svd(self.root, full_matrices=False)
        return size ** 2 / max(self.rows - 1, 1), positive(axes.T)


def _shorten(stack: np.ndarray, most: int | None) -> np.ndarray:
    if most is None:
        return np.linalg.qr(stack, mode="r") if len(stack) > stack.shape[1] else stack
    _, size, axes = np.linalg.svd(stack, full_matrices=False)
    return size[:most, None] * axes[:most]


def _of_matrix(x: np.ndarray, most: int | None) -> Factor:
    mean = x.mean(axis=0)
    return Factor(len(x), mean, _shorten(x - mean, most), most)


_STATE = "rows long, mean array<double>, root array<double>"


def _packed(factor: Factor) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([factor.rows]), pa.array([factor.mean.tolist()], pa.list_(pa.float64())),
                                       pa.array([factor.root.ravel().tolist()], pa.list_(pa.float64()))], ["rows", "mean", "root"])


def _unpacked(rows: int, mean, root, most: int | None) -> Factor:
    mean = np.array(mean, dtype=float)
    return Factor(rows, mean, np.array(root, dtype=float).reshape(-1, max(len(mean), 1)), most)


def factor_of(rows: DataFrame, d: int, most: int | None = None) -> Factor:
    """The state of all rows (one column, arrays of d doubles without nulls): every task reduces its rows, tasks then merge
    groups of states until one is left."""
    empty = Factor(0, np.zeros(d), np.zeros((0, d)), most)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = empty
        for batch in batches:
            if batch.num_rows:
                state = state.merge(_of_matrix(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d), most))
        if state.rows:
            yield _packed(state)

    def merge_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = empty
        for batch in batches:
            for r in batch.to_pylist():
                state = state.merge(_unpacked(r["rows"], r["mean"], r["root"], most))
        if state.rows:
            yield _packed(state)

    states = rows.mapInArrow(reduce_rows, _STATE)
    tasks = GROUP * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while tasks > 1:
        tasks = -(-tasks // GROUP)
        states = states.repartition(tasks).mapInArrow(merge_states, _STATE)
    found = states.collect()
    return _unpacked(found[0]["rows"], found[0]["mean"], found[0]["root"], most) if found else empty


def save_factor(spark: SparkSession, factor: Factor, path: str) -> None:
    spark.createDataFrame([(factor.rows, factor.mean.tolist(), factor.root.ravel().tolist(), factor.most)],
                          _STATE + ", most int").coalesce(1).write.mode("overwrite").parquet(path)


def load_factor(spark: SparkSession, path: str) -> Factor:
    r = spark.read.parquet(path).first()
    return _unpacked(r["rows"], r["mean"], r["root"], r["most"])
