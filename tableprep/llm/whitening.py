"""Whitening of embeddings with a covariance by polarisation.

Entries become whole numbers, so every sum below is exact. Tasks add up the squared centred values of every dimension and of
every sum of two dimensions; cov(a, b) = (var(a + b) - var(a) - var(b)) / 2 then gives all cross-covariances. The driver holds
one number per pair of dimensions, never a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: x = floor(SCALE * c) + SHIFT. Larger magnitudes than LARGEST are cut to it (float embeddings never come near).
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 45
COMPONENTS = 32
#: Rows per output slice.
SLICE = 2_000
LONG = (1 << 63) - 1


def _matrix(column: pa.Array, dims: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(indices of the rows, their x, length) of a batch's usable vectors of length `dims` (None: of the longest)."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries are NaN
    ends = np.cumsum(length)
    broken = np.concatenate(([0], np.cumsum(~np.isfinite(entries))))
    usable = (broken[ends] == broken[ends - length]) & (length > 0)
    if dims is None:
        dims = int(length[usable].max(initial=0))
    rows = np.flatnonzero(usable & (length == dims))
    c = entries[(ends - length)[rows][:, None] + np.arange(dims)]
    return rows, np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64) + SHIFT, dims


def _whole_sum(values: np.ndarray, largest: int) -> np.ndarray:
    """Sums of columns as Python numbers if they might not fit into 64 bits; `largest` bounds one value."""
    return (values if largest * len(values) <= LONG else values.astype(object)).sum(axis=0).astype(object)


@dataclass(frozen=True)
class Whitening:
    """n: rows; sums: of x by dimension; middle: whole numbers near the means; values, axes: eigenvalues above nothing, falling,
    and their unit eigenvectors as columns; shares: of the trace; identity_error: None where no component varies."""

    n: int
    sums: list[int]
    middle: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    shares: np.ndarray
    identity_error: float | None
    span: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        rest = np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, self.middle.tolist())])
        return (x - self.middle) - rest

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.axes / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - S) ** 2, exact; None beyond 64 bits."""
        fits = len(self.sums) * self.span ** 2 <= LONG
        kind = np.int64 if fits else object
        y = x.astype(kind) * self.n - np.array(self.sums, kind)
        found = (y * y).sum(axis=1)
        return found.tolist() if fits else [v if v <= LONG else None for v in found]


def _summaries(df: DataFrame, vector: str) -> tuple[int, list[int], int, int]:
    """(n, sums, least x, largest x) over the usable vectors of the greatest length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, held = 0, []
        for batch in batches:
            rows, x, dims = _matrix(batch.column(0), None)
            if not len(rows) or dims < width:
                continue
            part = [len(x), _whole_sum(x, LARGEST + SHIFT), x.min(axis=0), x.max(axis=0)]
            held = part if dims > width else [held[0] + part[0], held[1] + part[1], np.minimum(held[2], part[2]), np.maximum(held[3], part[3])]
            width = dims
        if width:
            yield pa.RecordBatch.from_arrays(
                [pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([held[0]] * width, pa.int64()),
                 pa.array([Decimal(int(s)) for s in held[1]], pa.decimal128(38, 0)), pa.array(held[2]), pa.array(held[3])],
                ["width", "dim", "n", "total", "least", "most"])

    parts = df.select(vector).mapInArrow(run, "width int, dim int, n long, total decimal(38,0), least long, most long")
    found = parts.groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"),
                                              F.min("least").alias("least"), F.max("most").alias("most")).collect()
    width = max((r["width"] for r in found), default=0)
    rows = sorted((r for r in found if r["width"] == width), key=lambda r: r["dim"])
    if not rows:
        return 0, [], 0, 0
    return rows[0]["n"], [int(r["total"]) for r in rows], min(r["least"] for r in rows), max(r["most"] for r in rows)


def _squares(df: DataFrame, vector: str, middle: np.ndarray, reach: int) -> np.ndarray:
    """d x d of Python numbers: in the diagonal the sum of y_a squared, elsewhere of (y_a + y_b) squared; y = x - middle."""
    dims = len(middle)
    one, two = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(one), object)
        for batch in batches:
            rows, x, _ = _matrix(batch.column(0), dims)
            if not len(rows):
                continue
            y = x - middle
            parts = []
            for a in range(dims):
                both = y[:, a:] + y[:, a, None]
                both[:, 0] = y[:, a]
                big = 4 * reach * reach > LONG
                parts.append(_whole_sum((both.astype(object) if big else both) ** 2, 4 * reach * reach))
            total = total + np.concatenate(parts)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(one)), pa.int32()),
                                              pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], ["pair", "total"])

    parts = df.select(vector).mapInArrow(run, "pair int, total decimal(38,0)")
    out = np.zeros((dims, dims), object)
    for r in parts.groupBy("pair").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect():
        out[one[r["pair"]], two[r["pair"]]] = out[two[r["pair"]], one[r["pair"]]] = int(r["total"])
    return out


def covariance(squares: np.ndarray, rests: list[int], n: int) -> np.ndarray:
    """The covariance by polarisation: n * n * var(a) and n * n * var(a + b) are whole numbers, divided once at the end.
    rests: sums of y, what is left of the mean after centring on whole numbers."""
    dims = len(rests)
    rest = np.array(rests, object)
    both = rest[:, None] + rest[None, :]
    both[np.diag_indices(dims)] = rest
    spread = n * squares - both * both
    alone = spread[np.diag_indices(dims)]
    return np.array([[float(alone[a] / (n * n)) if a == b else (spread[a, b] - alone[a] - alone[b]) / (2 * n * n)
                      for b in range(dims)] for a in range(dims)], np.float64)


def _identity_error(df: DataFrame, vector: str, fitted: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, measured over all rows."""
    dims, k = len(fitted.sums), len(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            rows, x, _ = _matrix(batch.column(0), dims)
            if len(rows):
                w = fitted.apply(x)
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["cell", "total"])

    sums = np.zeros((k + 1) * k)
    for r in df.select(vector).mapInArrow(run, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect():
        sums[r["cell"]] = r["total"]
    sums = sums.reshape(k + 1, k) / fitted.n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors: three passes over the table (sums, squares, check). None without any row."""
    n, sums, least, most = _summaries(df, vector)
    if not n:
        return None
    dims = len(sums)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    reach = max(most - int(middle.min()), int(middle.max()) - least)
    rests = [s - n * m for s, m in zip(sums, middle.tolist())]
    matrix = covariance(_squares(df, vector, middle, reach), rests, n)
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(dims)] < 0, -1.0, 1.0)
    trace = float(np.trace(matrix))
    real = int((values[:components] > max(values[0], 0.0) * dims * np.finfo(float).eps * 16).sum())
    span = max(abs(n * most - min(sums)), abs(max(sums) - n * least))
    found = Whitening(n, sums, middle, values[:real], axes[:, :real], values[:real] / (trace or 1.0), None, span)
    return Whitening(*[getattr(found, f) for f in ("n", "sums", "middle", "values", "axes", "shares")],
                     _identity_error(df, vector, found), span) if real else found


def whiten_table(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): one row per usable vector and component.

    A vector is usable if it is not null and no entry is null or not finite. Where lengths differ, the greatest length of a
    usable vector counts, and a shorter vector lacks entries, which is the same as a null entry. Repeated rows count as often
    as they occur; keys may be null or repeated. Components without variance (equal rows, a single row, fewer varying
    dimensions than components) come back with null in whitened and 0 in explained, and stay out of identity_error, which is
    null if none varies. deviation is null beyond 64 bits. A table without usable rows gives no rows. Other columns are left out.
    """
    kind = df.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    source = df.select(key, vector)
    found = fit(df, vector, components)
    if found is None:
        return df.sparkSession.createDataFrame([], schema)
    dims, real = len(found.sums), len(found.values)
    k = min(components, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                rows, x, _ = _matrix(batch.column(1), dims)
                if not len(rows):
                    continue
                m = len(rows)
                w = np.full((m, k), np.nan)
                w[:, :real] = found.apply(x) if real else 0
                shares = np.zeros(k)
                shares[:real] = found.shares
                again = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, found.n)), pa.array(found.deviations(x), pa.int64()).take(again),
                    pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(np.tile(shares, m)),
                    pa.array([found.identity_error] * (m * k), pa.float64())],
                    [batch.schema.names[0], "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return source.mapInArrow(run, schema)
