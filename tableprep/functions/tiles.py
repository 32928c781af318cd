"""Correlations of tables of any width, as a table: no object of columns by columns on the driver or in a task.

Columns are cut into blocks; a pair of blocks is a tile. Tiles are dealt into groups of bounded size, and every group is one
scan that reads the columns of its tiles alone and adds up their sums in numpy. The partial sums of a tile meet under its
key, in two steps so that many tasks do not end in one, and leave as rows (first, second, correlation).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tableprep.functions.columns import number

BLOCK = 256          # columns of a block
CELLS = 8_000_000    # numbers that one task holds for a group of tiles
SALT = 16            # first-step groups of a tile's partial sums
SUMS = 4             # matrices of a tile: rows where both are present, sums of the first, its squares, products


def _ends(df: DataFrame, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(mean, whether it varies) of every column."""
    d = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = np.zeros(d), np.zeros(d), np.full(d, np.inf), np.full(d, -np.inf)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                there = ~np.isnan(x)
                n += there.sum(axis=0)
                total += np.where(there, x, 0.0).sum(axis=0)
                low = np.minimum(low, np.where(there, x, np.inf).min(axis=0))
                high = np.maximum(high, np.where(there, x, -np.inf).max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), *map(pa.array, (n, total, low, high))], ["i", "n", "s", "low", "high"])

    parts = df.select(*[number(df, c).alias(f"x{i}") for i, c in enumerate(names)]).mapInArrow(run, "i int, n double, s double, low double, high double")
    mean, varies = np.zeros(d), np.zeros(d, bool)
    for r in parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
        mean[r["i"]], varies[r["i"]] = r["s"] / max(r["n"], 1), r["low"] < r["high"]
    return mean, varies


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Columns of a batch as floats, null as NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])


def _groups(blocks: int, block: int) -> list[list[tuple[int, int]]]:
    """Tiles i <= j in groups of bounded size; a group keeps to few blocks."""
    most = max(1, CELLS // (SUMS * block * block))
    tiles = [(i, j) for i in range(blocks) for j in range(i, blocks)]
    return [tiles[k:k + most] for k in range(0, len(tiles), most)]


def _partial(df: DataFrame, names: Sequence[str], tiles: list[tuple[int, int]], block: int, mean: np.ndarray) -> DataFrame:
    """(i, j, salt, cells): the sums of some tiles, one row per task and tile."""
    used = sorted({b for tile in tiles for b in tile})
    columns = [c for b in used for c in range(b * block, min((b + 1) * block, len(names)))]
    center = mean[columns]
    spans, start = {}, 0
    for b in used:
        width = min((b + 1) * block, len(names)) - b * block
        spans[b] = slice(start, start + width)
        start += width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(i, j): np.zeros((SUMS, spans[i].stop - spans[i].start, spans[j].stop - spans[j].start)) for i, j in tiles}
        back = {t: np.zeros((2, *v.shape[1:])) for t, v in total.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            there = (~np.isnan(x)).astype(float)
            x = np.where(there > 0, x - center, 0.0)
            for i, j in tiles:
                a, b, p, q = x[:, spans[i]], x[:, spans[j]], there[:, spans[i]], there[:, spans[j]]
                total[i, j] += [p.T @ q, a.T @ q, (a * a).T @ q, a.T @ b]
                back[i, j] += [p.T @ b, p.T @ (b * b)]
        salt = TaskContext.get().partitionId() % SALT
        for (i, j), cells in total.items():
            flat = np.concatenate((cells.ravel(), back[i, j].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([salt], pa.int32()),
                                              pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))], ["i", "j", "salt", "cells"])

    rows = df.select(*[number(df, names[c]).alias(f"x{c}") for c in columns])
    return rows.mapInArrow(run, "i int, j int, salt int, cells array<double>")


def _added(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], np.ndarray]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            key = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            cells = batch.column(3)[k].values.to_numpy()
            total[key] = total[key] + cells if key in total else cells
    return total


def _first_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (i, j), cells in _added(batches).items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([0], pa.int32()),
                                          pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), pa.array(cells))], ["i", "j", "salt", "cells"])


def correlation_table(df: DataFrame, names: Sequence[str], block: int = BLOCK, diagonal: bool = False) -> DataFrame:
    """(first, second, r) of every pair of columns i < j in the order given: the correlation over the rows where both are
    present, null if one of them does not vary there. `diagonal` adds the pairs i = j: 1, or null."""
    schema = "first string, second string, r double"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    mean, varies = _ends(df, names)
    names, blocks = list(names), -(-len(names) // block)
    parts = reduce(DataFrame.unionByName, [_partial(df, names, tiles, block, mean) for tiles in _groups(blocks, block)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (i, j), cells in _added(batches).items():
            left, right = np.arange(i * block, min((i + 1) * block, len(names))), np.arange(j * block, min((j + 1) * block, len(names)))
            n, s, q, p, s2, q2 = cells.reshape(SUMS + 2, len(left), len(right))
            with np.errstate(divide="ignore", invalid="ignore"):
                a, b = q - s * s / n, q2 - s2 * s2 / n
                r = (p - s * s2 / n) / np.sqrt(a * b)
            least = 1e-26 * n  # rounding noise of values that are equal wherever both are present
            known = (n > 1) & varies[left][:, None] & varies[right][None, :] & (a > least * mean[left][:, None] ** 2) & (b > least * mean[right][None, :] ** 2)
            r = np.where(left[:, None] == right[None, :], 1.0, r)
            x, y = np.nonzero((left[:, None] <= right[None, :]) if diagonal else (left[:, None] < right[None, :]))
            yield pa.RecordBatch.from_arrays([pa.array([names[c] for c in left[x]], pa.string()), pa.array([names[c] for c in right[y]], pa.string()),
                                              pa.array(r[x, y], pa.float64(), mask=~known[x, y])], ["first", "second", "r"])

    met = parts.repartition("i", "j", "salt").mapInArrow(_first_step, "i int, j int, salt int, cells array<double>")
    return met.repartition("i", "j").mapInArrow(finish, schema)
