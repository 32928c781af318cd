"""Means, second moments and correlations."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tableprep.functions.columns import number


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness, null below three values; a constant column has skewness 0."""
    n = F.count(x)
    g = F.coalesce(F.nanvl(F.skewness(x), F.lit(0.0)), F.lit(0.0))
    return F.when(n >= 3, g * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0)))


def correlations(df: DataFrame, columns: Sequence[str], diagonal: bool = False) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of every pair i < j over rows where both are present; None if one does not vary.

    `diagonal` adds the pairs i = j: 1, or None for a column that does not vary. One scan finds the means, a second one
    multiplies Arrow batches; a table of many columns needs no aggregate per pair.
    """
    if not columns:
        return {}
    size = len(columns)
    x = [number(df, c) for c in columns]
    row = df.agg(*[F.struct(F.avg(v), F.min(v) < F.max(v)).alias(f"c{i}") for i, v in enumerate(x)]).first()
    center, varies = np.array([r[0] or 0.0 for r in row]), [bool(r[1]) for r in row]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((4, size, size))
        for pdf in batches:
            values = pdf.to_numpy(dtype=float)
            present = (~np.isnan(values)).astype(float)
            shifted = np.where(present > 0, values - center, 0.0)
            sums += [present.T @ present, shifted.T @ present, (shifted ** 2).T @ present, shifted.T @ shifted]
        i, j = np.indices((size, size)).reshape(2, -1)
        yield pd.DataFrame({"i": i, "j": j, **{n: m.ravel() for n, m in zip(("n", "s", "q", "p"), sums)}})

    parts = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)]).mapInPandas(
        partial, "i int, j int, n double, s double, q double, p double")
    n, s, q, p = np.zeros((4, size, size))
    for r in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "p")]).collect():
        n[r["i"], r["j"]], s[r["i"], r["j"]], q[r["i"], r["j"]], p[r["i"], r["j"]] = r["n"], r["s"], r["q"], r["p"]
    result: dict[tuple[str, str], float | None] = {}
    for i in range(size):
        for j in range(i if diagonal else i + 1, size):
            known = None
            if varies[i] and varies[j] and n[i, j] > 1:
                a, b = q[i, j] - s[i, j] ** 2 / n[i, j], q[j, i] - s[j, i] ** 2 / n[i, j]
                least = 1e-26 * n[i, j]  # rounding noise of values that are equal wherever both are present
                if a > least * center[i] ** 2 and b > least * center[j] ** 2:
                    known = float((p[i, j] - s[i, j] * s[j, i] / n[i, j]) / np.sqrt(a * b))
            result[columns[i], columns[j]] = known
    return result


def means(df: DataFrame, exprs: Mapping[str, Column]) -> tuple[int, np.ndarray]:
    row = df.agg(F.count("*"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(exprs.values())]).first()
    return row[0], np.array([v or 0.0 for v in row[1:]])


def gram(df: DataFrame, exprs: Mapping[str, Column], center: np.ndarray | None = None,
         weight: Column | None = None) -> np.ndarray:
    """Sum of (x - center)(x - center)' over all rows, as a small matrix on the driver.

    Each task multiplies its Arrow batches and gives out one d x d partial; the partials are added by key on Spark, so
    the driver reads d x d numbers however long the table is. Values must hold no nulls.
    """
    size = len(exprs)
    shift = np.zeros(size) if center is None else np.asarray(center, dtype=float)
    rows = df.select(*[x.cast("double").alias(f"x{i}") for i, x in enumerate(exprs.values())],
                     *([weight.alias("w")] if weight is not None else []))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for pdf in batches:
            x = pdf.iloc[:, :size].to_numpy(dtype=float) - shift
            total += (x * pdf["w"].to_numpy()[:, None]).T @ x if "w" in pdf else x.T @ x
        i, j = np.triu_indices(size)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    matrix = np.zeros((size, size))
    for r in rows.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["v"]
    return matrix


def dot(terms: Sequence[Column], weights: Sequence[float], offset: float = 0.0) -> Column:
    """Linear score as one expression; null-free inputs expected."""
    total = F.lit(float(offset))
    for x, w in zip(terms, weights):
        total = total + x * F.lit(float(w))
    return total
