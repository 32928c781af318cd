"""Scalers and distribution transforms of the numeric columns.

All fit on the train rows, take missing numbers as 0 first, and carry the other columns along. A constant column has
scale 1. Fitting is one aggregation over all columns (a few scans for exact quantiles); applying is one projection.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tableprep.functions.columns import Roles, filled, replace_columns
from tableprep.functions.quantiles import exact_quantiles, quantile_grid

LAMBDA_REACH, LAMBDA_POINTS = 4.0, 17  # the first search is -4..4
LAMBDA_STEP, LAMBDA_MOST = 1e-4, 1e6   # relative step that ends it, and where a likelihood that only rises is left
NEAR_EQUAL = 1e-8  # fixed value: closer bin edges are merged


def _inputs(df: DataFrame, roles: Roles) -> dict[str, Column]:
    return {c: filled(df, c) for c in roles.numeric(df)}


def _fit(df: DataFrame, roles: Roles, x: dict[str, Column], *stats) -> dict[str, tuple]:
    if not x:
        return {}
    row = roles.train(df).agg(*[F.struct(*[s(v) for s in stats]).alias(f"c{i}")
                                for i, v in enumerate(x.values())]).first()
    return {c: tuple(v) for c, v in zip(x, row)}


def _linear(df: DataFrame, x: dict[str, Column], params: dict[str, tuple[float, float]]) -> DataFrame:
    """(value - shift) / scale, with scale 1 where it is 0."""
    return replace_columns(df, {c: (x[c] - F.lit(float(shift or 0.0))) / F.lit(float(scale or 1.0))
                                for c, (shift, scale) in params.items()})


def min_max_scaler(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    x = _inputs(df, roles)
    fitted = _fit(df, roles, x, F.min, F.max)
    return _linear(df, x, {c: (low, (high or 0.0) - (low or 0.0)) for c, (low, high) in fitted.items()})


def max_abs_scaler(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    x = _inputs(df, roles)
    fitted = _fit(df, roles, x, lambda v: F.max(F.abs(v)))
    return _linear(df, x, {c: (0.0, top) for c, (top,) in fitted.items()})


def robust_scaler(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Median and interquartile range."""
    x = _inputs(df, roles)
    quartiles = exact_quantiles(roles.train(df), x, [0.25, 0.5, 0.75])
    return _linear(df, x, {c: (q[1], (q[2] or 0.0) - (q[0] or 0.0)) for c, q in quartiles.items()})


def standard_scaler(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Mean and population deviation."""
    x = _inputs(df, roles)
    return _linear(df, x, _fit(df, roles, x, F.avg, F.stddev_pop))


def quantile_transformer(df: DataFrame, roles: Roles = Roles(), points: int = 1_000) -> DataFrame:
    """Maps each value to its place among min(points, rows) train quantiles, from 0 to 1.

    A value repeated over several quantiles gets the middle of their places.
    """
    x = _inputs(df, roles)
    if not x:
        return df
    grids = quantile_grid(roles.train(df), x, points)

    def place(grid: list[float]):
        knots = np.array(grid)
        places = np.linspace(0.0, 1.0, len(knots)) if len(knots) > 1 else np.zeros(len(knots))

        @F.pandas_udf("double")
        def place_values(v: pd.Series) -> pd.Series:
            if not len(knots):
                return pd.Series(np.zeros(len(v)))
            values = v.to_numpy()
            upper = np.interp(values, knots, places)
            lower = -np.interp(-values, -knots[::-1], -places[::-1])
            return pd.Series(np.clip((upper + lower) / 2, 0.0, 1.0))

        return place_values

    return replace_columns(df, {c: place(grids[c])(x[c]) for c in x})


def yeo_johnson(x: Column, lam: float) -> Column:
    """Power transform that also takes zero and negative values."""
    positive = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1.0, F.lit(lam)) - 1.0) / lam
    negative = -F.log1p(-x) if abs(lam - 2.0) < 1e-12 else -(F.pow(1.0 - x, F.lit(2.0 - lam)) - 1.0) / (2.0 - lam)
    return F.when(x >= 0, positive).otherwise(negative)


def _power_moments(df: DataFrame, x: dict[str, Column], lams: list[list[float]]) -> dict[tuple[int, float], tuple]:
    """{(column, lambda): (rows, mean, variance)} of the transformed values, all lambdas in one scan.

    Each task takes one logarithm per value and one exponential per lambda over its Arrow batches, and gives out one row
    per column and lambda.
    """
    def partial(batches):
        total: dict[tuple[int, float], list[float]] = {}
        for pdf in batches:
            for c, tried in enumerate(lams):
                v = pdf[f"x{c}"].to_numpy()
                positive, logs = v >= 0, np.log1p(np.abs(v))
                up, down = logs[positive], logs[~positive]
                for lam in tried:
                    with np.errstate(over="ignore", invalid="ignore"):
                        y = np.concatenate([up if abs(lam) < 1e-12 else np.expm1(lam * up) / lam,
                                            -down if abs(lam - 2) < 1e-12 else -np.expm1((2 - lam) * down) / (2 - lam)])
                        if not len(y):
                            continue
                        n, mean, spread = len(y), y.mean(), ((y - y.mean()) ** 2).sum()
                        t = total.setdefault((c, lam), [0, 0.0, 0.0])
                        apart = mean - t[1]
                        both = t[0] + n
                        t[2] += spread + apart * apart * t[0] * n / both
                        t[1] += apart * n / both
                        t[0] = both
        yield pd.DataFrame([(c, lam, *t) for (c, lam), t in total.items()], columns=["c", "lam", "n", "mean", "spread"])

    rows = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x.values())])
    parts = rows.mapInPandas(partial, "c int, lam double, n long, mean double, spread double")
    # spreads around the parts' means, and of these means around the common one: no difference of large squares
    same = Window.partitionBy("c", "lam")
    parts = parts.withColumn("whole", F.sum(F.col("n") * F.col("mean")).over(same) / F.sum("n").over(same))
    merged = parts.groupBy("c", "lam").agg(
        F.sum("n").alias("n"), F.first("whole").alias("mean"),
        (F.sum(F.col("spread") + F.col("n") * F.pow(F.col("mean") - F.col("whole"), F.lit(2))) / F.sum("n")).alias("var"))
    return {(r["c"], r["lam"]): (r["n"], r["mean"], r["var"]) for r in merged.collect()}


def fit_power(df: DataFrame, x: dict[str, Column]) -> dict[str, tuple[float, float, float]]:
    """Per column the lambda of highest likelihood, then mean and population deviation of the transformed values.

    Every pass scores a few lambdas of all columns in one scan. The next one narrows to the neighbours of the best lambda,
    or widens the search where the best one lies at the rim, until it lies inside for every column.
    """
    if not x:
        return {}
    sums = df.agg(*[F.sum(F.signum(v) * F.log1p(F.abs(v))).alias(f"c{i}") for i, v in enumerate(x.values())]).first()
    half = (LAMBDA_POINTS - 1) // 2
    grid = [(0.0, LAMBDA_REACH / half)] * len(x)  # centre and step
    best: dict[int, tuple] = {}
    open_ = set(range(len(x)))
    while open_:
        tried = [[centre + step * i for i in range(-half, half + 1)] if c in open_ else [] for c, (centre, step) in enumerate(grid)]
        scored: dict[int, list] = {}
        for (c, lam), (n, mean, var) in _power_moments(df, x, tried).items():
            if var > 0 and np.isfinite(var):
                scored.setdefault(c, []).append((-n / 2 * np.log(var) + (lam - 1) * sums[c], lam, mean, np.sqrt(var)))
        for c in list(open_):
            if c not in scored:
                open_.discard(c)
                continue
            best[c] = max([*scored[c], *([best[c]] if c in best else [])])
            (centre, step), lam = grid[c], best[c][1]
            known = sorted(s[1] for s in scored[c])
            if lam in (known[0], known[-1]) and abs(lam) < LAMBDA_MOST and lam in (tried[c][0], tried[c][-1]):
                grid[c] = (lam, 2 * step)
            else:
                grid[c] = (lam, step / half)
            if grid[c][1] < LAMBDA_STEP * max(1.0, abs(lam)):
                open_.discard(c)
    return {c: tuple(map(float, best[i][1:])) for i, c in enumerate(x) if i in best}


def power_transformer(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Yeo-Johnson transform, then standardised. A column without a usable fit (a constant) stays as it is."""
    x = _inputs(df, roles)
    fitted = fit_power(roles.train(df), x)
    return replace_columns(df, {c: (yeo_johnson(x[c], lam) - F.lit(mean)) / F.lit(std or 1.0)
                                if c in fitted else x[c] for c in x for lam, mean, std in [fitted.get(c, (1, 0, 1))]})


def log_transformer(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """log(1 + x) of the columns that hold no negative train value."""
    x = _inputs(df, roles)
    fitted = _fit(df, roles, x, F.min)
    # a test value of -1 or less has no logarithm: null, as any missing value
    return replace_columns(df, {c: F.log1p(x[c]) if low is not None and low >= 0 else x[c]
                                for c, (low,) in fitted.items()})


def row_normalizer(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Each row divided by its Euclidean length over the numeric columns; zero rows stay."""
    x = _inputs(df, roles)
    if not x:
        return df
    length = F.sqrt(sum((v * v for v in x.values()), F.lit(0.0)))
    # the length is computed once per row, then used by every column
    staged = df.select("*", F.when(length > 0, length).otherwise(F.lit(1.0)).alias("_length"))
    return replace_columns(staged, {c: filled(df, c) / F.col("_length") for c in x}).drop("_length")


def quantile_bins(df: DataFrame, roles: Roles = Roles(), bins: int = 5) -> DataFrame:
    """Ordinal bin of each value between train quantiles; values outside fall into the end bins."""
    x = _inputs(df, roles)
    edges = exact_quantiles(roles.train(df), x, [i / bins for i in range(bins + 1)])
    new = {}
    for c, v in x.items():
        kept = [] if edges[c][0] is None else [edges[c][0]]
        for e in edges[c][1:] if kept else ():
            if e - kept[-1] > NEAR_EQUAL:
                kept.append(e)
        code = F.lit(0.0)
        for i, edge in enumerate(kept[1:-1], start=1):
            code = F.when(v >= F.lit(edge), F.lit(float(i))).otherwise(code)
        new[c] = code
    return replace_columns(df, new)
