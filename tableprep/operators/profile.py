"""Column profiles of a table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tableprep.functions.columns import (categorical_columns, dtype, is_float, is_missing, number, numeric_columns,
                                         small_frame, value_or_null)
from tableprep.functions.counts import value_counts
from tableprep.functions.moments import sample_skewness
from tableprep.functions.quantiles import exact_quantiles


def missing_counts(df: DataFrame, names: Sequence[str] | None = None) -> tuple[int, dict[str, int]]:
    """Row count and missing values per column, in one scan."""
    names = df.columns if names is None else names
    row = df.agg(F.count("*"), *[F.count_if(is_missing(df, c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return row[0], dict(zip(names, row[1:]))


def distinct_counts(df: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """Distinct non-missing values per column: one shuffle of pre-aggregated values for all columns.

    Doubles go through a shuffle of their own; whole numbers stay exact as text.
    """
    floats = [c for c in names if is_float(df, c)]
    other = [c for c in names if c not in floats]
    result = {c: 0 for c in names}
    for part, kind in ((floats, "double"), (other, "string")):
        if part:
            cells = value_counts(df, {c: value_or_null(df, c) for c in part}, kind).filter("value is not null")
            result.update({r["column"]: r["n"] for r in
                           cells.groupBy("column").agg(F.count("*").alias("n")).collect()})
    return result


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, missing values, distinct values (missing counts as one), skewness and excess kurtosis.

    Skewness and kurtosis are those of the population; they are null for columns that are not numeric.
    """
    numeric = numeric_columns(df)
    row = df.agg(*[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
                 *[F.struct(F.skewness(number(df, c)), F.kurtosis(number(df, c))).alias(f"c{i}")
                   for i, c in enumerate(numeric)]).first()
    missing, shape = dict(zip(df.columns, row)), dict(zip(numeric, row[len(df.columns):]))
    distinct = distinct_counts(df, df.columns)
    order = numeric + categorical_columns(df)
    rows = [(c, dtype(df, c).simpleString(), missing[c], distinct[c] + (missing[c] > 0), *shape.get(c, (None, None)))
            for c in order]
    return small_frame(df.sparkSession, [], rows, "column string, type string, missing long, distinct long, "
                                                  "skewness double, kurtosis double")


def value_frequencies(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n) of every non-missing value."""
    names = df.columns if names is None else names
    return value_counts(df, {c: value_or_null(df, c) for c in names}).filter("value is not null")


def sparse_features(df: DataFrame, top: int = 5) -> DataFrame:
    """The columns with the highest share of missing values, in percent."""
    n, missing = missing_counts(df)
    rows = sorted(((c, 100.0 * k / n) for c, k in missing.items() if k), key=lambda r: (-r[1], r[0]))[:top]
    rounded = [(c, float(np.round(share, 1))) for c, share in rows]
    return small_frame(df.sparkSession, [], rounded, "column string, missing_percent double")


def describe_numbers(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample deviation, minimum, exact quartiles and maximum of each numeric column."""
    names = numeric_columns(df, names)
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    row = df.agg(*[F.struct(F.count(x), F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)).alias(f"c{i}")
                   for i, x in enumerate(number(df, c) for c in names)]).first()
    rows = [(c, n, mean, std, low, *quartiles[c], high) for c, (n, mean, std, low, high) in zip(names, row)]
    return small_frame(df.sparkSession, [], rows, "column string, n long, mean double, std double, min double, "
                                                  "q25 double, q50 double, q75 double, max double")


def numeric_stats(df: DataFrame, names: Sequence[str], quartiles: dict | None = None) -> dict[str, dict]:
    """mean, median, sample deviation, minimum, maximum, corrected skewness and share of distinct values."""
    if not names:
        return {}
    medians = exact_quantiles(df, names, [0.5]) if quartiles is None else {c: [q[1]] for c, q in quartiles.items()}
    distinct = distinct_counts(df, names)
    row = df.agg(*[F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                            F.min(x).alias("min"), F.max(x).alias("max"), sample_skewness(x).alias("skew"))
                   .alias(f"c{i}") for i, x in enumerate(number(df, c) for c in names)]).first()
    return {c: {**{k: s[k] for k in ("mean", "std", "min", "max", "skew")}, "median": medians[c][0],
                "unique_ratio": distinct[c] / s["n"] if s["n"] else 0.0} for c, s in zip(names, row)}
