"""Numbers that describe a table as a whole, and the 17-value vector made of them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tableprep.functions.columns import col, number, numeric_columns, string_columns
from tableprep.functions.counts import value_counts
from tableprep.functions.moments import correlations, sample_skewness
from tableprep.functions.tiles import correlation_table
from tableprep.operators.profile import missing_counts

# Order of the feature vector.
FEATURES = [
    "has_missing", "global_missing_rate", "max_column_missing_rate", "numeric_variance_mean",
    "categorical_cardinality_mean", "duplicate_row_rate", "df_complexity", "df_categorical_entropy", "num_cols",
    "num_numeric_cols", "numeric_mean_of_means", "numeric_mean_of_stds", "numeric_mean_of_skew",
    "num_categorical_cols", "mean_unique_values", "mean_absolute_correlation", "correlation_std",
]


def _mean(values) -> float:
    known = [v for v in values if v is not None and not math.isnan(v)]
    return float(sum(known)) / len(known) if known else 0.0


def missing_rates(df: DataFrame) -> dict[str, float | bool]:
    n, missing = missing_counts(df)
    total = sum(missing.values())
    return {"has_missing": total > 0, "global_missing_rate": total / (n * len(missing)) if n else 0.0,
            "max_column_missing_rate": max(missing.values()) / n if n else 0.0}


def has_missing(df: DataFrame) -> bool:
    return missing_rates(df)["has_missing"]


def global_missing_rate(df: DataFrame) -> float:
    return missing_rates(df)["global_missing_rate"]


def max_column_missing_rate(df: DataFrame) -> float:
    return missing_rates(df)["max_column_missing_rate"]


def _per_column(df: DataFrame, *stats) -> list[float]:
    """Mean over the numeric columns of each statistic, all in one aggregation."""
    x = [number(df, c) for c in numeric_columns(df)]
    if not x:
        return [0.0] * len(stats)
    row = df.agg(*[F.array(*[s(v) for v in x]).alias(f"s{i}") for i, s in enumerate(stats)]).first()
    return [_mean(values) for values in row]


def numeric_variance_mean(df: DataFrame) -> float:
    return _per_column(df, F.var_samp)[0]


def numeric_mean_of_means(df: DataFrame) -> float:
    return _per_column(df, F.avg)[0]


def numeric_mean_of_stds(df: DataFrame) -> float:
    return _per_column(df, F.stddev_samp)[0]


def numeric_mean_of_skew(df: DataFrame) -> float:
    return _per_column(df, sample_skewness)[0]


def _category_shapes(df: DataFrame) -> tuple[dict[str, int], dict[str, float]]:
    """Distinct non-null values and base-2 entropy of each text column, from one table of value counts."""
    names = string_columns(df)
    if not names:
        return {}, {}
    counts = value_counts(df, names).filter("value is not null").groupBy("column").agg(
        F.count("*").alias("distinct"), F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    rows = {r["column"]: r for r in counts.collect()}
    # -sum(p log2 p) = log2(n) - sum(k log2 k) / n
    return ({c: rows[c]["distinct"] if c in rows else 0 for c in names},
            {c: math.log2(r["n"]) - r["nlogn"] / r["n"] for c, r in rows.items()})


def df_categorical_entropy(df: DataFrame) -> float:
    return _mean(_category_shapes(df)[1].values())


def categorical_cardinality_mean(df: DataFrame) -> float:
    return _mean(_category_shapes(df)[0].values())


def mean_unique_values(df: DataFrame) -> float:
    return categorical_cardinality_mean(df)


def num_rows(df: DataFrame) -> int:
    return df.count()


def num_cols(df: DataFrame) -> int:
    return len(df.columns)


def num_numeric_cols(df: DataFrame) -> int:
    return 0 if df.isEmpty() else len(numeric_columns(df))


def num_categorical_cols(df: DataFrame) -> int:
    return 0 if df.isEmpty() else len(string_columns(df))


def duplicate_row_rate(df: DataFrame) -> float:
    """Rows beyond the first of each group of equal rows. Equal rows merge before the shuffle."""
    n, distinct = df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("_n")).agg(
        F.sum("_n"), F.count("*")).first()
    return 1 - distinct / n if n else 0.0


def _matrix(df: DataFrame) -> np.ndarray:
    """Correlation matrix of the numeric columns; NaN where a column does not vary."""
    names = numeric_columns(df)
    matrix = np.full((len(names), len(names)), np.nan)
    for (a, b), r in correlations(df, names, diagonal=True).items():
        i, j = names.index(a), names.index(b)
        if r is not None:
            matrix[i, j] = matrix[j, i] = 1.0 if i == j else r
    return matrix


def _complexity(matrix: np.ndarray) -> float:
    if not matrix.size or np.all(np.isnan(matrix)):
        return 0.0
    values = np.linalg.eigvalsh(np.nan_to_num(matrix))[::-1]
    share = np.cumsum(values) / values.sum()
    return float(np.argmax(share >= 0.95) + 1)


def df_complexity(df: DataFrame) -> float:
    """Principal components that hold 95 % of the variance of the standardised numbers; 0 if a number is missing."""
    names = numeric_columns(df)
    if not names or any(missing_counts(df, names)[1].values()):
        return 0.0
    return _complexity(_matrix(df))


def _mean_correlation(matrix: np.ndarray) -> float:
    if len(matrix) < 2:
        return 0.0
    columns = [_mean(c) for c in np.abs(matrix) if not np.all(np.isnan(c))]
    return _mean(columns)


def _correlation_spread(matrix: np.ndarray) -> float:
    if len(matrix) < 2:
        return 0.0
    columns = [c[~np.isnan(c)] for c in np.abs(matrix)]
    return _mean([float(np.std(c, ddof=1)) for c in columns if len(c) > 1])


def _by_column(df: DataFrame) -> DataFrame:
    """(c, r): every known absolute correlation of a column, its own included; for any number of columns."""
    names = numeric_columns(df)
    table = correlation_table(df, names if len(names) > 1 else [], diagonal=True).where("r IS NOT NULL")
    once = table.select(F.col("first").alias("c"), F.abs("r").alias("r"))
    return once.unionByName(table.where("first <> second").select(F.col("second").alias("c"), F.abs("r").alias("r")))


def mean_absolute_correlation(df: DataFrame) -> float:
    """Mean of the absolute correlation matrix, diagonal included."""
    return _by_column(df).groupBy("c").agg(F.avg("r").alias("m")).agg(F.coalesce(F.avg("m"), F.lit(0.0))).first()[0]


def correlation_std(df: DataFrame) -> float:
    """Mean over the columns of the deviation of the absolute correlations."""
    return _by_column(df).groupBy("c").agg(F.stddev_samp("r").alias("m")).agg(F.coalesce(F.avg("m"), F.lit(0.0))).first()[0]


def all_features(df: DataFrame) -> dict[str, float]:
    """All 17 numbers in order; what cannot be computed is 0. Jobs are shared between them."""
    n, missing = missing_counts(df)
    if not n:
        return {**{f: 0.0 for f in FEATURES}, "num_cols": float(len(df.columns))}
    total = sum(missing.values())
    numeric = numeric_columns(df)
    variance, mean, std, skew = _per_column(df, F.var_samp, F.avg, F.stddev_samp, sample_skewness)
    cardinality, entropy = _category_shapes(df)
    matrix = _matrix(df)
    values = {
        "has_missing": float(total > 0), "global_missing_rate": total / (n * len(missing)),
        "max_column_missing_rate": max(missing.values()) / n, "numeric_variance_mean": variance,
        "categorical_cardinality_mean": _mean(cardinality.values()), "duplicate_row_rate": duplicate_row_rate(df),
        "df_complexity": 0.0 if any(missing[c] for c in numeric) else _complexity(matrix),
        "df_categorical_entropy": _mean(entropy.values()), "num_cols": float(len(df.columns)),
        "num_numeric_cols": float(len(numeric)), "numeric_mean_of_means": mean, "numeric_mean_of_stds": std,
        "numeric_mean_of_skew": skew, "num_categorical_cols": float(len(string_columns(df))),
        "mean_unique_values": _mean(cardinality.values()), "mean_absolute_correlation": _mean_correlation(matrix),
        "correlation_std": _correlation_spread(matrix),
    }
    return {f: float(values[f]) for f in FEATURES}
