"""Imputers: fit on the train rows, fill every row. Each returns the frame with the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tableprep.functions.columns import Roles, col, filled, number, replace_columns, value_or_null
from tableprep.functions.counts import modes
from tableprep.functions.quantiles import exact_quantiles
from tableprep.operators.profile import missing_counts

Fit = Callable[[DataFrame, list[str]], dict]


def needs_imputation(df: DataFrame, names: list[str] | None = None) -> bool:
    return any(missing_counts(df, names)[1].values())


def _fill(df: DataFrame, roles: Roles, names: list[str], fit: Fit, refit_test: bool, numeric: bool) -> DataFrame:
    """Fills columns with fitted values; nothing happens if no train or test value is missing.

    A column with no train value at all stays as it is.
    """
    missing = missing_counts(df, names)[1] if names else {}
    todo = [c for c in names if missing[c]]
    if not todo:
        return df
    fitted = fit(roles.train(df), todo)
    other = fit(roles.test(df), todo) if refit_test else {}
    new: dict[str, Column] = {}
    for c in todo:
        if fitted.get(c) is None:
            continue
        value = F.lit(fitted[c])
        if refit_test and other.get(c) is not None:
            value = F.when(col(roles.split) == "test", F.lit(other[c])).otherwise(value)
        new[c] = F.coalesce(number(df, c) if numeric else value_or_null(df, c).cast("string"), value)
    return replace_columns(df, new)


def _means(df: DataFrame, names: list[str]) -> dict:
    return dict(zip(names, df.agg(*[F.avg(number(df, c)).alias(f"c{i}") for i, c in enumerate(names)]).first()))


def _medians(df: DataFrame, names: list[str]) -> dict:
    return {c: v[0] for c, v in exact_quantiles(df, names, [0.5]).items()}


def _modes(df: DataFrame, names: list[str]) -> dict:
    return {c: v for c, (v, _) in modes(df, {c: number(df, c) for c in names}, "double").items()}


def _text_modes(df: DataFrame, names: list[str]) -> dict:
    return {c: v for c, (v, _) in modes(df, {c: col(c) for c in names}, "string").items()}


def mean_imputer(df: DataFrame, roles: Roles = Roles(), refit_test: bool = False) -> DataFrame:
    return _fill(df, roles, roles.numeric(df), _means, refit_test, True)


def median_imputer(df: DataFrame, roles: Roles = Roles(), refit_test: bool = False) -> DataFrame:
    return _fill(df, roles, roles.numeric(df), _medians, refit_test, True)


def mode_imputer(df: DataFrame, roles: Roles = Roles(), refit_test: bool = False) -> DataFrame:
    """Most frequent number, the smallest on ties."""
    return _fill(df, roles, roles.numeric(df), _modes, refit_test, True)


def category_imputer(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Most frequent category, the smallest on ties."""
    return _fill(df, roles, roles.categorical(df), _text_modes, False, False)


def constant_fill(df: DataFrame, roles: Roles = Roles(), value: float = 0.0) -> DataFrame:
    """Missing numbers become one constant."""
    return replace_columns(df, {c: filled(df, c, value) for c in roles.numeric(df)})
