"""Cheap tests of a table: what it holds and which operators accept it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tableprep.functions.columns import categorical_columns, col, finite_or_zero, number, numeric_columns, string_columns

NUMBER_PATTERN = r"^[+-]?\d*\.?\d*(?:[+-:]\d*\.?\d*)?%?$"  # fixed value; [+-:] is a range of characters


def split_by_type(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(categorical columns, numeric columns)."""
    return (df.select(*[col(c) for c in categorical_columns(df)]), df.select(*[col(c) for c in numeric_columns(df)]))


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in numeric_columns(df)])


def split_numeric_text(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numeric columns, text columns); dates and booleans are in neither."""
    return numeric_only(df), df.select(*[col(c) for c in string_columns(df)])


def table_guards(df: DataFrame) -> dict[str, bool]:
    """Which kinds of operator accept the table.

    a: some rows and a numeric column; b: some rows; c: as d, for encoders and selectors; c1: numeric columns only;
    c2: no numeric column; d: numeric columns only, all of them finite and present.
    """
    numeric, other = numeric_columns(df), categorical_columns(df)
    filled = not df.isEmpty()
    clean = False
    if filled and numeric and not other:
        bad = F.lit(False)
        for c in numeric:
            x = number(df, c)
            bad = bad | x.isNull() | (F.abs(x) == float("inf"))
        clean = df.filter(bad).isEmpty()  # stops at the first bad row
    return {"a": filled and bool(numeric), "b": filled, "c": clean, "c1": filled and not other,
            "c2": filled and not numeric, "d": clean}


def clean_numbers(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns only, missing and infinite values as 0: the input of the predictors."""
    names = numeric_columns(df, names)
    return df.select(*[finite_or_zero(df, c).alias(c) for c in names])


def is_number_text(x: Column) -> Column:
    return x.cast("string").rlike(NUMBER_PATTERN)


def is_not_a_number(x: Column) -> Column:
    return F.trim(x).try_cast("double").isNull()
