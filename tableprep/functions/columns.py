"""Column roles and missing-value expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T


@dataclass(frozen=True)
class Roles:
    """Names of the columns that are not features: row keys, the split marker and the label."""

    keys: tuple[str, ...] = ()
    split: str = "split"
    label: str = "label"

    def features(self, df: DataFrame) -> list[str]:
        reserved = {*self.keys, self.split, self.label}
        return [c for c in df.columns if c not in reserved]

    def numeric(self, df: DataFrame) -> list[str]:
        return numeric_columns(df, self.features(df))

    def categorical(self, df: DataFrame) -> list[str]:
        return categorical_columns(df, self.features(df))

    def train(self, df: DataFrame) -> DataFrame:
        return df.filter(col(self.split) == "train") if self.split in df.columns else df

    def test(self, df: DataFrame) -> DataFrame:
        return df.filter(col(self.split) == "test")


def col(name: str) -> Column:
    """Column by exact name; quotes it, since one-hot names may hold dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def numeric_columns(df: DataFrame, names: Sequence[str] | None = None) -> list[str]:
    names = df.columns if names is None else names
    return [c for c in names if isinstance(dtype(df, c), T.NumericType)]


def categorical_columns(df: DataFrame, names: Sequence[str] | None = None) -> list[str]:
    """Everything that is not a number: booleans and dates count as categories too."""
    names = df.columns if names is None else names
    return [c for c in names if not isinstance(dtype(df, c), T.NumericType)]


def string_columns(df: DataFrame, names: Sequence[str] | None = None) -> list[str]:
    names = df.columns if names is None else names
    return [c for c in names if isinstance(dtype(df, c), T.StringType)]


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), (T.DoubleType, T.FloatType))


def value_or_null(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null, so that one test finds every missing value."""
    if is_float(df, name):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def is_missing(df: DataFrame, name: str) -> Column:
    if is_float(df, name):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def number(df: DataFrame, name: str) -> Column:
    """The column as a double, NaN turned into null."""
    return value_or_null(df, name).cast("double")


def filled(df: DataFrame, name: str, value: float = 0.0) -> Column:
    return F.coalesce(number(df, name), F.lit(float(value)))


def finite_or_zero(df: DataFrame, name: str) -> Column:
    """Null, NaN and both infinities become 0."""
    x = number(df, name)
    return F.when(F.abs(x) < float("inf"), x).otherwise(F.lit(0.0))


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One projection that swaps in new expressions under the old names, in the old order."""
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def one_row(spark, **values) -> DataFrame:
    """A one-row frame of driver-side results, typed from Python values."""
    return small_frame(spark, list(values), [tuple(values.values())])


def small_frame(spark, names: Sequence[str], rows: Sequence[tuple], types: str | None = None) -> DataFrame:
    """A frame of a few driver-side rows. Column types come from `types` or from the first non-null values."""
    if types is not None:
        return spark.createDataFrame(list(rows), types)
    fields = []
    for i, name in enumerate(names):
        value = next((r[i] for r in rows if r[i] is not None), None)
        kind = (T.BooleanType() if isinstance(value, bool) else T.LongType() if isinstance(value, int)
                else T.StringType() if isinstance(value, str) else T.DoubleType())
        fields.append(T.StructField(name, kind))
    return spark.createDataFrame(list(rows), T.StructType(fields))
