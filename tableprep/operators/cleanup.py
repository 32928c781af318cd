"""Column clean-up: list columns, numbers kept as text, dates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableprep.functions.columns import col, dtype, string_columns
from tableprep.functions.quantiles import exact_quantiles

EPOCH = "2017-01-01 00:00:00"  # fixed value: origin of the _TIMESTAMP part


def spread_list(df: DataFrame, name: str) -> DataFrame:
    """Replaces an array column by `<name>_item1..n`, n being the whole part of the 90th percentile of its lengths."""
    if not isinstance(dtype(df, name), T.ArrayType):
        return df
    # a missing cell counts as a one-element list holding nothing
    length = F.when(col(name).isNull(), 1).otherwise(F.size(col(name)))
    cut = int(exact_quantiles(df, {"n": length}, [0.9])["n"][0] or 0)
    items = [F.get(col(name), F.lit(i)).alias(f"{name}_item{i + 1}") for i in range(cut)]
    return df.select(*[x for c in df.columns for x in (items if c == name else [col(c)])])


# Spellings of a date, in order of trust; None is Spark's own reading of ISO text.
DATE_FORMATS = (None, *(f"{day}{time}" for day in ("M/d/yyyy", "M/d/yy", "M-d-yyyy", "M-d-yy", "yyyy/M/d", "yyyy年M月d日", "yy年M月d日")
                        for time in ("", " H:mm:ss", " H:mm")))


def read_date(x: Column, form: str | None) -> Column:
    """Timestamp of a text in one spelling, null where it does not fit."""
    return F.try_to_timestamp(x) if form is None else F.try_to_timestamp(x, F.lit(form))


def any_date(x: Column) -> Column:
    """Timestamp of a text in the first spelling that fits."""
    return F.coalesce(*[read_date(x, form) for form in DATE_FORMATS])


def date_parts(x: Column, name: str) -> list[Column]:
    """Seconds since 2017, year, month, day, weekday (Monday = 0) and decimal hour, all as doubles."""
    ts = x.cast("timestamp")
    parts = {
        "TIMESTAMP": (F.unix_micros(ts) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))) / 1e6,
        "YEAR": F.year(ts), "MONTH": F.month(ts), "DAY": F.dayofmonth(ts), "DAYOFWEEK": F.weekday(ts),
        "HOUR": F.hour(ts) + F.minute(ts) / F.lit(60.0) + F.floor(F.second(ts)) / F.lit(3600.0),
    }
    return [v.cast("double").alias(f"{name}_{part}") for part, v in parts.items()]


def _readings(df: DataFrame, names: Sequence[str], dates: bool) -> dict[str, tuple[bool, int | None]]:
    """(every value is a number, place of the first spelling of a date that fits every value) of text columns; a column
    without values has neither.

    A value that does not fit rules a reading out for the whole column, so the least and the greatest value are tried first;
    only readings that fit both are tried on every row. Failed readings cost far more than others.
    """
    if not names:
        return {}
    row = df.agg(*[F.struct(F.min(col(c)), F.max(col(c))).alias(f"c{i}") for i, c in enumerate(names)]).first()
    ends = {c: tuple(r) for c, r in zip(names, row) if r[0] is not None}
    readings = [lambda x: x.try_cast("double"), *[lambda x, form=form: read_date(x, form) for form in (DATE_FORMATS if dates else ())]]

    def failed(at: dict[str, tuple[Column, ...]], left: dict[str, list[int]]) -> list[Column]:
        return [F.array(*[reduce(Column.__or__, [x.isNotNull() & readings[r](x).isNull() for x in at[c]]) for r in left[c]]) for c in left]

    every = {c: list(range(len(readings))) for c in ends}
    if not ends:
        return {c: (False, None) for c in names}
    texts = df.sparkSession.createDataFrame([tuple(v for c in ends for v in ends[c])], ", ".join(f"l{i} string, h{i} string" for i in range(len(ends))))
    tried = texts.select(*failed({c: (F.col(f"l{i}"), F.col(f"h{i}")) for i, c in enumerate(ends)}, every)).first()
    left = {c: [r for r, bad in zip(every[c], found) if not bad] for c, found in zip(ends, tried)}
    left = {c: some for c, some in left.items() if some}
    if left:
        counted = df.agg(*[F.array(*[F.count_if(col(c).isNotNull() & readings[r](col(c)).isNull()) for r in left[c]]).alias(f"c{i}")
                           for i, c in enumerate(left)]).first()
        left = {c: [r for r, bad in zip(left[c], found) if not bad] for c, found in zip(left, counted)}
    return {c: (0 in left.get(c, []), next((r - 1 for r in left.get(c, []) if r), None)) for c in names}


def coerce(df: DataFrame, names: Sequence[str] | None = None, dates: bool = True) -> DataFrame:
    """Turns a text column into doubles if every value is a number, else into date parts if every value is a date in the
    same spelling, the first of DATE_FORMATS that fits all.

    Two aggregations test all columns; one projection converts them. Date and timestamp columns become date parts.
    """
    names = list(df.columns) if names is None else list(names)
    tests = _readings(df, string_columns(df, names), dates)
    out: list[Column] = []
    for c in df.columns:
        if c in tests and tests[c][0]:
            out.append(col(c).try_cast("double").alias(c))
        elif c in tests and tests[c][1] is not None:
            out += date_parts(read_date(col(c), DATE_FORMATS[tests[c][1]]), c)
        elif dates and c in names and isinstance(dtype(df, c), (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out += date_parts(col(c), c)
        else:
            out.append(col(c))
    return df.select(*out)


def clean(df: DataFrame) -> DataFrame:
    """List columns spread, then numbers and dates found: what a profile scan returns."""
    for c in df.columns:
        df = spread_list(df, c)
    return coerce(df)
