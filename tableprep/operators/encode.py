"""Category encoders: fit on the train rows, apply to every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tableprep.functions.columns import Roles, col
from tableprep.functions.counts import SMALL_TABLE, dense_codes, is_small, value_counts
from tableprep.session import cut_lineage

MISSING = "MISSING"   # fixed value: category of a missing cell
UNKNOWN = "Unknown"   # fixed value: class of a category not seen in training
MAX_CASES = 64        # most categories that are coded by an expression instead of a join
MAX_CATEGORICAL = 15  # fixed value: a table with more categorical columns is refused


def needs_encoding(df: DataFrame, roles: Roles = Roles()) -> bool:
    return bool(roles.categorical(df))


def accepts_encoding(df: DataFrame, roles: Roles = Roles()) -> bool:
    return len(roles.categorical(df)) <= MAX_CATEGORICAL


def _text(name: str):
    return F.coalesce(col(name).cast("string"), F.lit(MISSING))


def _categories(df: DataFrame, roles: Roles, names: list[str]) -> DataFrame:
    """Distinct (column, value) of the train rows, one shuffle for all columns."""
    return cut_lineage(value_counts(roles.train(df), {c: _text(c) for c in names}).drop("n"))


def one_hot_encoder(df: DataFrame, roles: Roles = Roles(), sparse: bool = False) -> DataFrame:
    """Each categorical column becomes 0/1 columns `<column>_<value>` in sorted order; unseen values are all zero.

    `sparse` asks for the other form, whatever the number of categories: one column `<column>_hot` with the position of
    the single 1, or -1. It is the one to ask for where categories are many; their list then stays on Spark.
    """
    names = roles.categorical(df)
    if not names:
        return df
    categories = _categories(df, roles, names)
    narrow = [] if sparse else names
    values: dict[str, list[str]] = {c: [] for c in narrow}
    for r in categories.filter(F.col("column").isin(narrow)).orderBy("column", "value").collect():
        values[r["column"]].append(r["value"])
    out = [col(c) for c in df.columns if c not in names]
    for c in narrow:
        text = _text(c)
        out += [F.when(text == v, 1.0).otherwise(0.0).alias(f"{c}_{v}") for v in values[c]]
    wide = [c for c in names if c not in narrow]
    out += [_text(c).alias(f"{c}_hot") for c in wide]
    result = df.select(*out)
    for c in wide:
        codes = dense_codes(categories.filter(F.col("column") == c).select("value"), ["value"])
        result = _join_codes(result, codes, f"{c}_hot", F.lit(-1.0))
    return result


def label_encoder(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Each category becomes its position among the sorted train categories and `Unknown`.

    Values not seen in training get the position of `Unknown`; missing cells are the category `MISSING`.
    """
    names = roles.categorical(df)
    if not names:
        return df
    spark = df.sparkSession
    categories = _categories(df, roles, names)
    categories = categories.union(spark.createDataFrame([(c, UNKNOWN) for c in names], "column string, value string")
                                  ).distinct()
    sizes = {r["column"]: r["count"] for r in categories.groupBy("column").count().collect()}
    few = [c for c in names if sizes[c] <= MAX_CASES]
    known: dict[str, list[str]] = {c: [] for c in few}
    for r in categories.filter(F.col("column").isin(few)).orderBy("column", "value").collect():
        known[r["column"]].append(r["value"])
    out = []
    for c in df.columns:
        if c in known:
            code = F.lit(float(known[c].index(UNKNOWN)))
            table = F.create_map(*[F.lit(x) for i, v in enumerate(known[c]) for x in (v, float(i))])
            out.append(F.coalesce(F.try_element_at(table, _text(c)), code).alias(c))
        else:
            out.append((_text(c) if c in names else col(c)).alias(c))
    result = df.select(*out)
    for c in names:
        if c not in known:
            codes = dense_codes(categories.filter(F.col("column") == c).select("value"), ["value"])
            unknown = codes.filter(F.col("value") == UNKNOWN).first()["code"]
            result = _join_codes(result, codes, c, F.lit(float(unknown)))
    return result


def _join_codes(df: DataFrame, codes: DataFrame, name: str, default) -> DataFrame:
    """Swaps a column for its code: a broadcast join up to a checked size, else a shuffle join that adaptive execution
    splits at hot categories."""
    table = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    table = F.broadcast(table) if is_small(table, SMALL_TABLE) else table
    joined = df.join(table, col(name) == F.col("_value"), "left")
    return joined.select(*[F.coalesce(F.col("_code").cast("double"), default).alias(c) if c == name else col(c)
                           for c in df.columns])
