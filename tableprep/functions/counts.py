"""Value counts, modes and sorted codes of many columns at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableprep.functions.columns import col
from tableprep.session import cut_lineage

SMALL_TABLE = 200_000  # most rows of a lookup table that is broadcast or ranked in one task


def value_counts(df: DataFrame, values: Sequence[str] | Mapping[str, Column], kind: str = "string") -> DataFrame:
    """(column, value, n) for every column, nulls included, in one shuffle of pre-aggregated counts."""
    exprs = values if isinstance(values, Mapping) else {c: col(c) for c in values}
    cells = F.array(*[F.struct(F.lit(name).alias("column"), x.cast(kind).alias("value")) for name, x in exprs.items()])
    return df.select(F.explode(cells).alias("s")).groupBy("s.column", "s.value").agg(F.count("*").alias("n"))


def modes(df: DataFrame, values: Mapping[str, Column], kind: str) -> dict:
    """Most frequent non-null value of each column, the smallest on ties; {column: (value, count)}."""
    if not values:
        return {}
    best = (value_counts(df, values, kind).filter("value is not null").groupBy("column")
            .agg(F.max("n").alias("top"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value")))
    return {r["column"]: (r["value"], r["top"]) for r in best.collect()}


def is_small(df: DataFrame, limit: int = SMALL_TABLE) -> bool:
    """True if `df` has at most `limit` rows; reads no more than limit + 1 of them."""
    return df.limit(limit + 1).count() <= limit


def dense_codes(distinct: DataFrame, order: Sequence[str], name: str = "code") -> DataFrame:
    """Adds 0-based positions of already distinct rows in the given order.

    A short table is numbered in one task. A long one is range-partitioned; its partitions are numbered on their own
    and shifted by the sizes of the earlier ones.
    """
    distinct = cut_lineage(distinct)  # found once, then counted, numbered and joined
    if is_small(distinct):
        return distinct.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    parts = cut_lineage(distinct.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    shift, total = [], 0
    for r in parts.groupBy("_part").count().orderBy("_part").collect():
        shift.append((r["_part"], total))
        total += r["count"]
    edges = distinct.sparkSession.createDataFrame(shift, "_part int, _shift long")
    order_in_part = Window.partitionBy("_part").orderBy(*order)
    return (parts.join(F.broadcast(edges), "_part")
            .withColumn(name, F.row_number().over(order_in_part) - 1 + F.col("_shift")).drop("_part", "_shift"))


def lookup(df: DataFrame, table: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Joins a lookup table by one key: broadcast when its size is checked to be small, else a shuffle join that
    adaptive execution splits where one key is hot."""
    return df.join(F.broadcast(table) if is_small(table) else table, on, how)
