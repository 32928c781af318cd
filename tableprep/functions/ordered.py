"""Order-dependent work on keys that may hold a large share of all rows.

A window partitioned by the key alone sorts all rows of that key in one task. Here each key is cut into blocks along the
order, the blocks are handled on their own, and only one short row per block is passed from block to block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tableprep.session import cut_lineage

ROWS_PER_BLOCK = 1_000_000


def time_block(df: DataFrame, ts: str, rows_per_block: int = ROWS_PER_BLOCK) -> Column:
    """Block number of a timestamp. Edges come from a sketch of the column, so a burst is cut finely; their
    number follows from the rows alone."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    blocks = -(-df.select(F.count(ts)).first()[0] // rows_per_block)
    if blocks <= 1:
        return F.lit(0).cast("long")
    cuts = df.select(F.percentile_approx(micros, [i / blocks for i in range(1, blocks)], max(10_000, 4 * blocks))).first()[0]
    edges = np.unique(np.array(cuts, dtype="int64"))

    @F.pandas_udf("long")
    def block(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, values.to_numpy(dtype="int64"), side="right"))

    return block(micros)


def _edges(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys, "_block").agg(*aggs)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str) -> DataFrame:
    """1-based position of each row within its key. `block` must not decrease along `order`."""
    df = df.withColumn("_block", block)
    edges = _edges(df, keys, F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(inside)).join(edges, [*keys, "_block"])
            .withColumn(name, F.col("_rn") + F.col("_before")).drop("_rn", "_before", "_block"))


def previous_in_order(df: DataFrame, keys: Sequence[str], value: str, block: Column, name: str) -> DataFrame:
    """Value of the previous row within the key, ordered by that value (such as a timestamp)."""
    df = df.withColumn("_block", block)
    edges = _edges(df, keys, F.max(value).alias("_last"))
    edges = edges.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block"))).drop("_last")
    inside = Window.partitionBy(*keys, "_block").orderBy(value)
    return (df.withColumn("_prev", F.lag(value).over(inside)).join(edges, [*keys, "_block"])
            .withColumn(name, F.coalesce("_prev", "_carry")).drop("_prev", "_carry", "_block"))


def overlapping_blocks(df: DataFrame, step: str, halo: int, size: int = ROWS_PER_BLOCK) -> DataFrame:
    """Cuts keys with gap-free step numbers into blocks that also hold the last `halo` rows of the block before.

    Adds `_block` and `_context` (true on the repeated rows). A window over (key, _block) whose frame reaches back at
    most `halo` rows is then exact on the rows that are not context.
    """
    if size < halo:
        raise ValueError(f"a block of {size} rows cannot lend {halo}")
    own = F.floor(F.col(step) / size)
    copies = F.when(F.col(step) >= (own + 1) * size - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return (df.withColumn("_own", own).withColumn("_block", F.explode(copies))
            .withColumn("_context", F.col("_block") != F.col("_own")).drop("_own"))


def drop_context(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_context")).drop("_block", "_context")


def running_sums(df: DataFrame, key: str, order: str, sums: Sequence[str]) -> DataFrame:
    """The rows with the sums of some columns over all rows up to each one in the order of `order`, as `upto_<name>`. The rows
    of a key are dealt over tasks by ranges of the order, which must not repeat within a key. For few
    keys: a row for every task and key is broadcast."""
    dealt = df.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id())
    placed = cut_lineage(dealt)  # numbers of partitions hold for written rows alone
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(key, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    parts = parts.select(key, "_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    near = placed.select("*", *[F.sum(c).over(inside).alias(f"upto_{c}") for c in sums])
    # one short row per task and key
    return near.join(F.broadcast(cut_lineage(parts)), [key, "_part"]).select(*df.columns, *[(F.col(f"upto_{c}") + F.col(f"_{c}")).alias(f"upto_{c}") for c in sums])
