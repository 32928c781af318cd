"""Train/test splits, targets and the task they imply."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tableprep.functions.columns import Roles, categorical_columns, col, numeric_columns
from tableprep.functions.counts import dense_codes, lookup
from tableprep.session import cut_lineage
from tableprep.sources.readers import union_by_name

DEFAULT_SEED = 42


def hash_bucket(keys: Sequence[str], seed: int = DEFAULT_SEED) -> Column:
    """0..99 from an md5 of the keys: the same on every run and under any partitioning."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 100


def hash_split(df: DataFrame, keys: Sequence[str], train_percent: int = 80, seed: int = DEFAULT_SEED,
               name: str = "split") -> DataFrame:
    """Marks about `train_percent` of the rows as train. Needs no shuffle and no row order."""
    return df.withColumn(name, F.when(hash_bucket(keys, seed) < train_percent, "train").otherwise("test"))


def random_split(df: DataFrame, keys: Sequence[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """The 67/33 split of a single table."""
    return hash_split(df, keys, 67, seed)


def tail_split(df: DataFrame, order: str, train_percent: int = 80, name: str = "split") -> DataFrame:
    """Unshuffled split: the last rows in the order of a unique column (number, date or text) are test rows."""
    n = df.count()
    test_rows = -(-n * (100 - train_percent) // 100)
    if not n:
        return df.withColumn(name, F.lit("train"))
    if test_rows == n:
        return df.withColumn(name, F.lit("test"))
    # the key's own type decides: sorted in ranges, and only the range that holds the edge is numbered
    keys = cut_lineage(df.select(col(order).alias("k")).repartitionByRange("k").withColumn("part", F.spark_partition_id()))
    before = 0
    for part, rows in sorted(keys.groupBy("part").count().collect()):
        if before + rows >= n - test_rows:
            break
        before += rows
    place = Window.orderBy("k")  # one range
    edge = keys.filter(F.col("part") == part).select("k", F.row_number().over(place).alias("n")).filter(
        F.col("n") == n - test_rows - before).select("k").scalar()
    first = F.coalesce(col(order) <= edge, col(order).isNull())  # missing keys sort first
    return df.withColumn(name, F.when(first, "train").otherwise("test"))


def check_single_target(names: Sequence[str], target: str) -> None:
    found = sum(n == target for n in names)
    if found > 1:
        raise ValueError(f"target {target!r} occurs {found} times")
    if not found:
        raise ValueError(f"no column named {target!r}")


def split_by_target(parts: Sequence[DataFrame], target: str, name: str = "split") -> DataFrame:
    """Tables with and without a target in one frame. Rows that know their target are train rows.

    Columns are the sorted names that all parts share, plus the target.
    """
    with_target = [p for p in parts if target in p.columns]
    if not with_target:
        raise ValueError(f"no column named {target!r}")
    shared = align_columns(parts, target)
    kind = with_target[0].schema[target].dataType
    marked = []
    for p in parts:
        y = col(target) if target in p.columns else F.lit(None).cast(kind)
        marked.append(p.select(*[col(c) for c in shared], y.alias(target),
                               F.when(y.isNotNull(), "train").otherwise("test").alias(name)))
    return union_by_name(marked)


def align_columns(parts: Sequence[DataFrame], target: str | None = None) -> list[str]:
    """Sorted names that occur in every part, the target left out."""
    return sorted(set.intersection(*[set(p.columns) for p in parts]) - {target})


def train_test_split(df: DataFrame, keys: Sequence[str], target: str | None = None, to_drop: Sequence[str] = (),
                     seed: int = DEFAULT_SEED, order: str | None = None) -> DataFrame:
    """80/20 split with a `label` column. The target is the last column unless named; `order` turns shuffling off."""
    df = df.drop(*to_drop)
    target = df.columns[-1] if target is None else target
    check_single_target(df.columns, target)
    df = df.withColumnRenamed(target, "label")
    return tail_split(df, order) if order else hash_split(df, keys, 80, seed)


def factorize(df: DataFrame, target: str, order: str, name: str = "code") -> DataFrame:
    """Codes by first appearance in the order of a unique column; null becomes -1."""
    firsts = df.filter(col(target).isNotNull()).groupBy(target).agg(F.min(order).alias("_first"))
    codes = dense_codes(firsts, ["_first"], name).select(target, name)
    return lookup(df, codes, target).withColumn(name, F.coalesce(name, F.lit(-1).cast("long")))


def label_codes(df: DataFrame, target: str, roles: Roles = Roles()) -> DataFrame:
    """(target, code) of the train rows, codes in sorted order."""
    return dense_codes(roles.train(df).filter(col(target).isNotNull()).select(target).distinct(), [target])


def encode_target(df: DataFrame, target: str, roles: Roles = Roles(), name: str = "code") -> DataFrame:
    """Sorted integer codes fitted on the train rows; a label unseen there gets null."""
    return lookup(df, label_codes(df, target, roles).withColumnRenamed("code", name), target)


def infer_task(df: DataFrame, target: str | None, roles: Roles = Roles()) -> str:
    """clustering without a target; classification for text or at most two values; else regression."""
    if target is None:
        return "clustering"
    distinct = roles.train(df).select(target).dropna().distinct().limit(3).count()
    if distinct == 1:
        warnings.warn(f"target {target!r} has a single class")
    if distinct <= 2 or isinstance(df.schema[target].dataType, T.StringType):
        return "classification"
    return "regression"


def clustering_input(df: DataFrame) -> DataFrame:
    """What is kept when there is no target: the numeric columns."""
    return df.select(*numeric_columns(df))


def split_summary(df: DataFrame, roles: Roles = Roles()) -> dict:
    """Column kinds and row counts of a split dataset; one aggregation."""
    features = roles.features(df)
    train, test = df.agg(F.count_if(col(roles.split) == "train"), F.count_if(col(roles.split) == "test")).first()
    return {"categorical_columns": len(categorical_columns(df, features)),
            "numeric_columns": len(numeric_columns(df, features)), "train_rows": train, "test_rows": test}


def target_counts(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    return roles.train(df).groupBy(col(roles.label).alias("label")).agg(F.count("*").alias("n"))
