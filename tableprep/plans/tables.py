"""Test inputs derived from the given tables, each as a frame and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tableprep.functions.columns import Roles
from tableprep.operators.split import hash_split
from tableprep.plans.registry import table

KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
ROLES = Roles(keys=KEYS)
NUMBERS = ["quantity", "price", "discount", "tax"]


def sql_bucket(*keys: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(keys)}, '42')), 1, 8) AS BIGINT) % 100"


def sql_split(*keys: str) -> str:
    return f"CASE WHEN {sql_bucket(*keys)} < 80 THEN 'train' ELSE 'test' END"


# Line items with missing numbers and categories, a category that only test rows have, and a split.
PREP = f"""prep0 AS (SELECT *, {sql_split(*KEYS)} AS split FROM lineitem),
prep AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_tax = 0.03 THEN NULL ELSE l_quantity END AS quantity,
  l_extendedprice AS price,
  CASE WHEN l_quantity = 7 THEN NULL ELSE l_discount END AS discount,
  l_tax AS tax,
  CASE WHEN l_discount = 0.04 THEN NULL WHEN split = 'test' AND l_quantity > 45 THEN 'X' ELSE l_returnflag END AS flag,
  l_linestatus AS label, split FROM prep0)"""


def prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hash_split(table(spark, sf_dir, "lineitem"), KEYS)
    return rows.select(
        *KEYS,
        F.when(F.col("l_tax") == 0.03, None).otherwise(F.col("l_quantity")).alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_quantity") == 7, None).otherwise(F.col("l_discount")).alias("discount"),
        F.col("l_tax").alias("tax"),
        F.when(F.col("l_discount") == 0.04, None)
        .when((F.col("split") == "test") & (F.col("l_quantity") > 45), "X").otherwise(F.col("l_returnflag"))
        .alias("flag"),
        F.col("l_linestatus").alias("label"), "split")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, and -0.0 turned into 0.0, for comparison."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), places) + 0.0).alias(f.name)
                       if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema])


# Line items as a table with defects, features only.
GAPS = """gaps AS (SELECT l_partkey AS part, CASE WHEN l_tax = 0.03 THEN NULL ELSE l_quantity END AS quantity,
  l_extendedprice AS price, CASE WHEN l_quantity = 7 THEN NULL ELSE l_discount END AS discount, l_tax AS tax,
  CASE WHEN l_discount = 0.04 THEN NULL WHEN l_discount = 0.06 THEN '' ELSE l_returnflag END AS flag,
  l_linestatus AS status, l_shipdate AS shipdate FROM lineitem)"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"),
        F.when(F.col("l_tax") == 0.03, None).otherwise(F.col("l_quantity")).alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_quantity") == 7, None).otherwise(F.col("l_discount")).alias("discount"),
        F.col("l_tax").alias("tax"),
        F.when(F.col("l_discount") == 0.04, None).when(F.col("l_discount") == 0.06, "")
        .otherwise(F.col("l_returnflag")).alias("flag"),
        F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("shipdate"))
