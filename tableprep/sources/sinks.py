"""Table writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tableprep.functions.columns import Roles


def write_dataset(df: DataFrame, path: str, roles: Roles = Roles()) -> None:
    """Train and test rows in one folder each, so that later readers scan only the part they need."""
    df.write.mode("overwrite").partitionBy(roles.split).parquet(path)


def write_label_map(codes: DataFrame, path: str) -> None:
    codes.write.mode("overwrite").parquet(path)


def write_rules(rules: DataFrame, path: str) -> None:
    rules.write.mode("overwrite").option("header", True).csv(path)


def append_result(result: DataFrame, path: str) -> None:
    """Adds result rows to a log that any number of jobs append to."""
    result.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
