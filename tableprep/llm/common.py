"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.session import drop_folder, dropping_shuffles


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column: Column) -> Column:
    """Lower-cases A-Z alone; `lower` would also change other letters."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """A new folder inside spark.checkpoint.dir. Only a local master without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="llm-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes `df` as Parquet in the shared checkpoint folder and reads it back. The shuffles behind it are
    removed, as the table stands for them."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    with dropping_shuffles(spark):
        df.write.parquet(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    table.written_to = folder
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that nothing lazy reads any more."""
    for table in tables:
        drop_folder(table.sparkSession, table.written_to)


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Marks `df` for broadcast if its counted rows stay below `most`; beyond that the planner joins by shuffle."""
    return F.broadcast(df) if rows <= most else df


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))
