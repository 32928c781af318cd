"""Registry of the queries on the test tables and of the SQL that checks them."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tableprep.sources.readers import spread_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; `sql` is the same result in DuckDB's SQL."""
    def add(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_scan(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder; a temporary one for a local master alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="tableprep-scratch-")
    return f"{root}/scratch-{uuid.uuid4().hex}"


def half_up(value: float, places: int = 6) -> float:
    """Rounds ties away from zero, as SQL does."""
    scaled = abs(value) * 10 ** places
    return math.copysign(math.floor(scaled + 0.5) / 10 ** places, value) + 0.0
