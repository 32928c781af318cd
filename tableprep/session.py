"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "tableprep", master: str | None = None, **conf) -> SparkSession:
    """Builds a session. On a cluster the submit settings win; `master` is for local runs only."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="tableprep-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes `df` to the cluster's shared checkpoint folder and returns the reloaded frame.

    The folder comes from `spark.checkpoint.dir`. Only a local master may fall back to a temporary folder:
    on a cluster a machine-local folder would be lost with its executor.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that end inside the block are removed as they end. Meant for writes of tables: what was
    written stays, so nobody reads the shuffles again. Queries that only start here are not touched."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Kept:
    """A frame written as a Parquet table in the checkpoint folder, for `with`: smaller than a checkpoint, and gone at the end."""

    def __init__(self, df: DataFrame):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{_checkpoint_folder(self.spark)}/table-{uuid.uuid4().hex}"
        with dropping_shuffles(self.spark):
            df.write.parquet(self.path)

    def __enter__(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def __exit__(self, *_) -> None:
        drop_folder(self.spark, self.path)
