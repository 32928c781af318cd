"""A stored index over vectors: exact nearest rows of many queries, from the files of the cells they can lie in.

The index is a folder of Parquet tables. `pivots` holds the centres of the cells, drawn once; `points` the rows with their
cell and their distance to its centre, parted by ranges of cells and sorted by cell; `cells` one short row per batch and cell
with its row count and radius. Rows added later go to the cells that are there: new files in the parts they fall in, nothing
is written anew, and a search reads the widest radius of a cell. A search looks at the cell of each query first; the k-th
distance found there rules out all cells whose centre lies farther than that plus their radius, and only parts with a cell
that is left are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tableprep.functions.columns import col
from tableprep.functions.nearest import _Cells, assign, draw_pivots, nearest_in
from tableprep.operators.search import DEDUP_FACTOR

PARTS = 256   # folders of the points at most
NAMED = 200   # cells up to which they are named to the scan


def _part(cells: int) -> Column:
    return F.floor(F.col("cell") * min(PARTS, cells) / cells).cast("int")


def _points(df: DataFrame, vector: str, key: str) -> DataFrame:
    """(id, vec, other columns) of the rows with a vector."""
    taken = {"id", "vec", "cell", "near", "part"}
    others = [c for c in df.columns if c not in (vector, key)]
    if taken & set(others):
        raise ValueError(f"columns of an indexed table cannot be called {sorted(taken & set(others))}")
    return df.where(col(vector).isNotNull()).select(col(key).alias("id"), col(vector).cast("array<double>").alias("vec"), *[col(c) for c in others])


def _pivots(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()
    return np.array([r["vec"] for r in rows], dtype=float)


def _store(points: DataFrame, pivots: np.ndarray, path: str) -> None:
    placed = assign(points, pivots).withColumn("part", _part(len(pivots)))
    folder = f"{path}/points"
    before = _batches(points.sparkSession, path)
    batch = len(before)
    placed.repartitionByRange("part", "cell", F.xxhash64("id")).sortWithinPartitions("part", "cell").withColumn(
        "batch", F.lit(batch)).write.mode("append").partitionBy("batch", "part").parquet(folder)
    new = points.sparkSession.read.schema(_schema(points)).parquet(folder).where(F.col("batch") == batch)
    new.groupBy("cell").agg(F.count("*").alias("n"), F.max("near").alias("reach")).withColumn("batch", F.lit(batch)).coalesce(1).write.mode(
        "append").parquet(f"{path}/cells")
    points.limit(0).write.mode("append").parquet(f"{path}/shape")


def _batches(spark: SparkSession, path: str) -> list[int]:
    try:
        return sorted(r[0] for r in spark.read.parquet(f"{path}/cells").select("batch").distinct().collect())
    except Exception as missing:  # the first batch
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return []


def _schema(points: DataFrame) -> str:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return f"{fields}, cell int, near double, batch int, part int"


def build(df: DataFrame, path: str, vector: str = "embedding", key: str = "id") -> None:
    """Writes an index of all rows with a vector (all of one length) to the new folder `path`, with all their columns. At least
    one row is needed, since the cells are drawn from the rows."""
    points = _points(df, vector, key)
    pivots = draw_pivots(points, points.count())
    if not pivots:
        raise ValueError("an index needs at least one vector")
    df.sparkSession.createDataFrame(list(enumerate(pivots)), "cell int, vec array<double>").coalesce(1).write.parquet(f"{path}/pivots")
    _store(points, np.array(pivots, dtype=float), path)


def append(df: DataFrame, path: str, vector: str = "embedding", key: str = "id") -> None:
    """Adds rows, with the same columns, to the cells of a stored index."""
    points = _points(df, vector, key)
    if not points.isEmpty():
        _store(points, _pivots(df.sparkSession, path), path)


def rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of an index: id, vec and the other columns."""
    shape = spark.read.parquet(f"{path}/shape")
    return spark.read.schema(_schema(shape)).parquet(f"{path}/points").select(*shape.columns)


class _Stored(_Cells):
    """The cells of an index; points are read part by part."""

    def __init__(self, spark: SparkSession, path: str, where: Column | None):
        shape = spark.read.parquet(f"{path}/shape")
        self.pivots = _pivots(spark, path)
        self.empty = not len(self.pivots)
        points = spark.read.schema(_schema(shape)).parquet(f"{path}/points")
        self.placed = points if where is None else points.where(where)
        if where is None:
            stats = spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.sum("n").alias("n"), F.max("reach").alias("r"))
        else:  # rows that pass the filter, counted without reading a vector
            stats = self.placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("near").alias("r"))
        found = stats.orderBy("cell").collect()
        self.empty = self.empty or not found
        self.used = np.array([s["cell"] for s in found], dtype="int32")
        self.size = np.array([s["n"] for s in found])
        self.reach = np.array([s["r"] for s in found])
        self.group = np.arange(len(found))  # a cell alone: what a query does not need is not read

    def only(self, cells: list[int]) -> DataFrame:
        count = len(self.pivots)
        parts = sorted({c * min(PARTS, count) // count for c in cells})
        wanted = self.placed.where(F.col("part").isin(parts))
        wanted = wanted.where(F.col("cell").isin(cells)) if len(cells) <= NAMED else wanted
        return wanted.drop("batch", "part")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, vector: str = "embedding", key: str = "id",
           query_key: str = "query", where: Column | None = None) -> DataFrame:
    """The k nearest rows of each query, as (query, key, dist, rank, other columns); dist is the squared distance, ties go to
    the smaller key. `where` filters the rows by their columns."""
    shape = spark.read.parquet(f"{path}/shape")
    asked = queries.select(col(query_key).alias("id"), col(vector).cast("array<double>").alias("vec"))
    hits = nearest_in(asked, _Stored(spark, path, where), shape, k)
    others = [c for c in shape.columns if c not in ("id", "vec")]
    return hits.select(F.col("qid").alias(query_key), F.col("id").alias(key), (F.col("dist") * F.col("dist")).alias("dist"), "rank", *others)


def search_distinct(spark: SparkSession, path: str, queries: DataFrame, by: str, k: int = 5, vector: str = "embedding", key: str = "id",
                    query_key: str = "query") -> DataFrame:
    """Of five times k hits of each query the nearest one for every value of the column `by`, k of them at most."""
    hits = search(spark, path, queries, k * DEDUP_FACTOR, vector, key, query_key)
    columns = F.struct(F.col("dist").alias("_d"), F.col("rank").alias("_r"), *[col(c) for c in hits.columns if c not in (query_key, by, "rank")])
    best = hits.groupBy(query_key, by).agg(F.min(columns).alias("hit"))
    listed = best.groupBy(query_key).agg(F.slice(F.array_sort(F.collect_list(F.struct("hit", by))), 1, k).alias("hits"))  # at most 5 k
    flat = listed.select(query_key, F.posexplode("hits").alias("i", "h")).select(query_key, F.col("h")[by].alias(by), "h.hit.*", (F.col("i") + 1).alias("rank"))
    return flat.drop("_d", "_r")
