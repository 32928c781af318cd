"""Table readers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tableprep.functions.columns import col

CORRUPT = "_corrupt_record"
INDEX = "Unnamed: 0"  # fixed value: heading of the row-number column that spreadsheet exports leave behind


def read_csv(spark: SparkSession, path, sep: str = ",", header: bool = True, schema: T.StructType | None = None,
             encoding: str = "ISO-8859-1") -> DataFrame:
    """CSV scan; malformed rows are dropped. Pass a schema for large files: inference reads them once more."""
    reader = (spark.read.option("sep", sep).option("header", header).option("encoding", encoding)
              .option("mode", "DROPMALFORMED"))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    # a blank first heading comes out as _c0; without a header line that is an ordinary column
    return drop_index_column(df.withColumnRenamed("_c0", INDEX) if header and df.columns[:1] == ["_c0"] else df)


def count_bad_rows(spark: SparkSession, path, schema: T.StructType, sep: str = ",", header: bool = True,
                   encoding: str = "ISO-8859-1") -> int:
    """How many rows `read_csv` would drop."""
    marked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = (spark.read.option("sep", sep).option("header", header).option("encoding", encoding)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(marked).csv(path))
    return rows.select(F.count_if(F.col(CORRUPT).isNotNull()), F.count(F.col(schema.names[0]))).first()[0]


def read_json(spark: SparkSession, path, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """JSON scan. `multi_line` reads a file that holds one array of objects; such a file is not splittable."""
    reader = spark.read.option("multiLine", multi_line)
    return drop_index_column((reader.schema(schema) if schema is not None else reader).json(path))


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return drop_index_column(spread_scan(spark.read.parquet(path)))


def spread_scan(df: DataFrame) -> DataFrame:
    """Spreads a scan that has fewer splits than the session has cores, as a file with one row group does.

    A large table has far more splits than cores and is left as it is: no shuffle is added there. Rows go round robin,
    so that no value of any column can gather in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """Stacks tables by column name; a column missing in one part is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv_files(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    return union_by_name([read_csv(spark, p, **options) for p in paths])


def drop_index_column(df: DataFrame) -> DataFrame:
    """Removes the unnamed row-number column that spreadsheet exports leave behind."""
    return df.drop(INDEX) if len(df.columns) > 1 else df


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def read_rules(spark: SparkSession, path: str, features: Sequence[str]) -> DataFrame:
    """Rule table saved by `write_rules`."""
    schema = T.StructType([*[T.StructField(f, T.DoubleType()) for f in features],
                           T.StructField("operator_id", T.StringType())])
    return spark.read.schema(schema).option("header", True).csv(path)
