"""Readers, sinks, clean-up, splits and targets."""

import pytest
from pyspark.sql import functions as F, types as T

from tableprep.functions.columns import Roles
from tableprep.operators import cleanup, split
from tableprep.sources import readers, sinks

SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("s", T.StringType())])


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "out")


def test_csv_drops_bad_rows_and_counts_them(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("a;s\n1;caf\xe9\nx;bad\n3;ok\n".encode("latin-1"))
    rows = readers.read_csv(spark, str(path), sep=";", schema=SCHEMA).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1, "caf\xe9"), (3, "ok")]
    assert readers.count_bad_rows(spark, str(path), SCHEMA, sep=";") == 1


def test_csv_without_header_and_with_inference(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("1,2.5\n3,4.5\n")
    df = readers.read_csv(spark, str(path), header=False)
    assert df.columns == ["_c0", "_c1"] and tuple(df.agg(F.sum("_c0"), F.sum("_c1")).first()) == (4, 7.0)
    path.write_text(",b\n1,2.5\n3,4.5\n")  # a blank heading: the row numbers of a spreadsheet
    assert readers.read_csv(spark, str(path)).columns == ["b"]


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "array.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 2}\n')
    for name, multi in (("array.json", True), ("lines.json", False)):
        assert readers.read_json(spark, str(tmp_path / name), multi_line=multi).agg(F.sum("a")).first()[0] == 3


def test_csv_files_are_stacked_by_name(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "2.csv").write_text("b,a\n5,6\n")
    rows = readers.read_csv_files(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")]).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1, 2), (6, 5)]


def test_sinks(spark, folder):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "a int, split string")
    sinks.write_dataset(df, folder)
    assert spark.read.parquet(folder).filter("split = 'test'").collect()[0]["a"] == 2
    for _ in range(2):
        sinks.append_result(df, folder + "-log")
    assert spark.read.parquet(folder + "-log").count() == 4
    rules = spark.createDataFrame([(1.5, "3|7")], "f double, operator_id string")
    sinks.write_rules(rules, folder + "-rules")
    assert readers.read_rules(spark, folder + "-rules", ["f"]).collect() == rules.collect()


def test_spread_list(spark):
    df = spark.createDataFrame([([1, 2],), ([3],), (None,), ([4, 5, 6, 7],)], "v array<int>")
    out = cleanup.spread_list(df, "v")
    # lengths 1 1 2 4: the 90th percentile is 3.4
    assert out.columns == ["v_item1", "v_item2", "v_item3"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 2, None), (3, None, None), (None, None, None),
                                                               (4, 5, 6)], key=str)


def test_clean(spark):
    df = spark.createDataFrame([("1", "2024-03-05 06:30:00", "x"), (None, "2017-01-02", "2")],
                               "n string, d string, s string")
    row = cleanup.clean(df).filter("n = 1").first().asDict()
    assert row == {"n": 1.0, "d_TIMESTAMP": 226391400.0, "d_YEAR": 2024.0, "d_MONTH": 3.0, "d_DAY": 5.0,
                   "d_DAYOFWEEK": 1.0, "d_HOUR": 6.5, "s": "x"}


def test_hash_split_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    one = {r["k"]: r["split"] for r in split.hash_split(df.coalesce(1), ["k"]).collect()}
    many = {r["k"]: r["split"] for r in split.hash_split(df.repartition(9), ["k"]).collect()}
    assert one == many and 740 < sum(s == "train" for s in one.values()) < 860


def test_tail_split(spark):
    df = spark.range(11).select(F.col("id").alias("k"), F.lit("a").alias("y"))
    out = split.train_test_split(df, ["k"], "y", order="k")
    assert sorted(r["k"] for r in out.filter("split = 'test'").collect()) == [8, 9, 10]


def test_targets(spark):
    df = spark.createDataFrame([(0, "b", "train"), (1, None, "train"), (2, "a", "train"), (3, "b", "test"), (4, "z", "test")],
                               "k int, y string, split string")
    assert [r["code"] for r in split.factorize(df, "y", "k").orderBy("k").collect()] == [0, -1, 1, 0, 2]
    assert [r["code"] for r in split.encode_target(df, "y").orderBy("k").collect()] == [1, None, 0, 1, None]
    assert split.infer_task(df, "y") == "classification" and split.infer_task(df, None) == "clustering"
    assert split.infer_task(df, "k") == "regression"
    with pytest.warns(UserWarning):
        split.infer_task(df.filter("k = 0"), "y")


def test_split_by_target(spark):
    a = spark.createDataFrame([(1, "x", 0), (2, None, 0)], "f int, y string, only int")
    b = spark.createDataFrame([(7, 3)], "g int, f int")
    out = split.split_by_target([a, b], "y")
    assert out.columns == ["f", "y", "split"]
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "x", "train"), (2, None, "test"), (3, None, "test")]
    with pytest.raises(ValueError):
        split.check_single_target(["y", "y"], "y")


def test_one_class_summary(spark):
    df = spark.createDataFrame([(1.0, "a", "train", 0), (2.0, "b", "test", 0)], "x double, s string, split string, label int")
    assert split.split_summary(df, Roles()) == {"categorical_columns": 1, "numeric_columns": 1, "train_rows": 1,
                                                "test_rows": 1}
