"""The stored vector index against all distances."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.operators import vectorindex

SCHEMA = "id long, embedding array<float>, tag string, cells int"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 5)) * 6
    x = (centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 5))).astype(np.float32)
    x[700] = x[3]
    return x


def frame(spark, x, ids):
    return spark.createDataFrame([(int(i), x[i].tolist(), "abc"[i % 3], 1) for i in ids], SCHEMA).repartition(3)


def plain(x, ids, queries, k, keep=lambda i: True):
    out = set()
    for q, v in queries:
        d = sorted((float(((x[i].astype(float) - v) ** 2).sum()), i) for i in ids if keep(i))[:k]
        out |= {(q, i, round(dist, 9), r + 1) for r, (dist, i) in enumerate(d)}
    return out


def found(df):
    return {(r["query"], r["id"], round(r["dist"], 9), r["rank"]) for r in df.collect()}


def test_search_equals_all_distances_and_rebuilding(spark, data, tmp_path):
    grown, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    vectorindex.build(frame(spark, data, range(600)), grown)
    files = {str(p) for p in (tmp_path / "grown" / "points").rglob("*.parquet")}
    vectorindex.append(frame(spark, data, range(600, 1490)), grown)
    vectorindex.append(frame(spark, data, range(1490, 1500)), grown)
    vectorindex.append(frame(spark, data, []), grown)
    assert files < {str(p) for p in (tmp_path / "grown" / "points").rglob("*.parquet")}
    vectorindex.build(frame(spark, data, range(1500)), whole)
    asked = [(q, data[q].astype(float) + 0.3) for q in range(0, 1500, 100)] + [(-1, np.full(5, 200.0)), (-2, data[3].astype(float))]
    queries = spark.createDataFrame([(q, v.tolist()) for q, v in asked], "query long, embedding array<double>")
    want = plain(data, range(1500), asked, 4)
    assert found(vectorindex.search(spark, grown, queries, 4)) == want == found(vectorindex.search(spark, whole, queries, 4))
    assert {r["id"] for r in vectorindex.rows(spark, grown).collect()} == set(range(1500))
    some = vectorindex.search(spark, grown, queries, 3, where=F.col("tag") == "b")
    assert found(some) == plain(data, range(1500), asked, 3, lambda i: i % 3 == 1) and some.columns == ["query", "id", "dist", "rank", "tag", "cells"]
    assert found(vectorindex.search(spark, grown, queries, 2, where=F.col("tag") == "z")) == set()
    assert len(found(vectorindex.search(spark, grown, queries, 2, where=F.col("id") == 5))) == len(asked)


def test_only_parts_with_near_cells_are_read(spark, data, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    vectorindex.build(frame(spark, data, range(1500)), path)
    read = []
    plain_only = vectorindex._Stored.only
    monkeypatch.setattr(vectorindex._Stored, "only", lambda self, cells: read.append(plain_only(self, cells)) or read[-1])
    query = spark.createDataFrame([(1, data[10].tolist())], "query long, embedding array<double>")
    assert vectorindex.search(spark, path, query, 3).count() == 3
    plans = [r._jdf.queryExecution().executedPlan().toString() for r in read]
    assert read and all(re.search(r"PartitionFilters: \[[^\]]*part#", p) for p in plans)
    files = [r.select(F.input_file_name()).distinct().count() for r in read]
    total = len(list((tmp_path / "index" / "points").rglob("*.parquet")))
    assert max(files) < total / 2


def test_first_of_every_tag(spark, data, tmp_path):
    path = str(tmp_path / "index")
    vectorindex.build(frame(spark, data, range(300)), path)
    query = spark.createDataFrame([(1, data[10].tolist()), (2, data[20].tolist())], "query long, embedding array<double>")
    out = vectorindex.search_distinct(spark, path, query, "tag", 2).collect()
    assert sorted((r["query"], r["rank"]) for r in out) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    for q in (10, 20):
        d = sorted((float(((data[i].astype(float) - data[q]) ** 2).sum()), i) for i in range(300))[:10]
        first = {}
        for dist, i in d:
            first.setdefault("abc"[i % 3], i)
        assert [r["id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query"] == q // 10] == list(first.values())[:2]


def test_rows_that_cannot_be_indexed(spark, tmp_path):
    with pytest.raises(ValueError):
        vectorindex.build(spark.createDataFrame([(1, None)], "id long, embedding array<double>"), str(tmp_path / "a"))
    with pytest.raises(ValueError):
        vectorindex.build(spark.createDataFrame([(1, [1.0], 2)], "id long, embedding array<double>, cell int"), str(tmp_path / "b"))
