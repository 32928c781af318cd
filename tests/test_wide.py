"""Distinct sketches and correlations of wide tables."""

import numpy as np
import pandas as pd

from tableprep.functions import sketches, tiles
from tableprep.functions.moments import correlations
from tableprep.operators import describe, metafeatures, profile


def test_sketches_of_batches_unite(spark, tmp_path):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"few": rng.integers(0, 40, 20_000), "many": rng.integers(0, 9_000, 20_000), "x": rng.normal(size=20_000).round(3)})
    pdf["s"] = pdf["few"].map(lambda v: None if v == 3 else "" if v == 4 else f"v{v}")
    pdf.loc[::50, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    path = str(tmp_path / "sketches")
    sketches.add_batch(df.where("few < 10"), path)
    sketches.add_batch(df.where("few >= 10"), path)
    got = {r["column"]: r for r in sketches.estimates(sketches.stored(spark, path)).collect()}
    exact = profile.distinct_counts(df, df.columns)
    assert got["few"]["distinct"] == 40 and got["s"]["distinct"] == 39 and got["x"]["missing"] == 400 and got["s"]["rows"] == 20_000
    for c in df.columns:
        assert abs(got[c]["distinct"] - exact[c]) <= 4 * sketches.relative_error() * exact[c]
    plan = sketches.sketch_columns(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # rows are aggregated before anything is exploded
    empty = {r["column"]: (r["rows"], r["distinct"]) for r in sketches.estimates(sketches.sketch_columns(df.limit(0))).collect()}
    assert empty == {c: (0, 0) for c in df.columns}
    assert sketches.estimates(sketches.sketch_columns(df, [])).collect() == []


def table_of(df, names, **options):
    return {(r["first"], r["second"]): r["r"] for r in tiles.correlation_table(df, names, **options).collect()}


def test_tiles_match_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(tiles, "CELLS", 100)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(300, 11)) @ rng.normal(size=(11, 11)) + 1e4, columns=[f"c.{i}" for i in range(11)])
    pdf["c.3"] = 7.0
    pdf["c.5"] = pdf["c.4"] * 2
    pdf.loc[::3, "c.6"] = np.nan
    pdf.loc[pdf.index[:298], "c.7"] = np.nan
    pdf["c.8"] = np.nan
    df = spark.createDataFrame(pdf).repartition(4)
    for block in (3, 4, 100):
        got, want = table_of(df, list(pdf), block=block, diagonal=True), correlations(df, list(pdf), diagonal=True)
        assert got.keys() == want.keys()
        for pair, r in want.items():
            assert (got[pair] is None) == (r is None), pair
            assert r is None or abs(got[pair] - r) < 1e-9
    assert len(table_of(df, list(pdf), block=5)) == 55
    assert table_of(df, []) == {} and table_of(df, ["c.1"]) == {}


def test_numbers_from_the_table(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(200, 4)), columns=list("abcd"))
    pdf["d"] = pdf["a"] * 3 + pdf["b"] * 0.1
    df = spark.createDataFrame(pdf)
    matrix = pdf.corr().abs().to_numpy()
    assert abs(metafeatures.mean_absolute_correlation(df) - matrix.mean()) < 1e-9
    assert abs(metafeatures.correlation_std(df) - matrix.std(axis=0, ddof=1).mean()) < 1e-9
    assert [p[:2] for p in describe.correlated_pairs(df)] == [("a", "d")]
    assert metafeatures.mean_absolute_correlation(df.select("a")) == 0 and describe.correlated_pairs(df.select("a")) == []


def test_many_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 700))
    names = [f"c{i}" for i in range(700)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names))
    out = tiles.correlation_table(df, names)
    want = np.corrcoef(x.T)
    some = {(r["first"], r["second"]): r["r"] for r in out.where("second = 'c699'").collect()}
    assert out.count() == 700 * 699 // 2
    assert all(abs(some[f"c{i}", "c699"] - want[i, 699]) < 1e-9 for i in range(699))
