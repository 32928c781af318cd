"""The driver contract on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 3 and all(0 <= r["acc"] <= 1 for r in rows)


@pytest.mark.parametrize("name", ["d2_median_imputer", "f5_quantile_transformer", "i10_scorecard", "j1_inter_arrival",
                                  "k3_gap_rate", "l19_feature_vector", "o8_best_runs", "c4_vector_search_many"])
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    df = contract.queries()[name](spark, SF)
    result = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted(str([row[names.index(c)] for c in df.columns]) for row in result.fetchall())
    assert sorted(str(list(r)) for r in df.collect()) == want
