"""The pipeline against plain versions, and the registered queries against their SQL."""

import os

import plain
import pytest

import corpus_pipeline
from tableprep.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_stages_on_their_own_input(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "n-gram join", "decontamination", "pieces"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        after = {r["doc_id"]: r for r in out.collect()}
        texts = [(d, r["text"]) for d, r in before.items()]
        if name == "toxicity":
            scores = {r["doc_id"]: r["predicted"] for r in queries.op10_toxicity(spark, SF).collect()}
            assert set(after) == {d for d in before if not scores[d]}
        elif name == "line dedup":
            left = plain.dedup_lines(texts)
            want = {d: t for d, t in left.items() if t == before[d]["text"] or t.replace("\n", "").strip(" ")}
            assert {d: r["text"] for d, r in after.items()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "n-gram join":
            assert set(after) == {d for d, _, c in plain.classes(texts) if d == c}
        else:
            assert set(after) == set(before) - {d for d, _ in plain.leaks(texts, bench)}
        assert len(after) >= 0.4 * len(before)
        docs = spark.createDataFrame(list(after.values()), docs.schema)
    final = {r["doc_id"]: r["pieces"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert final == {r["doc_id"]: library.encode(r["text"]) for r in docs.collect()}
    whole = {r["doc_id"]: r["pieces"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == final


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([row[names.index(c)] for c in df.columns]) for row in result.fetchall())
    assert sorted(str(list(r)) for r in df.collect()) == want


def test_registered_queries():
    assert len(queries.QUERIES) == 13 and {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
