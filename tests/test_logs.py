"""Chain logs, the catalogue, search tables and chain runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.functions.columns import Roles
from tableprep.operators import catalog, chains, logs, search
from tableprep.operators.metafeatures import FEATURES


def episodes(spark, seed=0, n=120, keys=3):
    rng = np.random.default_rng(seed)
    rows = [(k, i + 1, float(v)) for k in range(keys) for i, v in enumerate(rng.normal(size=n).cumsum() / 10)]
    return rows, spark.createDataFrame(rows, "k int, step int, acc double")


@pytest.mark.parametrize("block", [9, 13, 1000])
def test_plateau_hits(spark, block):
    rows, df = episodes(spark)
    want = set()
    for k in range(3):
        acc, last = [r[2] for r in rows if r[0] == k], None
        for i in range(9, len(acc)):
            slope = np.polyfit(range(10), acc[i - 9:i + 1], 1)[0]
            if slope <= 0.01 and (last is None or i - last >= 5):
                want.add((k, i + 1))
                last = i
    got = logs.plateau_hits(df, ["k"], block=block)
    assert got.count() == len(rows)
    assert {(r["k"], r["step"]) for r in got.filter("hit").collect()} == want


@pytest.mark.parametrize("block", [4, 1000])
def test_drop_alarms(spark, block):
    rows, df = episodes(spark, 1, 60)
    df = df.withColumn("acc", F.abs("acc"))
    want = {}
    for k in range(3):
        acc = [abs(r[2]) for r in rows if r[0] == k]
        for i in range(len(acc)):
            a, d = acc[:i + 1], np.diff(acc[:i + 1])
            alarm = 0
            if len(a) > 2:
                if a[-1] < a[-2] * 0.6:
                    alarm = 1
                elif d[-1] <= -0.001 and d[-2] <= -0.001:
                    alarm = 2
                elif len(d) >= 3 and d.mean() < 0:
                    alarm = 3
            want[k, i + 1] = alarm
    got = {(r["k"], r["step"]): r["alarm"] for r in logs.drop_alarms(df, ["k"], block).collect()}
    assert got == want


@pytest.mark.parametrize("block", [50, 1000])
def test_stagnation(spark, block):
    _, df = episodes(spark, 2)
    got = logs.stagnation_alarms(df.withColumn("gain", F.col("acc")), ["k"], 0.1, 40, block).toPandas()
    for _, g in got.sort_values("step").groupby("k"):
        top = g["gain"].rolling(40, min_periods=1).max()
        assert (g["alarm"] == ((g["step"] > 5) & (top < 0.1))).all()


def test_step_rewards(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 6, 0.6), (3, 25, 0.6)], "step int, op int, acc double")
    got = [r["reward"] for r in logs.step_rewards(df.withColumn("run", F.lit(1)), ["run"], 0.4, block=2).orderBy("step")
           .collect()]
    assert got == pytest.approx([0.1 / 0.400001, 0.1 / 0.500001, 5.0])


def test_weighted_rewards_for_errors(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 50.0, 2.0), (1, 2, 0.5, 60.0, 1.0)],
                               "run int, step int, downstream double, quality double, cost double")
    got = [r["reward"] for r in logs.weighted_rewards(df, ["run"], (1.0, 40.0), 1.0, 0.0, classifier=False)
           .orderBy("step").collect()]
    assert got == pytest.approx([1.0 + 0.25, 0.0 + 0.2])


def test_ngrams_and_rules(spark):
    runs = spark.createDataFrame([([1, 2, 3, 1, 2],), ([7],), ([1, 2],)], "ops array<int>")
    counts = logs.ngram_counts(runs)
    rows = {tuple(r["pattern"]): r["n"] for r in counts.collect()}
    assert rows[(1, 2)] == 3 and rows[(1, 2, 3)] == 1 and rows[(2, 3, 1, 2)] == 1 and len(rows) == 8
    rules = logs.next_step_rules(counts, [5, 1])
    assert {tuple(r["pattern"]) for r in rules.collect()} == {(1, 2), (1, 2, 3), (1, 2, 3, 1)}
    assert "3x  ImputerMeanPrim [1] > ImputerMedianPrim [2]" in logs.rules_text(rules, catalog.NAMES)
    assert logs.next_step_rules(counts, []).isEmpty()


def test_best_runs(spark):
    runs = spark.createDataFrame([("d", [1], 0.5), ("d", [1], 0.7), ("d", [2], 0.6), ("e", [3], 0.1)],
                                 "dataset string, ops array<int>, acc double")
    assert [tuple(r) for r in logs.best_runs(runs, keep=1).select("dataset", "acc").orderBy("dataset").collect()] == [
        ("d", 0.7), ("e", 0.1)]
    low = logs.leaderboard(runs, higher_is_better=False).orderBy("dataset").collect()
    assert [r["acc"] for r in low] == [0.5, 0.1]


@pytest.mark.parametrize("text,want", [
    ('```json\n{"suggested_pipeline": [3, "12"]}\n```', [3, 12]),
    ('```\n{"pipe": ["StandardScaler", "<blank>", "unheard"]}\n```', [9, 25, 25]),
    ("take [1,  2] or [3]", [1, 2]), ('{"other": [1]}', None), ("nothing", None), ("", None)])
def test_parse_chain(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(logs.parse_chain(F.col("t"))).first()[0] == want


def test_parse_and_normalize_weights(spark):
    df = spark.createDataFrame([('x {"1": 0.5, 2: 1.5, "1": 2} y',), ("none",)], "t string")
    rows = df.select(logs.parse_weights(F.col("t")).alias("w")).select(
        "w", logs.normalize_weights(F.col("w")).alias("n"), logs.normalize_weights(F.col("w"), F.lit([2])).alias("m"))
    first, second = rows.collect()
    assert first["w"] == {1: 2.0, 2: 1.5}
    assert first["n"] == pytest.approx({1: 4 / 7, 2: 3 / 7}) and first["m"] == {1: 0.0, 2: 1.0}
    assert second["w"] == {} and second["n"] is None


def test_values_and_greedy_chains(spark):
    moves = spark.createDataFrame([(0, 1, 1, 1.0), (0, 1, 1, 0.0), (1, 2, 2, 2.0), (2, 25, 25, 5.0), (3, 3, 3, 1.0),
                                   (4, 0, 0, -9.0)], "state int, action int, next_state int, reward double")
    values = logs.transition_values(moves, sweeps=6)
    q = {(r["state"], r["action"]): r["q"] for r in values.collect()}
    assert q[2, 25] == 5 and q[1, 2] == pytest.approx(2 + 0.9 * 5) and q[0, 1] == pytest.approx(0.5 + 0.9 * 6.5)
    got = {r["start"]: r["ops"] for r in logs.greedy_chains(values).collect()}
    assert got[0] == [0, 1, 2, 25] and got[3] == [3] * 9 + [25] and got[4] == [4, 25]


@pytest.mark.parametrize("ops,valid,per_category", [
    ([0, 1, 4, 6, 25], True, False), ([0, 5, 9, 25], True, True), ([6, 6], False, False), ([25, 1], False, False),
    ([1, 2], False, False), ([17, 22], False, False), ([25], True, True), ([], True, True)])
def test_valid_chain(spark, ops, valid, per_category):
    row = spark.createDataFrame([(ops,)], "ops array<int>").select(
        catalog.valid_chain(F.col("ops")), catalog.valid_chain(F.col("ops"), True)).first()
    assert tuple(row) == (valid, per_category)


def test_catalog(spark):
    assert catalog.DONE == 25 == len(chains.OPERATORS)
    assert catalog.allowed_next(2, [0, 1, 2, 3, 4]) == [0, 4] and catalog.allowed_next(25, [1]) == [1]
    assert catalog.catalog_table(spark).count() == 26
    assert "6. MinMaxScalerPrim" in catalog.describe_operators([6, 25])


def test_rules(spark):
    zero = dict.fromkeys(FEATURES, 0.0)
    rules = spark.createDataFrame([{**zero, "operator_id": "3|7|25"}, {**zero, "num_cols": 9.0, "operator_id": "1|25"}])
    assert search.nearest_rule(rules, [0.1] * 17) == [3, 7, 25]
    assert search.nearest_rule(rules.limit(0), [0.0] * 17, 3) == [-1, -1, -1]
    with pytest.raises(ValueError):
        search.nearest_rules(rules, [1.0])
    assert search.append_rules(rules, rules).count() == 2


def test_fingerprints(spark):
    rows = spark.createDataFrame([("a", {"z": 'q"', "b": "1"}), ("a", {"b": "1", "z": 'q"'}), ("b", {})],
                                 "text string, meta map<string,string>")
    import hashlib
    import json

    got = [r[0] for r in rows.select(search.fingerprint(F.col("text"), F.col("meta"))).collect()]
    want = [hashlib.md5(f"{t}||META||{json.dumps(m, sort_keys=True)}".encode()).hexdigest()
            for t, m in (("a", {"z": 'q"', "b": "1"}), ("b", {}))]
    assert got == [want[0], want[0], want[1]]
    known = spark.createDataFrame([(want[1],)], "fingerprint string")
    assert [r["text"] for r in search.append_unseen(known, rows).collect()] == ["a"]


def test_text_search(spark):
    rows = spark.createDataFrame([(1, "hello world"), (2, "good weather today"), (2, "hello you"), (3, "hi")],
                                 "id int, text string")
    assert search.search_text(rows, "hello world", 1).first()["id"] == 1
    assert sorted(r["id"] for r in search.search_text(rows, "hello", 3, dedup=True).collect()) == [1, 2, 3]


@pytest.fixture(scope="module")
def dataset(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    rows = [(i, float(a) * 1000 if i % 9 else None, float(b), "u" if a + b > 0.5 else "v",
             "yes" if a + b > 0 else "no", "train" if i < 240 else "test") for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "k int, x double, y double, s string, label string, split string")


def test_every_operator_runs_in_a_chain(dataset):
    roles = Roles(keys=("k",))
    for op, operator in enumerate(chains.OPERATORS):
        out = operator(dataset, roles)
        assert out.count() == 300 and {"k", "label", "split"} <= set(out.columns), catalog.NAMES[op]


def test_chain_runner(spark, dataset):
    runner = chains.ChainRunner(dataset, Roles(keys=("k",)), keep=1)
    scores = runner.step_scores([1, 5, 9, 25])
    assert len(scores) == 4 and scores[2] > 0.9
    assert runner.score([1, 5, 9])["acc"] == scores[-1]
    assert runner.score([0, 1], with_quality=True)["quality"] >= runner.baseline()["quality"]
    best = runner.search(chains.grid_chains(spark, [[None, 1], [5]])).first()
    assert best["ops"][-1] == 25 and best["acc"] >= 0.9
    runner.close()


def test_projections_of_a_persisted_frame_are_not_persisted(dataset):
    def persisted(runner):
        return {key for key, frame in runner._frames.items() if frame.storageLevel.useMemory}

    rows = dataset.where("k >= 0").persist()
    runner, plain = (chains.ChainRunner(df, Roles(keys=("k",))) for df in (rows, dataset))
    assert runner.step_scores([1, 5, 9, 14]) == plain.step_scores([1, 5, 9, 14])
    assert persisted(runner) == {(1, 5, 9, 14)} and persisted(plain) == {(1,), (1, 5, 9, 14)}
    assert len(runner._frames) == len(plain._frames) == 4
    runner.close()
    assert rows.storageLevel.useMemory
    plain.close()
    rows.unpersist()


def test_random_chains(spark):
    found = chains.random_chains(spark, 20, seed=1)
    assert found and found == chains.random_chains(spark, 20, seed=1) and all(c[-1] == 25 for c in found)


def test_sample_rows(dataset):
    roles = Roles(keys=("k",))
    counts = {r[0]: r[1] for r in chains.sample_rows(dataset, roles).groupBy("split").count().collect()}
    assert counts == {"train": 60, "test": 15}
    assert chains.sample_rows(dataset.repartition(7), roles).orderBy("k").collect() == chains.sample_rows(
        dataset, roles).orderBy("k").collect()
