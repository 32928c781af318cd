"""Values that once went wrong."""

import datetime
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableprep.functions.columns import Roles
from tableprep.functions.quantiles import exact_quantiles
from tableprep.operators import cleanup, events, features, quality, scale, search, split
from tableprep.operators.models import trees


@pytest.mark.parametrize("extra", [[math.inf], [-math.inf], [math.inf, -math.inf], [math.inf] * 6000, []])
def test_quantiles_with_infinities(spark, extra):
    values = [float(i) for i in range(5000)] + extra
    df = spark.createDataFrame(pd.DataFrame({"x": values, "same": [7.0] * len(values)}))
    found = exact_quantiles(df, ["x", "same"], [0.0, 0.5, 1.0])
    ranked = sorted(values)
    middle = (ranked[(len(ranked) - 1) // 2] + ranked[len(ranked) // 2]) / 2
    assert found["x"] == [ranked[0], middle, ranked[-1]] and found["same"] == [7.0] * 3


def test_quantiles_of_denormal_numbers(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [0.0] * 3000 + [5e-324] * 3000 + [1e-323] * 100}))
    assert exact_quantiles(df, ["x"], [0.1, 0.6, 1.0])["x"] == [0.0, 5e-324, 1e-323]


def test_timeliness_skips_missing_dates(spark):
    now = datetime.datetime(2024, 2, 1)
    old = spark.createDataFrame([(datetime.datetime(2020, 1, 1),), (None,), (None,), (None,)], "d timestamp")
    assert quality.timeliness(old, now) == (3.0, 1)
    text = spark.createDataFrame([("01/15/2024",)] * 10, "d string")
    assert quality.timeliness(text, now) == (86.0, 10)


def test_dates_in_one_spelling(spark):
    df = spark.createDataFrame([("01/15/2024", "2024-01-15", "1/2/2024"), (None, "2024-01-16", "x")], "a string, b string, c string")
    out = cleanup.coerce(df)
    assert "a_DAY" in out.columns and "b_DAY" in out.columns and "c" in out.columns
    assert sorted(r["a_DAY"] or 0 for r in out.collect()) == [0, 15.0]


def test_tiny_outliers(spark):
    df = spark.createDataFrame([(i % 10 * 1e-12,) for i in range(100)] + [(1e-10,)] * 3, "x double")
    assert quality.iqr_outliers(df) == 3 and quality.iqr_outliers(df, independent=True) == 3


def test_power_beyond_the_usual_range(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [1 - (i / 3000) ** 4 * 0.05 for i in range(1, 3000)]})).repartition(7)
    lam = scale.fit_power(df, {"x": F.col("x")})["x"][0]
    assert lam > 10


@pytest.mark.parametrize("keys", [[2 ** 53 + i for i in range(10)], [datetime.date(2024, 1, 1 + i) for i in range(10)], [chr(97 + i) for i in range(10)]])
def test_tail_split_by_any_key(spark, keys):
    out = split.tail_split(spark.createDataFrame([(k,) for k in keys[::-1]], ["k"]), "k")
    assert [r["split"] for r in out.orderBy("k").collect()] == ["train"] * 8 + ["test"] * 2


SCHEMA = {"type": "object", "properties": {
    "a": {"type": "object", "properties": {"b": {"type": "integer", "multipleOf": 3}}, "required": ["b"], "additionalProperties": False},
    "l": {"type": "array", "items": {"type": "integer", "exclusiveMinimum": 0}, "uniqueItems": True}, "e": {"enum": [7, "x", None, [1]]},
    "q'\"s": {"const": True}, "n": {"not": {"type": "string"}}, "o": {"oneOf": [{"minimum": 5}, {"maximum": 6}]}}}


@pytest.mark.parametrize("text,good", [
    ("{}", True), ('{"a": {"b": 9}}', True), ('{"a": {"b": 10}}', False), ('{"a": {}}', False), ('{"a": {"b": 3, "c": 1}}', False),
    ('{"l": [1, 2]}', True), ('{"l": [0]}', False), ('{"l": [1, 1]}', False), ('{"l": [1, "2"]}', False), ('{"e": 7}', True),
    ('{"e": "7"}', False), ('{"e": null}', True), ('{"e": [1]}', True), ('{"e": [2]}', False), ('{"q\'\\"s": true}', True),
    ('{"q\'\\"s": 1}', False), ('{"n": "s"}', False), ('{"n": 1}', True), ('{"o": 7}', True), ('{"o": 5.5}', False), ("[1]", False), ("nope", False)])
def test_nested_schema(spark, text, good):
    df = spark.createDataFrame([(text,)], "t string")
    assert events.check_schema(df, "t", SCHEMA)["failures"] == (not good)


def test_unknown_schema_words_raise(spark):
    df = spark.createDataFrame([("{}",)], "t string")
    for schema in ({"if": {}}, {"type": "float"}, {"properties": {"a": {"$ref": "#"}}}):
        with pytest.raises(ValueError):
            events.check_schema(df, "t", schema)
    assert events.required_fields(spark.createDataFrame([('{"it\'s": 1, "n": null}',)], "t string"), "t", ["it's", "n", "z"]) == {
        "records": 1, "missing": 2}


def test_fingerprints_without_metadata(spark):
    new = spark.createDataFrame([("a", None), ("b", None), ("a", {"k": "v"}), ("b", None)], "text string, meta map<string,string>")
    known = spark.createDataFrame([], "fingerprint string")
    added = search.append_unseen(known, new)
    assert added.count() == 3 and search.append_unseen(added, new).count() == 0
    assert search.append_unseen(added, new.select("text")).count() == 0


def test_rules_stay_unless_a_limit_is_given(spark):
    rules = spark.range(12_000).select(F.col("id").cast("string").alias("operator_id"))
    assert search.append_rules(rules, rules).count() == 12_000
    assert 10_500 < search.append_rules(rules, rules.limit(0), limit=10_000).count() < 11_100


def test_wide_tables_are_not_skipped(spark):
    names = [f"x{i}" for i in range(101)]
    df = spark.createDataFrame([(*range(101), "train"), (*range(1, 102), "train")], ", ".join(f"{n} int" for n in names) + ", split string")
    assert len(features.interaction_features(df, Roles()).columns) == 1 + 101 + 101 * 100 // 2
    with pytest.raises(ValueError):
        features.polynomial_features(df, Roles(), width=100)


def test_boosting_of_many_rounds(spark):
    rows = [(i, float(i % 40), float(i * 7 % 31), "train" if i % 5 else "test", ("a", "b", "c")[(i % 40 > 12) + (i % 40 > 30)]) for i in range(800)]
    df = spark.createDataFrame(rows, "k int, x double, y double, split string, label string")
    roles = Roles(keys=("k",))
    for model in (trees.ada_boost, trees.rus_boost, trees.easy_ensemble):
        out = model(df, roles, rounds=20)
        assert out.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] > 0.8
