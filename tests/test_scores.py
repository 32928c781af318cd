"""Quality, events, text, meta-features and descriptions: small cases against pandas and by hand."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableprep.operators import describe, events, metafeatures, profile, quality, textquality

NOW = datetime.datetime(2024, 1, 31)


@pytest.fixture
def table(spark):
    return spark.createDataFrame([("a", 1.0), ("", None), ("b c", float("nan")), (None, 4.0)], "s string, x double")


def test_completeness_and_validity(spark, table):
    assert quality.completeness(table) == pytest.approx(50.0)
    assert quality.validity(table) == pytest.approx(75.0)
    assert quality.completeness(table.limit(0)) == 100.0


def test_date_tests(spark):
    texts = ["2024-01-05", "01/02/2024", "2024年01月02日", "x 2024-01-05", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(quality.is_date_value(F.col("s"))).collect()]
    assert got == [True, True, True, False, False, False]


def test_timeliness(spark):
    df = spark.createDataFrame([("2024-01-30",), ("2024-01-21",), ("2020-01-01",)], "d string")
    score, late = quality.timeliness(df, NOW)
    assert late == 2 and score == pytest.approx((100 + 93 + 3) / 3)
    assert quality.timeliness(df.select(F.lit(1).alias("n")), NOW) == (0.0, 0)


def test_scorecard_uses_the_marker_column(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 30), 1.0)], "timestamp_column timestamp_ntz, x double")
    assert quality.scorecard(df, NOW)["timeliness"] == 100.0
    assert quality.scorecard(df.drop("timestamp_column"), NOW)["timeliness"] is None


def iqr_reference(pdf):
    data, count = pdf.fillna(0), 0
    for c in data.columns:
        q1, q3 = np.percentile(data[c], [25, 75])
        bad = (data[c] < q1 - 1.5 * (q3 - q1)) | (data[c] > q3 + 1.5 * (q3 - q1))
        count, data = count + bad.sum(), data[~bad]
    return count


def test_iqr_outliers_depend_on_column_order(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.exponential(size=500), "b": rng.exponential(size=500) ** 2, "c": rng.normal(size=500)})
    pdf.loc[::7, "c"] = np.nan
    pdf["b"] += pdf["a"] * 3
    df = spark.createDataFrame(pdf)
    assert quality.iqr_outliers(df) == iqr_reference(pdf)
    assert quality.iqr_outliers(df.select("b", "a", "c")) == iqr_reference(pdf[["b", "a", "c"]])
    assert quality.iqr_outliers(df.select(F.lit("x").alias("s"))) == 0


def test_kmeans_outliers(spark):
    values = [0.0] * 50 + [100.0] * 50 + [30.0]
    df = spark.createDataFrame([(v, "7") for v in values] + [(0.0, "x1")], "x double, s string")
    # x: the stray value; s: one cell that is no number
    assert quality.kmeans_outliers(df) == 2


def two_means_reference(x):
    x = np.sort(np.array(x, dtype=float))
    cuts = [i for i in range(1, len(x)) if x[i] > x[i - 1]]
    best = min(cuts, key=lambda i: (round(((x[:i] - x[:i].mean()) ** 2).sum() + ((x[i:] - x[i:].mean()) ** 2).sum(), 6), i), default=None)
    m = [x.mean()] * 2 if best is None else [x[:best].mean(), x[best:].mean()]
    d = np.minimum(abs(x - m[0]), abs(x - m[1]))
    return int((d > np.quantile(d, 0.95)).sum())


def test_kmeans_outliers_take_the_best_clusters(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.exponential(size=400), "b": rng.integers(0, 9, 400), "c": 1e6 + rng.normal(size=400), "flat": 5.0})
    df = spark.createDataFrame(pdf).repartition(4)
    assert quality.kmeans_outliers(df) == sum(two_means_reference(pdf[c]) for c in pdf)
    odd = spark.createDataFrame([(1.0, "3"), (float("inf"), "4"), (None, "5"), (2.0, "x"), (9.0, " 6 ")], "x double, s string")
    assert quality.kmeans_outliers(odd) == 1 + two_means_reference([1.0, 2.0, 9.0]) + two_means_reference([3.0, 4.0, 6.0])
    assert quality.kmeans_outliers(odd.limit(0)) == 0


def noise_reference(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = d.sum(axis=1) >= least
    return int((~core & ~(d & core).any(axis=1)).sum())


def test_vector_outliers(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(120, 3)), rng.uniform(-8, 8, size=(30, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    assert quality.vector_outliers(df, 0.8, 5, standardize=False) == noise_reference(x, 0.8, 5)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert quality.vector_outliers(df, 0.5, 5) == noise_reference(z, 0.5, 5)


def test_uniqueness_and_consistency(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1,), (2,), (9,), (10,)], "r int")
    assert quality.uniqueness(a, ["k"], b, ["r"]) == {"unique_rows": 75.0, "covered": 50.0}
    other = spark.createDataFrame([(1, "x"), (2, "n"), (3, None), (4, "w")], "k int, v string")
    assert quality.consistency(a.distinct(), other, ["k"]) == 50.0


def test_arrival_scores(spark):
    iat = spark.createDataFrame([("a", 10.0), ("a", 10.0), ("a", 12.0), ("b", 5.0), ("b", 50.0)], "id string, iat double")
    rows = {r["id"]: (r["mode"], r["deviation"]) for r in events.mode_deviation(iat, "id").collect()}
    assert rows == {"a": (10.0, pytest.approx(2 / 3)), "b": (5.0, 22.5)}
    assert events.regularity_by_key(iat, "id") == 0.5
    good, bad = 1 + 1 + (1 - 2 * 0.2) + (1 - 2 * 0.5), 2 * 4.0
    assert events.regularity(iat) == round(good / (4 + bad), 3)
    assert events.arrival_outliers(iat) == 0.8
    assert events.regularity(iat.limit(0)) is None


@pytest.mark.parametrize("rows_per_block", [3, 1_000_000])
def test_inter_arrival(spark, rows_per_block):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"u": np.where(rng.random(200) < 0.4, 0, rng.integers(1, 9, 200)),
                        "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 400, 200), unit="s")})
    got = events.inter_arrival(spark.createDataFrame(pdf), "u", "t", rows_per_block).toPandas()
    want = pdf.sort_values(["u", "t"])
    want["iat"] = want.groupby("u")["t"].diff().dt.total_seconds()
    want = want[want["iat"] > 0]
    assert sorted(map(tuple, got[["u", "iat"]].values)) == sorted(map(tuple, want[["u", "iat"]].values))


def test_json_checks(spark):
    docs = ['{"k": 5, "z": "a"}', '{"k": 5.5, "z": "a"}', '{"k": 5, "z": "a", "q": 1}', '{"k": null}', '[1]', 'nope',
            '{"k": 500, "z": "abcd"}']
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    schema = {"properties": {"k": {"type": "integer", "maximum": 100}, "z": {"type": ["string", "null"], "maxLength": 3}},
              "required": ["k", "z"], "additionalProperties": False}
    assert events.check_schema(df, "doc", schema) == {"records": 7, "failures": 6, "with_extra": 1, "missing_required": 1}
    assert events.required_fields(df, "doc", ["k", "z"]) == {"records": 7, "missing": 6}


def test_text_scores(spark):
    texts = ["short", "a" * 20, "b" * 600, "A cat sat on a mat. It was fat."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert textquality.length_score(df, "t") == 0.5
    ease = df.select(textquality.reading_ease(F.col("t"))).collect()
    assert ease[3][0] == pytest.approx(206.835 - 1.015 * (9 / 2) - 84.6 * (9 / 9))
    assert textquality.length_score(df.limit(0), "t") is None


def test_gap_rate(spark):
    texts = ["at 2024-01-01 23:55:00 x", "2024-01-02 00:04:59", "2024-01-02 00:04:59", "none", "2024-01-05 00:00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert textquality.gap_rate(df, "t") == pytest.approx(2 / 3)
    assert textquality.gap_rate(df.limit(1), "t") == 0.0


def test_features_match_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=80), "b": rng.exponential(size=80), "c": rng.integers(0, 5, 80) * 1.0,
                        "s": rng.choice(["x", "y", "z"], 80), "t": rng.choice(["u", "v"], 80)})
    df = spark.createDataFrame(pdf)
    got = metafeatures.all_features(df)
    numeric = pdf[["a", "b", "c"]]
    corr = numeric.corr().abs()
    entropy = [-sum(p * np.log2(p) for p in pdf[c].value_counts(normalize=True)) for c in "st"]
    want = {"numeric_variance_mean": numeric.var().mean(), "numeric_mean_of_means": numeric.mean().mean(),
            "numeric_mean_of_stds": numeric.std().mean(), "numeric_mean_of_skew": numeric.skew().mean(),
            "df_categorical_entropy": np.mean(entropy), "mean_unique_values": 2.5,
            "mean_absolute_correlation": corr.mean().mean(), "correlation_std": corr.std().mean(), "df_complexity": 3.0}
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k
    assert list(got) == metafeatures.FEATURES
    assert set(metafeatures.all_features(df.limit(0)).values()) == {0.0, 5.0}


def test_constant_columns_do_not_break_correlations(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2), (2.0, 5.0, 4), (3.0, 5.0, 7)], "a double, b double, c int")
    pdf = df.toPandas()
    assert metafeatures.mean_absolute_correlation(df) == pytest.approx(pdf.corr().abs().mean().mean())
    assert metafeatures.correlation_std(df) == pytest.approx(pdf.corr().abs().std().mean())


def test_profile(spark, table):
    rows = {r["column"]: r for r in profile.column_profile(table).collect()}
    assert (rows["x"]["missing"], rows["x"]["distinct"], rows["s"]["missing"], rows["s"]["distinct"]) == (2, 3, 1, 4)
    assert rows["s"]["skewness"] is None
    big = spark.createDataFrame([(2 ** 53,), (2 ** 53 + 1,)], "n long")
    assert profile.distinct_counts(big, ["n"]) == {"n": 2}


def test_description(spark):
    pdf = pd.DataFrame({"x": [1.0] * 30 + [500.0], "y": [2.0] * 30 + [990.0], "s": ["a", "b"] * 15 + [None]})
    report = describe.describe_table(spark.createDataFrame(pdf))
    assert report["column_types"] == {"x": "numeric", "y": "numeric", "s": "categorical"}
    assert report["outlier_columns"] == [("x", 1, pytest.approx(1 / 31)), ("y", 1, pytest.approx(1 / 31))]
    assert report["correlated_pairs"][0][:2] == ("x", "y") and report["skewed_columns"] == ["x", "y"]
    assert all(report["needs"].values())
    text = describe.description_text(report)
    assert "31 rows x 3 columns; 1 empty cells" in text and "s: categorical, empty in 1 rows" in text
    assert "x: numeric, 1 values far from the quartiles (3.23%), lopsided" in text and "x ~ y" in text
    assert "(2 further columns)" in describe.description_text(report, limit=1)
