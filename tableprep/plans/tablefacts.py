"""Table meta-features and descriptions."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tableprep.functions.columns import one_row, small_frame
from tableprep.operators import describe, metafeatures, profile
from tableprep.plans.registry import half_up, query, table
from tableprep.plans.tables import GAPS, gaps

NUMERIC = ["part", "quantity", "price", "discount", "tax"]
TEXT = ["flag", "status"]
ALL = [*NUMERIC, *TEXT, "shipdate"]
MISSING = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in ALL)
RATES = ", ".join(f"count(*) FILTER ({c} IS NULL)::DOUBLE / count(*)" for c in ALL)


def _mean(template: str, names=NUMERIC) -> str:
    return "((" + " + ".join(template.replace("$c", c) for c in names) + f") / {len(names)})"


def _relative(value: str) -> str:
    """Large numbers are compared on a scale near 1."""
    return f"round({value}, 6)"


PAIRS = list(itertools.combinations(NUMERIC, 2))
CORR = ", ".join(f"abs(corr({a}, {b})) AS c_{a}_{b}" for a, b in PAIRS)


def _pair(a: str, b: str) -> str:
    if a == b:
        return "1.0::DOUBLE"
    return f"c_{a}_{b}" if (a, b) in PAIRS else f"c_{b}_{a}"


MEAN_CORR = "((" + " + ".join(_pair(a, b) for a in NUMERIC for b in NUMERIC) + f") / {len(NUMERIC) ** 2})"
STD_CORR = "((" + " + ".join(
    "list_aggregate([" + ", ".join(_pair(a, b) for b in NUMERIC) + "], 'stddev_samp')" for a in NUMERIC
) + f") / {len(NUMERIC)})"


def _entropy(c: str) -> str:
    return (f"(SELECT -sum(p * log2(p)) FROM (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM gaps "
            f"WHERE {c} IS NOT NULL GROUP BY {c}))")


FORMULAS = {
    "l1_has_missing": (f"({MISSING}) > 0", metafeatures.has_missing),
    "l2_global_missing_rate": (f"({MISSING})::DOUBLE / (count(*) * {len(ALL)})", metafeatures.global_missing_rate),
    "l3_max_column_missing_rate": (f"greatest({RATES})", metafeatures.max_column_missing_rate),
    "l4_numeric_variance_mean": (_mean("var_samp($c)") + " / 1e9", metafeatures.numeric_variance_mean),
    "l5_categorical_entropy": (f"({_entropy('flag')} + {_entropy('status')}) / 2", metafeatures.df_categorical_entropy),
    "l7_num_rows": ("count(*)", metafeatures.num_rows),
    "l8_num_cols": (f"{len(ALL)}::BIGINT", metafeatures.num_cols),
    "l9_num_numeric_cols": (f"{len(NUMERIC)}::BIGINT", metafeatures.num_numeric_cols),
    "l10_num_categorical_cols": (f"{len(TEXT)}::BIGINT", metafeatures.num_categorical_cols),
    "l11_categorical_cardinality_mean": ("(count(DISTINCT flag) + count(DISTINCT status)) / 2.0::DOUBLE",
                                         metafeatures.categorical_cardinality_mean),
    "l13_numeric_mean_of_means": (_mean("avg($c)"), metafeatures.numeric_mean_of_means),
    "l14_numeric_mean_of_stds": (_mean("stddev_samp($c)"), metafeatures.numeric_mean_of_stds),
    "l15_numeric_mean_of_skew": (_mean("skewness($c)"), metafeatures.numeric_mean_of_skew),
    "l16_mean_unique_values": ("(count(DISTINCT flag) + count(DISTINCT status)) / 2.0::DOUBLE",
                               metafeatures.mean_unique_values),
}
INTEGERS = ("l7_num_rows", "l8_num_cols", "l9_num_numeric_cols", "l10_num_categorical_cols")
SCHEMA_ONLY = {"l8_num_cols": ALL, "l9_num_numeric_cols": NUMERIC, "l10_num_categorical_cols": TEXT}


def _add(name: str, formula: str, function) -> None:
    value = formula if name in INTEGERS or name == "l1_has_missing" else f"round({formula}, 6)"
    # one row even where the formula has no aggregate
    source = "(SELECT 1)" if "count" not in formula and "(" in formula and "SELECT" in formula else "gaps"
    select = f"WITH {GAPS} SELECT DISTINCT {value} AS value FROM {source}"
    if name in SCHEMA_ONLY:
        cells = " + ".join(f"count({c})" for c in SCHEMA_ONLY[name])
        select = f"WITH {GAPS} SELECT {value} AS value, {cells} AS cells FROM gaps"

    @query(name, select)
    def run(spark, sf):
        rows = gaps(spark, sf)
        value = function(rows)
        if name == "l4_numeric_variance_mean":
            value /= 1e9
        value = half_up(value, 6) if isinstance(value, float) else value
        if name in SCHEMA_ONLY:  # the cells that the answer speaks of
            return rows.agg(F.lit(value).cast("long").alias("value"), sum(F.count(c) for c in SCHEMA_ONLY[name]).alias("cells"))
        return one_row(spark, value=value)


for _name, (_formula, _function) in FORMULAS.items():
    _add(_name, _formula, _function)


@query("l6_complexity", """SELECT CASE WHEN (1 + abs(corr(l_quantity, l_extendedprice))) / 2 >= 0.95 THEN 1.0 ELSE 2.0 END::DOUBLE AS apart,
  CASE WHEN (1 + abs(corr(l_quantity, l_quantity * 5 + l_discount))) / 2 >= 0.95 THEN 1.0 ELSE 2.0 END::DOUBLE AS alike,
  0.0::DOUBLE AS with_gaps FROM lineitem""")
def l6(spark, sf):
    """Of two columns with correlation r the components hold (1 + |r|) / 2 and (1 - |r|) / 2 of the variance."""
    rows, like = table(spark, sf, "lineitem"), (F.col("l_quantity") * 5 + F.col("l_discount")).alias("like")
    return one_row(spark, apart=metafeatures.df_complexity(rows.select("l_quantity", "l_extendedprice")),
                   alike=metafeatures.df_complexity(rows.select("l_quantity", like)),
                   with_gaps=metafeatures.df_complexity(gaps(spark, sf)))


@query("l12_duplicate_row_rate", """SELECT round(1 - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events))
  ::DOUBLE / count(*), 6) AS value FROM events""")
def l12(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type")
    return one_row(spark, value=half_up(metafeatures.duplicate_row_rate(rows), 6))


@query("l17_mean_absolute_correlation", f"WITH {GAPS}, c AS (SELECT {CORR} FROM gaps) SELECT round({MEAN_CORR}, 6) AS value FROM c")
def l17(spark, sf):
    return one_row(spark, value=half_up(metafeatures.mean_absolute_correlation(gaps(spark, sf)), 6))


@query("l18_correlation_std", f"WITH {GAPS}, c AS (SELECT {CORR} FROM gaps) SELECT round({STD_CORR}, 6) AS value FROM c")
def l18(spark, sf):
    return one_row(spark, value=half_up(metafeatures.correlation_std(gaps(spark, sf)), 6))


@query("l19_feature_vector", f"""WITH {GAPS}, c AS (SELECT {CORR} FROM gaps) SELECT 1.0::DOUBLE AS has_missing,
  round(({MISSING})::DOUBLE / (count(*) * {len(ALL)}), 6) AS global_missing_rate,
  round(greatest({RATES}), 6) AS max_column_missing_rate, round({_mean("var_samp($c)")} / 1e9, 6) AS numeric_variance_mean,
  (count(DISTINCT flag) + count(DISTINCT status)) / 2.0::DOUBLE AS categorical_cardinality_mean,
  round(1 - (SELECT count(*) FROM (SELECT DISTINCT * FROM gaps))::DOUBLE / count(*), 6) AS duplicate_row_rate,
  0.0::DOUBLE AS df_complexity, round(({_entropy('flag')} + {_entropy('status')}) / 2, 6) AS df_categorical_entropy,
  8.0::DOUBLE AS num_cols, 5.0::DOUBLE AS num_numeric_cols, round({_mean("avg($c)")}, 6) AS numeric_mean_of_means,
  round({_mean("stddev_samp($c)")}, 6) AS numeric_mean_of_stds, round({_mean("skewness($c)")}, 6) AS numeric_mean_of_skew,
  2.0::DOUBLE AS num_categorical_cols,
  (count(DISTINCT flag) + count(DISTINCT status)) / 2.0::DOUBLE AS mean_unique_values,
  (SELECT round({MEAN_CORR}, 6) FROM c) AS mean_absolute_correlation,
  (SELECT round({STD_CORR}, 6) FROM c) AS correlation_std FROM gaps""")
def l19(spark, sf):
    vector = metafeatures.all_features(gaps(spark, sf))
    vector["numeric_variance_mean"] /= 1e9
    return one_row(spark, **{k: half_up(v, 6) for k, v in vector.items()})


TYPES = {"part": "bigint", "quantity": "double", "price": "double", "discount": "double", "tax": "double",
         "flag": "string", "status": "string", "shipdate": "timestamp_ntz"}


@query("m1_shape", f"""WITH {GAPS}, t AS (SELECT unnest(['bigint', 'double', 'string', 'timestamp_ntz']) AS type,
  unnest([1, 4, 2, 1]::BIGINT[]) AS columns) SELECT type, columns, (SELECT count(*) FROM gaps) AS rows FROM t""")
def m1(spark, sf):
    facts = describe.shape(gaps(spark, sf))
    return small_frame(spark, ["type", "columns", "rows"],
                       [(t, n, facts["rows"]) for t, n in facts["dtype_counts"].items()])


@query("m2_column_types", """SELECT 'c_custkey' AS "column", 'numeric' AS kind UNION ALL SELECT 'c_nationkey', 'numeric'
  UNION ALL SELECT 'c_acctbal', 'numeric' UNION ALL SELECT 'c_name', CASE WHEN count(DISTINCT c_name) < 0.5 * count(c_name)
  AND count(DISTINCT c_name) < 100 THEN 'categorical' ELSE 'text' END FROM customer
  UNION ALL SELECT 'c_mktsegment', CASE WHEN count(DISTINCT c_mktsegment) < 0.5 * count(c_mktsegment)
  AND count(DISTINCT c_mktsegment) < 100 THEN 'categorical' ELSE 'text' END FROM customer
  UNION ALL SELECT 'o_orderdate', 'datetime'""")
def m2(spark, sf):
    kinds = {**describe.column_types(table(spark, sf, "customer")),
             **describe.column_types(table(spark, sf, "orders").select("o_orderdate"))}
    return small_frame(spark, ["column", "kind"], list(kinds.items()))


@query("m3_missing_report", f"WITH {GAPS}, t AS (SELECT {MISSING} AS total FROM gaps) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS missing, any_value(total) AS total,
  round(any_value(total)::DOUBLE / (count(*) * {len(ALL)}), 6) AS ratio FROM gaps, t"""
    for c in ("quantity", "discount", "flag")))
def m3(spark, sf):
    report = describe.missing_report(gaps(spark, sf))
    return small_frame(spark, ["column", "missing", "total", "ratio"],
                       [(c, k, report["total"], half_up(report["ratio"], 6)) for c, k in report["by_column"].items()])


@query("m4_numeric_stats", f"WITH {GAPS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(median({c}), 4) AS median,
  round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max,
  round(skewness({c}), 4) + 0.0 AS skew, round(count(DISTINCT {c})::DOUBLE / count({c}), 6) AS unique_ratio FROM gaps"""
    for c in NUMERIC))
def m4(spark, sf):
    stats = profile.numeric_stats(gaps(spark, sf), NUMERIC)
    names = ["mean", "median", "std", "min", "max", "skew"]
    return small_frame(spark, ["column", *names, "unique_ratio"], [
        (c, *[half_up(s[k], 4) + 0.0 for k in names], half_up(s["unique_ratio"], 6)) for c, s in stats.items()])


@query("m5_categorical_stats", f"WITH {GAPS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM gaps) AS unique_values, {c} AS top_value,
  count(*) AS top_freq, round((SELECT count(DISTINCT {c})::DOUBLE / count({c}) FROM gaps), 6) AS unique_ratio FROM gaps
  WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY row_number() OVER (ORDER BY count(*) DESC, {c}) = 1""" for c in TEXT))
def m5(spark, sf):
    rows = gaps(spark, sf)
    n, missing = profile.missing_counts(rows)
    stats = describe.categorical_stats(rows, TEXT, n, missing, profile.distinct_counts(rows, TEXT))
    return small_frame(spark, ["column", "unique_values", "top_value", "top_freq", "unique_ratio"], [
        (c, s["unique_values"], s["top_value"], s["top_freq"], half_up(s["unique_ratio"], 6)) for c, s in stats.items()])


@query("m6_correlated_pairs", """SELECT * FROM (SELECT 'quantity' AS a, 'charge' AS b,
  round(abs(corr(l_quantity, l_quantity * 3 + l_discount)), 6) AS r FROM lineitem
  UNION ALL SELECT 'quantity', 'price', round(abs(corr(l_quantity, l_extendedprice)), 6) FROM lineitem
  UNION ALL SELECT 'price', 'charge', round(abs(corr(l_extendedprice, l_quantity * 3 + l_discount)), 6) FROM lineitem)
  WHERE r > 0.8""")
def m6(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_quantity quantity", "l_extendedprice price",
                                                   "l_quantity * 3 + l_discount charge")
    return small_frame(spark, [], [(a, b, half_up(r, 6)) for a, b, r in describe.correlated_pairs(rows)],
                       "a string, b string, r double")


SHAPED = ["value", "root", "square"]
SHAPED_SQL = "x AS (SELECT value, sqrt(value) AS root, value * value AS square FROM events)"


def _shaped(spark, sf):
    return table(spark, sf, "events").selectExpr("value", "sqrt(value) root", "value * value square")


@query("m7_skewed_columns", f"WITH {SHAPED_SQL} SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", abs(skewness({c})) > 1 AS skewed FROM x""" for c in SHAPED) + ") WHERE skewed")
def m7(spark, sf):
    return small_frame(spark, [], [(c, True) for c in describe.skewed_columns(_shaped(spark, sf))],
                       "column string, skewed boolean")


@query("m8_outlier_columns", f"WITH {SHAPED_SQL} SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (round({c}, 9) < round(q1 - 1.5 * (q3 - q1), 9)
  OR round({c}, 9) > round(q3 + 1.5 * (q3 - q1), 9)) AS outliers, round(outliers::DOUBLE / count(*), 6) AS ratio
  FROM x, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM x)""" for c in SHAPED)
       + ") WHERE outliers > 0")
def m8(spark, sf):
    return small_frame(spark, [], [(c, k, half_up(r, 6)) for c, k, r in describe.outlier_columns(_shaped(spark, sf))],
                       "column string, outliers long, ratio double")


@query("m9_needs", f"""WITH {GAPS} SELECT ({MISSING}) > 0 AS imputation, max(price) > 10 * min(price)
  OR max(tax) > 10 * min(tax) AS scaling, count(DISTINCT flag) < 100 AS encoding, false AS outlier_treatment,
  greatest(abs(skewness(part)), abs(skewness(quantity)), abs(skewness(price)), abs(skewness(discount)),
  abs(skewness(tax))) > 1 AS normalization FROM gaps""")
def m9(spark, sf):
    return one_row(spark, **describe.describe_table(gaps(spark, sf))["needs"])


@query("m10_description", """WITH x AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  o_totalprice * o_totalprice * o_totalprice AS total FROM orders), q AS (SELECT quantile_cont(total, 0.25) AS a, quantile_cont(total, 0.75) AS b FROM x),
  s AS (SELECT count(*) AS n, count(*) - count(priority) AS e, count(*) FILTER (total < a - 1.5 * (b - a) OR total > b + 1.5 * (b - a)) AS o,
  abs(skewness(total)) > 1 AS skewed, max(total) > 10 * min(total) AS wide FROM x, q)
  SELECT '[orders] ' || n || ' rows x 2 columns; ' || e || ' empty cells (' || printf('%.2f', 100.0 * e / (2 * n)) || '% of all)' || chr(10) ||
  '  priority: categorical, empty in ' || e || ' rows' || chr(10) || '  total: numeric' || CASE WHEN o > 0 THEN ', ' || o ||
  ' values far from the quartiles (' || printf('%.2f', 100.0 * o / n) || '%)' ELSE '' END || CASE WHEN skewed THEN ', lopsided' ELSE '' END
  || chr(10) || 'calls for: ' || array_to_string(list_filter(['encoding', 'imputation', CASE WHEN skewed THEN 'normalization' END,
  CASE WHEN o > 0 THEN 'outlier treatment' END, CASE WHEN wide THEN 'scaling' END], lambda x: x IS NOT NULL), ', ') AS text FROM s""")
def m10(spark, sf):
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.when(key % 17 != 0, F.col("o_orderpriority")).alias("priority"),
                                             (price * price * price).alias("total"))
    return one_row(spark, text=describe.dataset_description("orders", rows))
