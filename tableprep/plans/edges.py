"""The same operators on values that are easy to get wrong: infinities, tiny and huge numbers, other spellings, nulls."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tableprep.functions.columns import one_row
from tableprep.functions.quantiles import exact_quantiles
from tableprep.operators import cleanup, describe, events, quality, scale, search, split
from tableprep.plans.registry import half_up, query, scratch, table
from tableprep.plans.scores import LAG, NOW
from tableprep.sources import readers

INFINITE = """w AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN 'inf'::DOUBLE WHEN l_orderkey % 89 = 0
  THEN '-inf'::DOUBLE ELSE l_extendedprice END AS price, CASE WHEN l_orderkey % 2 = 0 THEN 'inf'::DOUBLE ELSE l_quantity END
  AS quantity, 1.0::DOUBLE AS same FROM lineitem)"""


def _infinite(spark, sf):
    key = F.col("l_orderkey")
    return table(spark, sf, "lineitem").select(
        F.when(key % 97 == 0, F.lit(math.inf)).when(key % 89 == 0, F.lit(-math.inf)).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(key % 2 == 0, F.lit(math.inf)).otherwise(F.col("l_quantity")).alias("quantity"), F.lit(1.0).alias("same"))


@query("m8_outliers_among_infinities", f"""WITH {INFINITE}, q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b
  FROM w) SELECT 'price' AS "column", count(*) AS outliers FROM w, q WHERE price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a)""")
def m8_infinite(spark, sf):
    found = [(c, n) for c, n, _ in describe.outlier_columns(_infinite(spark, sf).select("price", "same"))]
    return spark.createDataFrame(found, "column string, outliers long")


@query("d2_quantiles_among_infinities", f"""WITH {INFINITE} SELECT round(quantile_disc(price, 0.5), 2) AS price, quantile_disc(quantity, 0.99) = 'inf'::DOUBLE AS infinite,
  quantile_disc(same, 0.5) AS same FROM w""")
def d2_infinite(spark, sf):
    rows = _infinite(spark, sf)
    n = rows.count()
    at = lambda share: (math.ceil(share * n) - 1) / max(n - 1, 1)  # noqa: E731  the rank that quantile_disc takes
    found = exact_quantiles(rows, rows.columns, [at(0.5), at(0.99)])
    return one_row(spark, price=half_up(found["price"][0], 2), infinite=math.isinf(found["quantity"][1]), same=found["same"][0])


@query("i6_iqr_outliers_tiny_values", """WITH x AS (SELECT CASE WHEN l_orderkey % 97 = 0 THEN 1e-10 ELSE l_quantity / 1e13 END AS v
  FROM lineitem), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM x)
  SELECT count(*) AS outliers FROM x, q WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)""")
def i6_tiny(spark, sf):
    value = F.when(F.col("l_orderkey") % 97 == 0, F.lit(1e-10)).otherwise(F.col("l_quantity") / F.lit(1e13))
    return one_row(spark, outliers=quality.iqr_outliers(table(spark, sf, "lineitem").select(value.alias("v"))))


SPELLED = """CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%m/%d/%Y')
  WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y年%m月%d日') END"""


@query("i4_timeliness_of_spelled_dates", f"""WITH d AS (SELECT date_trunc('day', o_orderdate) AS ts FROM orders WHERE o_orderkey % 11 <> 0)
  SELECT round(avg(100 - least(greatest({LAG} - 3, 0), 97)), 6) AS score, count(*) FILTER ({LAG} > 3) AS late FROM d""")
def i4_spelled(spark, sf):
    """Dates in three spellings, some missing: these neither score nor count as late."""
    form = lambda pattern: F.date_format("o_orderdate", pattern)
    key = F.col("o_orderkey")
    text = F.when(key % 11 == 0, None).when(key % 3 == 0, form("MM/dd/yyyy")).when(key % 3 == 1, form("yyyy-MM-dd")).otherwise(
        form("yyyy年MM月dd日"))
    score, late = quality.timeliness(table(spark, sf, "orders").select(text.alias("d")), NOW)
    return one_row(spark, score=half_up(score, 6), late=late)


@query("a8_date_parts_of_spelled_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate)::DOUBLE END AS "d_YEAR",
  CASE WHEN o_orderkey % 5 <> 0 THEN month(o_orderdate)::DOUBLE END AS "d_MONTH",
  CASE WHEN o_orderkey % 5 <> 0 THEN day(o_orderdate)::DOUBLE END AS "d_DAY" FROM orders""")
def a8_spelled(spark, sf):
    text = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "MM/dd/yyyy"))
    return cleanup.coerce(table(spark, sf, "orders").select("o_orderkey", text.alias("d"))).select(
        "o_orderkey", "d_YEAR", "d_MONTH", "d_DAY")


@query("a1_csv_without_header", """SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS total FROM orders""")
def a1_plain(spark, sf):
    path = scratch(spark)
    table(spark, sf, "orders").select("o_orderkey", "o_totalprice").write.csv(path)
    df = readers.read_csv(spark, path, header=False)
    return df.agg(F.count("*").alias("n"), F.sum(F.col("_c0").cast("long")).alias("keys"), F.round(F.sum("_c1"), 2).alias("total"))


@query("a3_union_csv_files", """SELECT count(*) AS n, sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS total FROM orders""")
def a3_csv(spark, sf):
    """Two CSV files with the columns in different order, one of them without a column."""
    orders, paths = table(spark, sf, "orders"), [scratch(spark), scratch(spark)]
    orders.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice").write.option("header", True).csv(paths[0])
    orders.filter("o_orderkey % 2 <> 0").select("o_orderstatus", "o_orderkey").write.option("header", True).csv(paths[1])
    return readers.read_csv_files(spark, paths).agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("total"))


@query("a16_tail_split_of_long_keys", """SELECT o_orderkey + 9007199254740992 AS k, CASE WHEN row_number() OVER (ORDER BY o_orderkey)
  <= count(*) OVER () - ceil(count(*) OVER () * 0.2) THEN 'train' ELSE 'test' END AS split FROM orders""")
def a16_long(spark, sf):
    keys = table(spark, sf, "orders").select((F.col("o_orderkey") + F.lit(9007199254740992)).alias("k"))
    return split.tail_split(keys, "k")


# Left-skewed values just below 1: the likelihood peaks at a lambda of many times the usual range.
LEFT = "1 - power(l_extendedprice / 120000, 4)"


@query("f6_power_of_left_skew", f"""WITH x AS (SELECT ln(1 + {LEFT}) AS u FROM lineitem), g AS (SELECT unnest(range(1, 161)) / 4.0::DOUBLE AS lam),
  s AS (SELECT lam, count(*) AS n, var_pop((exp(lam * u) - 1) / lam) AS v, sum(u) AS total FROM x, g GROUP BY lam)
  SELECT round(arg_max(lam, -n / 2 * ln(v) + (lam - 1) * total), 2) AS lam FROM s""")
def f6_left(spark, sf):
    df = table(spark, sf, "lineitem").select(F.expr(LEFT).alias("x"))
    lam = scale.fit_power(df, {"x": F.col("x")})["x"][0]
    return one_row(spark, lam=round(lam * 4) / 4)


NESTED = {"type": "object", "required": ["o", "l"], "properties": {
    "o": {"type": "object", "properties": {"k": {"type": "integer", "multipleOf": 2, "exclusiveMaximum": 90}}, "required": ["k"]},
    "l": {"type": "array", "items": {"anyOf": [{"type": "string", "enum": ["7"]}, {"$ref": "#/definitions/small"}]}, "maxItems": 2},
    "it's": {"const": 7}}, "definitions": {"small": {"type": "integer", "minimum": 10}}}


@query("j7_nested_schema", """WITH k AS (SELECT cast(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
  SELECT count(*) AS records, count(*) FILTER (k % 2 <> 0 OR k >= 90 OR k < 10) AS failures FROM k""")
def j7_nested(spark, sf):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"o": {"k": '), k, F.lit('}, "l": ["7", '), k, F.lit('], "it\'s": 7}'))
    counts = events.check_schema(table(spark, sf, "events").select(text.alias("t")), "t", NESTED)
    return one_row(spark, records=counts["records"], failures=counts["failures"])


@query("n3_append_without_metadata", """SELECT count(DISTINCT text) AS added, 0::BIGINT AS again FROM documents""")
def n3_plain(spark, sf):
    rows = table(spark, sf, "documents").select("text")
    none = spark.createDataFrame([], "fingerprint string")
    added = search.append_unseen(none, rows)
    again = search.append_unseen(added.select("fingerprint"), rows)
    return added.agg(F.count("*").alias("added")).withColumn("again", F.lit(again.count()).cast("long"))


@query("n3_mixed_metadata", """SELECT md5(text || '||META||' || '{"lang": "' || lang || '", "n": ' || n_chars || ', "ok": ' ||
  (doc_id % 2 = 0)::VARCHAR || '}') AS fingerprint FROM documents WHERE lang IN ('en', 'de', 'fr', 'es') GROUP BY ALL""")
def n3_mixed(spark, sf):
    """Metadata of a text, a number and a truth value."""
    meta = F.struct("n_chars", "lang", (F.col("doc_id") % 2 == 0).alias("ok"))
    rows = table(spark, sf, "documents").filter("lang in ('en', 'de', 'fr', 'es')").select(
        "text", F.struct(F.col("n_chars").alias("n"), F.col("lang").alias("lang"), meta["ok"].alias("ok")).alias("meta"))
    return search.append_unseen(spark.createDataFrame([], "fingerprint string"), rows).select("fingerprint")
