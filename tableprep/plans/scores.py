"""Data quality, event logs and text scores."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tableprep.functions.columns import one_row, small_frame
from tableprep.operators import events, quality, textquality
from tableprep.plans.registry import half_up, query, table
from tableprep.plans.tables import GAPS, gaps, rounded

NOW = datetime.datetime(2024, 2, 1)
VALID = "'^[A-Za-z0-9_]+$'"

COMPLETE = """(1 - (count(*) FILTER (quantity IS NULL) + count(*) FILTER (discount IS NULL)
  + count(*) FILTER (flag IS NULL OR flag = ''))::DOUBLE / (count(*) * 8)) * 100"""
VALIDITY = f"""(1 - (count(*) FILTER (NOT regexp_matches(flag, {VALID}))
  + count(*) FILTER (NOT regexp_matches(status, {VALID})))::DOUBLE / (count(*) * 8)) * 100"""


@query("i1_completeness", f"WITH {GAPS} SELECT round({COMPLETE}, 6) AS score FROM gaps")
def i1(spark, sf):
    return one_row(spark, score=half_up(quality.completeness(gaps(spark, sf)), 6))


DATE_TEST = "(try_cast(s AS TIMESTAMP) IS NOT NULL OR regexp_matches(s, '^(\\d{4}-\\d{2}-\\d{2}|\\d{2}-\\d{2}-\\d{2}|" \
            "\\d{2}/\\d{2}/\\d{4}|\\d{2}/\\d{2}/\\d{2}|\\d{4}年\\d{2}月\\d{2}日|\\d{2}年\\d{2}月\\d{2}日)'))"
DATES = """(SELECT strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders
  UNION ALL SELECT strftime(o_orderdate, '%m/%d/%Y %H:%M:%S') FROM orders
  UNION ALL SELECT strftime(o_orderdate, '%Y年%m月%d日') FROM orders
  UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT o_orderstatus FROM orders)"""


def _dates(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select(F.explode(F.array(
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "MM/dd/yyyy HH:mm:ss"),
        F.date_format("o_orderdate", "yyyy年MM月dd日"), F.col("o_orderpriority"), F.col("o_orderstatus"))).alias("s"))


@query("i2_date_value_test", f"SELECT s, {DATE_TEST} AS is_date, count(*) AS n FROM {DATES} GROUP BY s")
def i2(spark, sf):
    return _dates(spark, sf).groupBy("s", quality.is_date_value(F.col("s")).alias("is_date")).agg(
        F.count("*").alias("n"))


@query("i3_date_columns", """SELECT * FROM (SELECT 'd' AS "column" FROM orders HAVING count(o_orderdate) >= 0.9 * count(*)
  UNION ALL SELECT 'mostly' FROM orders HAVING count(*) FILTER (o_totalprice >= 30000) >= 0.9 * count(*)
  UNION ALL SELECT 'rarely' FROM orders HAVING count(*) FILTER (o_totalprice >= 300000) >= 0.9 * count(*))""")
def i3(spark, sf):
    """Two text columns, one of them with dates in more than nine rows of ten."""
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("d"),
        F.when(F.col("o_totalprice") >= 30000, date).otherwise(F.lit("none")).alias("mostly"),
        F.when(F.col("o_totalprice") >= 300000, date).otherwise(F.lit("none")).alias("rarely"))
    return small_frame(spark, [], [(c,) for c in quality.date_columns(rows)], "column string")


LAG = "floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0)"


@query("i4_timeliness", f"""SELECT round(avg(100 - least(greatest({LAG} - 3, 0), 97)), 6) AS score,
  count(*) FILTER ({LAG} > 3) AS late FROM events""")
def i4(spark, sf):
    score, late = quality.timeliness(table(spark, sf, "events").select("ts", "value", "event_type"), NOW)
    return one_row(spark, score=half_up(score, 6), late=late)


@query("i5_validity", f"WITH {GAPS} SELECT round({VALIDITY}, 6) AS score FROM gaps")
def i5(spark, sf):
    return one_row(spark, score=half_up(quality.validity(gaps(spark, sf)), 6))


IQR_COLUMNS = ["part", "quantity", "price", "discount", "tax"]


def _iqr_chain() -> str:
    """Rows left after each column, in order."""
    ctes, source = [], "x"
    for i, c in enumerate(IQR_COLUMNS):
        ctes.append(f"""b{i} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}),
  m{i} AS (SELECT s.*, {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)
    AS bad FROM {source} s, b{i}),
  k{i} AS (SELECT * EXCLUDE (bad) FROM m{i} WHERE NOT bad)""")
        source = f"k{i}"
    return ", ".join(ctes)


# Prices with a long upper tail, quantities and discounts with missing values that count as 0.
SKEWED = f"""{GAPS}, x AS (SELECT part::DOUBLE AS part, coalesce(quantity, 0) AS quantity, price * price / 1e5 AS price,
  coalesce(discount, 0) AS discount, exp(tax * 60) AS tax FROM gaps)"""
OUTLIERS = " + ".join(f"(SELECT count(*) FILTER (bad) FROM m{i})" for i in range(len(IQR_COLUMNS)))


def _skewed(spark, sf):
    return gaps(spark, sf).withColumn("price", F.col("price") * F.col("price") / 1e5).withColumn(
        "tax", F.exp(F.col("tax") * 60))


@query("i6_iqr_outliers", f"WITH {SKEWED}, {_iqr_chain()} SELECT {OUTLIERS} AS outliers")
def i6(spark, sf):
    return one_row(spark, outliers=quality.iqr_outliers(_skewed(spark, sf)))


@query("i6_iqr_outliers_independent", f"WITH {SKEWED} SELECT " + " + ".join(
    f"""(SELECT count(*) FROM x, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM x)
  WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"""
    for c in IQR_COLUMNS) + " AS outliers")
def i6_independent(spark, sf):
    return one_row(spark, outliers=quality.iqr_outliers(_skewed(spark, sf), independent=True))


@query("i7_accuracy", f"""WITH {SKEWED}, {_iqr_chain()} SELECT round((1 - ({OUTLIERS})::DOUBLE / (count(*) * 8)) * 100, 6)
  AS score FROM gaps""")
def i7(spark, sf):
    return one_row(spark, score=half_up(quality.accuracy(_skewed(spark, sf)), 6))


@query("i8_kmeans_outliers", """WITH x AS (SELECT c_acctbal + CASE WHEN c_custkey % 4 = 0 THEN 1e8 ELSE 0 END AS v, c_custkey % 4 = 0 AS far,
  c_nationkey = 3 AS bad FROM customer), m AS (SELECT far, avg(v) AS mean FROM x GROUP BY far),
  d AS (SELECT abs(v - mean) AS d, bad FROM x JOIN m USING (far)), e AS (SELECT quantile_cont(d, 0.95) AS edge FROM d)
  SELECT count(*) FILTER (d > edge) + count(*) FILTER (bad) AS outliers FROM d, e""")
def i8(spark, sf):
    """Two groups of balances far apart, so that the centres are their means; then a text column with cells that are no
    numbers, the rest of it all 1."""
    balance = F.col("c_acctbal") + F.when(F.col("c_custkey") % 4 == 0, 1e8).otherwise(0.0)
    rows = table(spark, sf, "customer").select(balance.alias("v"), F.when(F.col("c_nationkey") == 3, "n3").otherwise("1").alias("nation"))
    return one_row(spark, outliers=quality.kmeans_outliers(rows))


def _two_means_sql(name: str, value: str, where: str) -> str:
    """Counts of the values beyond the 95 % quantile of the distance to the nearer of the two best centres."""
    return f"""{name}c AS (SELECT {value} AS v, count(*) AS n FROM k8 WHERE {where} GROUP BY v),
  {name}t AS (SELECT sum(n) AS total, sum(v * n) / sum(n) AS mean FROM {name}c),
  {name}r AS (SELECT v, sum(n) OVER w AS a, sum(n * (v - mean)) OVER w AS s, total, mean FROM {name}c, {name}t WINDOW w AS (ORDER BY v)),
  {name}m AS (SELECT mean + s / a AS m1, mean - s / (total - a) AS m2 FROM {name}r WHERE a < total ORDER BY s * s / a / (total - a) DESC, v LIMIT 1),
  {name}d AS (SELECT least(abs({value} - m1), abs({value} - m2)) AS d FROM k8, {name}m WHERE {where}),
  {name} AS (SELECT count(*) AS n FROM {name}d WHERE d > (SELECT quantile_cont(d, 0.95) FROM {name}d))"""


@query("i8_kmeans_outliers_columns", f"""WITH k8 AS (SELECT l_extendedprice * l_extendedprice / 1e5 AS price, l_quantity AS quantity, l_tax AS tax,
  l_linenumber = 3 AS bad FROM lineitem), {_two_means_sql('ka', 'price', 'true')}, {_two_means_sql('kb', 'quantity', 'NOT bad')},
  {_two_means_sql('kc', 'tax', 'NOT bad')} SELECT (SELECT count(*) FILTER (bad) FROM k8) + ka.n + kb.n + kc.n AS outliers FROM ka, kb, kc""")
def i8_columns(spark, sf):
    """Several columns at once; rows with a bad text cell are gone for the columns from there on."""
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") * F.col("l_extendedprice") / 1e5).alias("price"),
        F.when(F.col("l_linenumber") == 3, "n3").otherwise(F.col("l_quantity").cast("string")).alias("quantity"), F.col("l_tax").alias("tax"))
    return one_row(spark, outliers=quality.kmeans_outliers(rows))


@query("i9_vector_outliers", """WITH d AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b
  WHERE array_distance(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64]) <= 1.16),
  n AS (SELECT a, count(*) AS near FROM d GROUP BY a), core AS (SELECT a FROM n WHERE near >= 5)
  SELECT (SELECT count(*) FROM embeddings) - count(DISTINCT d.a) AS noise FROM d JOIN core ON core.a = d.b""")
def i9(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return one_row(spark, noise=quality.vector_outliers(vectors, 1.16, 5, standardize=False))


@query("i9_text_outliers", """SELECT count(*) FILTER (n < 5) AS noise FROM (SELECT count(*) OVER (PARTITION BY text) AS n FROM documents)""")
def i9_text(spark, sf):
    """With a tiny radius only equal texts are neighbours, so a text is noise if it has fewer than five copies."""
    return one_row(spark, noise=quality.text_outliers(table(spark, sf, "documents").select("text"), eps=1e-9))


@query("i10_scorecard", f"""WITH {GAPS}, x AS (SELECT part::DOUBLE AS part, coalesce(quantity, 0) AS quantity, price,
  coalesce(discount, 0) AS discount, tax FROM gaps), {_iqr_chain()},
  s AS (SELECT {COMPLETE} AS completeness, {VALIDITY} AS validity, (1 - ({OUTLIERS})::DOUBLE / (count(*) * 8)) * 100
  AS accuracy FROM gaps) SELECT round(completeness, 6) AS completeness, round(validity, 6) AS validity,
  round(accuracy, 6) AS accuracy, round((completeness + validity + accuracy) / 3, 6) AS total FROM s""")
def i10(spark, sf):
    scores = quality.scorecard(gaps(spark, sf))
    return one_row(spark, **{k: half_up(scores[k], 6) for k in ("completeness", "validity", "accuracy", "total")})


@query("i11_uniqueness", """SELECT 100.0::DOUBLE * count(DISTINCT o_custkey) / count(*) AS unique_rows,
  (SELECT 100.0::DOUBLE * count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders))
  / count(*) FROM customer) AS covered FROM orders""")
def i11(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey")
    return one_row(spark, **quality.uniqueness(orders, ["o_custkey"], table(spark, sf, "customer"), ["c_custkey"]))


@query("i12_consistency", """SELECT round(100.0::DOUBLE * (count(*) FILTER (o_totalprice <= 400000)
  + count(*) FILTER (o_totalprice <= 400000 AND o_orderpriority <> '2-HIGH')) / (2 * count(*)), 6) AS score FROM orders""")
def i12(spark, sf):
    """The second copy lacks dear orders and has another text for one priority."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    other = orders.filter("o_totalprice <= 400000").withColumn("o_orderpriority", F.when(
        F.col("o_orderpriority") == "2-HIGH", "high").otherwise(F.col("o_orderpriority")))
    score = quality.consistency(orders.drop("o_totalprice"), other.drop("o_totalprice"), ["o_orderkey"])
    return one_row(spark, score=half_up(score, 6))


@query("j1_inter_arrival", """SELECT * FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id
  ORDER BY ts)) / 1e6 AS iat FROM events) WHERE iat > 0""")
def j1(spark, sf):
    return rounded(events.inter_arrival(table(spark, sf, "events"), "user_id", "ts"))


HOURS = """h AS (SELECT user_id, cast(ceil(iat / 3600) AS DOUBLE) AS iat FROM (SELECT user_id, (epoch_us(ts)
  - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS iat FROM events) WHERE iat > 0)"""
MODES = """m AS (SELECT user_id, iat AS mode FROM (SELECT user_id, iat, row_number() OVER (PARTITION BY user_id
  ORDER BY count(*) DESC, iat) AS r FROM h GROUP BY user_id, iat) WHERE r = 1)"""
MODE = "g AS (SELECT iat AS mode FROM h GROUP BY iat ORDER BY count(*) DESC, iat LIMIT 1)"


def _hours(spark, sf):
    """Arrival times in whole hours, so that values repeat."""
    iat = events.inter_arrival(table(spark, sf, "events"), "user_id", "ts")
    return iat.withColumn("iat", F.ceil(F.col("iat") / 3600).cast("double"))


@query("j2_mode_deviation", f"""WITH {HOURS}, {MODES} SELECT h.user_id, any_value(mode) AS mode,
  round(avg(abs(iat - mode)), 6) AS deviation FROM h JOIN m ON m.user_id = h.user_id GROUP BY h.user_id""")
def j2(spark, sf):
    return rounded(events.mode_deviation(_hours(spark, sf), "user_id"))


@query("j3_regularity_by_key", f"""WITH {HOURS}, {MODES}, d AS (SELECT h.user_id, avg(abs(iat - mode)) AS d FROM h
  JOIN m ON m.user_id = h.user_id GROUP BY h.user_id)
  SELECT round(1 - (avg(d) - min(d)) / (max(d) - min(d)), 3) AS score FROM d""")
def j3(spark, sf):
    return one_row(spark, score=events.regularity_by_key(_hours(spark, sf), "user_id"))


@query("j4_regularity", f"""WITH {HOURS}, {MODE}, e AS (SELECT abs(iat - mode) / mode AS e FROM h, g)
  SELECT round(sum(CASE WHEN e <= 0.5 THEN 1 - 2 * e END) / (count(*) FILTER (e <= 0.5)
  + sum(CASE WHEN e > 0.5 THEN 2 * e END)), 3) AS score FROM e""")
def j4(spark, sf):
    return one_row(spark, score=events.regularity(_hours(spark, sf)))


@query("j5_arrival_outliers", f"""WITH {HOURS}, {MODE}, s AS (SELECT median(abs(iat - mode)) AS mad FROM h, g)
  SELECT round(1 - count(*) FILTER (0.6745 * (iat - mode) / nullif(mad, 0) > 3.5)::DOUBLE / count(*), 3) AS score
  FROM h, g, s""")
def j5(spark, sf):
    return one_row(spark, score=events.arrival_outliers(_hours(spark, sf)))


@query("j6_duplicate_score", """SELECT round(1 - (count(*) - count(DISTINCT (user_id, event_type)))::DOUBLE / count(*), 3)
  AS score FROM events""")
def j6(spark, sf):
    return one_row(spark, score=events.duplicate_score(table(spark, sf, "events"), "user_id", "event_type"))


SCHEMA = {"properties": {"k": {"type": "integer", "minimum": 5, "maximum": 90}, "t": {"type": "string",
          "enum": ["view", "click", "error"]}}, "required": ["k", "z"], "additionalProperties": False}
# Purchases carry one more property, sign-ups are no JSON, errors have a null.
RECORDS = """r AS (SELECT CASE event_type WHEN 'signup' THEN 'broken' WHEN 'error' THEN '{"k": null, "t": "error"}'
  WHEN 'purchase' THEN '{"k": ' || json_extract_string(props, '$.k') || ', "z": 1}'
  ELSE '{"k": ' || json_extract_string(props, '$.k') || ', "t": "' || event_type || '"}' END AS doc FROM events)"""


def _records(spark, sf):
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.when(kind == "signup", "broken").when(kind == "error", '{"k": null, "t": "error"}')
        .when(kind == "purchase", F.concat(F.lit('{"k": '), k, F.lit(', "z": 1}')))
        .otherwise(F.concat(F.lit('{"k": '), k, F.lit(', "t": "'), kind, F.lit('"}'))).alias("doc"))


@query("j7_schema_check", f"""WITH {RECORDS}, v AS (SELECT json_valid(doc) AS ok, CASE WHEN json_valid(doc)
  THEN json_keys(doc) ELSE [] END AS keys, CASE WHEN json_valid(doc) THEN json_extract_string(doc, '$.k') END AS k,
  CASE WHEN json_valid(doc) THEN json_extract_string(doc, '$.t') END AS t FROM r)
  SELECT count(*) AS records, count(*) FILTER (NOT coalesce(ok AND list_contains(keys, 'k') AND k IS NOT NULL
  AND cast(k AS INT) BETWEEN 5 AND 90 AND list_contains(keys, 'z') AND NOT list_contains(keys, 'z'), false)) AS failures,
  count(*) FILTER (ok AND list_contains(keys, 'z')) AS with_extra,
  count(*) FILTER (ok AND NOT list_contains(keys, 'k')) + count(*) FILTER (ok AND NOT list_contains(keys, 'z'))
  AS missing_required FROM v""")
def j7(spark, sf):
    return one_row(spark, **events.check_schema(_records(spark, sf), "doc", SCHEMA))


@query("j7_schema_check_values", f"""WITH {RECORDS}, v AS (SELECT json_valid(doc) AS ok,
  CASE WHEN json_valid(doc) THEN json_extract_string(doc, '$.k') END AS k,
  CASE WHEN json_valid(doc) THEN json_extract_string(doc, '$.t') END AS t FROM r)
  SELECT count(*) AS records, count(*) FILTER (NOT coalesce(ok AND cast(k AS INT) BETWEEN 5 AND 90
  AND (t IS NULL OR t = 'view'), false)) AS failures, 0::BIGINT AS with_extra, 0::BIGINT AS missing_required FROM v""")
def j7_values(spark, sf):
    schema = {"properties": {"k": {"type": "integer", "minimum": 5, "maximum": 90},
                             "t": {"type": "string", "maxLength": 4}}, "required": ["k"]}
    return one_row(spark, **events.check_schema(_records(spark, sf), "doc", schema))


@query("j8_required_fields", f"""WITH {RECORDS}, v AS (SELECT CASE WHEN json_valid(doc) THEN doc END AS doc FROM r)
  SELECT count(*) AS records, count(*) FILTER (json_extract_string(doc, '$.k') IS NULL)
  + count(*) FILTER (json_extract_string(doc, '$.t') IS NULL) AS missing FROM v""")
def j8(spark, sf):
    return one_row(spark, **events.required_fields(_records(spark, sf), "doc", ["k", "t"]))


LONG = "length(text) < 10 OR length(text) > 500"
WORDS = "len(regexp_extract_all(text, '\\p{L}+'))"
EASE = f"""206.835::DOUBLE - 1.015::DOUBLE * ({WORDS}::DOUBLE / greatest(len(regexp_extract_all(text, '[.!?]+')), 1))
  - 84.6::DOUBLE * CASE WHEN {WORDS} > 0 THEN greatest(len(regexp_extract_all(text, '[aeiouyAEIOUY]+')), {WORDS})::DOUBLE
  / {WORDS} ELSE 0 END"""


@query("k1_length_score", f"""SELECT 'documents' AS name, round(1 - count(*) FILTER ({LONG})::DOUBLE / count(*), 6) AS score
  FROM documents UNION ALL SELECT 'conversations', round(1 - count(*) FILTER ({LONG})::DOUBLE / count(*), 6)
  FROM conversations""")
def k1(spark, sf):
    return small_frame(spark, ["name", "score"], [
        (t, half_up(textquality.length_score(table(spark, sf, t), "text"), 6)) for t in ("documents", "conversations")])


@query("k2_readability_score", f"""SELECT round(1 - count(*) FILTER ({EASE} < 30)::DOUBLE / count(*), 6) AS score
  FROM documents""")
def k2(spark, sf):
    return one_row(spark, score=half_up(textquality.readability_score(table(spark, sf, "documents"), "text"), 6))


@query("k2_reading_ease", f"SELECT doc_id, round({EASE}, 8) AS ease FROM documents")
def k2_ease(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(textquality.reading_ease(F.col("text")), 8).alias("ease"))


STAMPED = "s AS (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type AS text, ts FROM events)"
RATE = """(SELECT avg(CASE WHEN g < 600 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM (SELECT epoch(t) - lag(epoch(t))
  OVER (ORDER BY t) AS g FROM (SELECT date_trunc('second', ts) AS t FROM s)) WHERE g IS NOT NULL)"""


def _stamped(spark, sf):
    return table(spark, sf, "events").select(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "),
                                                      F.col("event_type")).alias("text"))


@query("k3_gap_rate", f"WITH {STAMPED} SELECT round({RATE}, 6) AS rate")
def k3(spark, sf):
    return one_row(spark, rate=half_up(textquality.gap_rate(_stamped(spark, sf), "text"), 6))


@query("k4_text_score", f"""WITH {STAMPED} SELECT round((1 - count(*) FILTER ({LONG})::DOUBLE / count(*)
  + 1 - count(*) FILTER ({EASE} < 30)::DOUBLE / count(*) + any_value(r)) / 3, 6) AS score FROM s, (SELECT {RATE} AS r)""")
def k4(spark, sf):
    return one_row(spark, score=half_up(textquality.text_score(_stamped(spark, sf), "text"), 6))
