"""Readers, clean-up, splits and targets."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tableprep.functions import sketches
from tableprep.functions.columns import Roles, small_frame
from tableprep.operators import cleanup, profile, split
from tableprep.plans.registry import query, scratch, table
from tableprep.plans.tables import GAPS, PREP, ROLES, gaps, prep, rounded, sql_bucket, sql_split
from tableprep.sources import readers, sinks

CUSTOMER = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
                         T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
                         T.StructField("c_mktsegment", T.StringType())])


@query("a1_csv_scan", "SELECT * FROM customer")
def a1(spark, sf):
    path = scratch(spark)
    table(spark, sf, "customer").write.option("header", True).option("sep", ";").csv(path)
    return readers.read_csv(spark, path, sep=";", schema=CUSTOMER)


@query("a2_json_scan", "SELECT event_id, user_id, event_type, value, props FROM events")
def a2(spark, sf):
    path = scratch(spark)
    table(spark, sf, "events").drop("ts").write.json(path)
    return readers.read_json(spark, path, "event_id long, user_id long, event_type string, value double, props string")


@query("a3_union_scan", """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment
  FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def a3(spark, sf):
    customers = table(spark, sf, "customer").selectExpr("c_custkey key", "c_name name", "c_acctbal balance",
                                                        "c_mktsegment segment")
    suppliers = table(spark, sf, "supplier").selectExpr("s_acctbal balance", "s_suppkey key", "s_name name")
    paths = [scratch(spark), scratch(spark)]
    for part, path in zip((customers, suppliers), paths):
        part.write.parquet(path)
    return readers.union_by_name([readers.read_parquet(spark, p) for p in paths])


@query("a4_drop_index_column", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def a4(spark, sf):
    rows = table(spark, sf, "nation").withColumn("Unnamed: 0", F.col("n_nationkey"))
    return readers.drop_index_column(rows)


@query("a5_drop_columns", "SELECT p_partkey, p_name, p_type, p_retailprice FROM part")
def a5(spark, sf):
    return readers.drop_columns(table(spark, sf, "part"), ["p_brand", "p_size"])




@query("a6_list_to_columns", """WITH d AS (SELECT conv_id, list(char_length(text) ORDER BY turn) AS lens
  FROM conversations GROUP BY conv_id), cut AS (SELECT cast(floor(quantile_cont(len(lens), 0.9)) AS BIGINT) AS n FROM d),
  k AS (SELECT conv_id, unnest(lens[1:n]) AS v, unnest(range(1, least(len(lens), n) + 1)) AS i FROM d, cut)
  SELECT conv_id, (SELECT n FROM cut) AS items, list(v ORDER BY i) AS kept FROM k GROUP BY conv_id""")
def a6(spark, sf):
    lists = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", F.char_length("text").cast("long").alias("n")))),
        lambda s: s["n"]).alias("lens"))
    wide = cleanup.spread_list(lists, "lens")
    items = [c for c in wide.columns if c != "conv_id"]
    return wide.select("conv_id", F.lit(len(items)).cast("long").alias("items"),
                       F.filter(F.array(*items), lambda v: v.isNotNull()).alias("kept"))


@query("a7_numeric_coercion", """SELECT event_id, cast(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  event_type FROM events""")
def a7(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    return cleanup.coerce(rows)


def _parts(c: str, name: str) -> str:
    return f"""cast(epoch_us({c}) - epoch_us(TIMESTAMP '2017-01-01') AS DOUBLE) / 1e6 AS {name}_TIMESTAMP,
  cast(year({c}) AS DOUBLE) AS {name}_YEAR, cast(month({c}) AS DOUBLE) AS {name}_MONTH,
  cast(day({c}) AS DOUBLE) AS {name}_DAY, cast(isodow({c}) - 1 AS DOUBLE) AS {name}_DAYOFWEEK,
  round(hour({c}) + minute({c}) / 60.0::DOUBLE + floor(second({c})) / 3600.0::DOUBLE, 6) AS {name}_HOUR"""


@query("a8_date_parts", f"""SELECT event_id, {_parts('ts', 'ts')},
  {_parts("date_trunc('second', ts)", 'text')} FROM events""")
def a8(spark, sf):
    """One timestamp column and one text column full of timestamps."""
    rows = table(spark, sf, "events").select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"))
    return rounded(cleanup.coerce(rows))


@query("a9_profile_scan", f"""SELECT o_orderkey, o_totalprice, {_parts('o_orderdate', 'o_orderdate')},
  o_orderpriority FROM orders""")
def a9(spark, sf):
    """CSV in, index column dropped, numbers and dates found."""
    path = scratch(spark)
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("o_totalprice"),
                                               F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
                                               "o_orderpriority", F.col("o_orderkey").alias("Unnamed: 0"))
    orders.write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()),
                           *[T.StructField(c, T.StringType()) for c in ("o_totalprice", "o_orderdate",
                                                                        "o_orderpriority", "Unnamed: 0")]])
    return rounded(cleanup.clean(readers.read_csv(spark, path, schema=schema)))


PROFILE_NUMERIC = {"part": "bigint", "quantity": "double", "price": "double", "discount": "double", "tax": "double"}
PROFILE_OTHER = {"flag": "string", "status": "string", "shipdate": "timestamp_ntz"}


@query("a10_column_profile", f"WITH {GAPS} " + " UNION ALL ".join(
    [f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) FILTER ({c} IS NULL) AS missing,
  count(DISTINCT {c}) + cast(count(*) FILTER ({c} IS NULL) > 0 AS INT) AS "distinct",
  round(avg(power({c} - m, 3)) / power(var_pop({c}), 1.5), 4) + 0.0 AS skewness,
  round(kurtosis_pop({c}), 4) + 0.0 AS kurtosis
  FROM gaps, (SELECT avg({c}) AS m FROM gaps)""" for c, t in PROFILE_NUMERIC.items()]
    + [f"""SELECT '{c}', '{t}', count(*) FILTER ({c} IS NULL),
  count(DISTINCT {c}) + cast(count(*) FILTER ({c} IS NULL) > 0 AS INT), NULL, NULL FROM gaps"""
       for c, t in PROFILE_OTHER.items()]))
def a10(spark, sf):
    return rounded(profile.column_profile(gaps(spark, sf)), 4)


SKETCHED = ["part", "quantity", "price", "discount", "tax", "flag", "status"]


@query("a10_sketched_profile", f"WITH {GAPS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS "rows", count(*) FILTER ({c} IS NULL) AS missing,
  CASE WHEN count(DISTINCT {c}) < 100 THEN count(DISTINCT {c}) END AS few, count(DISTINCT {c}) AS "distinct" FROM gaps""" for c in SKETCHED))
def a10_sketched(spark, sf):
    """Two stored batches of sketches, united. Estimates of few values are exact; those of many must lie within four standard
    errors, and then the exact count stands for them."""
    path, rows = scratch(spark), gaps(spark, sf)
    sketches.add_batch(rows.filter("quantity < 20"), path, SKETCHED)
    sketches.add_batch(rows.filter("quantity >= 20 OR quantity IS NULL"), path, SKETCHED)
    exact = small_frame(spark, ["column", "exact"], list(profile.distinct_counts(rows, SKETCHED).items()))
    both = sketches.estimates(sketches.stored(spark, path)).join(exact, "column")
    off = F.abs(F.col("distinct") - F.col("exact")) / F.col("exact")
    return both.select("column", "rows", "missing", F.when(F.col("distinct") < 100, F.col("distinct")).alias("few"),
                       F.when(off <= 4 * sketches.relative_error(), F.col("exact")).otherwise(F.col("distinct")).alias("distinct"))


@query("a11_value_frequencies", f"WITH {GAPS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", cast({c} AS VARCHAR) AS value, count(*) AS n FROM gaps WHERE {c} IS NOT NULL
  GROUP BY {c}""" for c in ("part", "quantity", "discount", "tax", "flag", "status")))
def a11(spark, sf):
    return profile.value_frequencies(gaps(spark, sf), ["part", "quantity", "discount", "tax", "flag", "status"])


@query("a12_random_split", f"""SELECT o_orderkey, o_totalprice,
  CASE WHEN {sql_bucket('o_orderkey')} < 67 THEN 'train' ELSE 'test' END AS split FROM orders""")
def a12(spark, sf):
    return split.random_split(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


def _two_tables(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(
        F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("status"))
    return orders, table(spark, sf, "orders").select("o_totalprice", "o_custkey", "o_orderkey")


@query("a13_two_table_split", """SELECT o_custkey, o_orderkey,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS status,
  CASE WHEN o_orderpriority <> '5-LOW' THEN 'train' ELSE 'test' END AS split FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, NULL, 'test' FROM orders""")
def a13(spark, sf):
    return split.split_by_target(_two_tables(spark, sf), "status")


@query("a14_common_columns", """SELECT o_custkey, o_orderkey FROM orders
  UNION ALL SELECT o_custkey, o_orderkey FROM orders""")
def a14(spark, sf):
    parts = _two_tables(spark, sf)
    shared = split.align_columns(parts)
    return readers.union_by_name([p.select(*shared) for p in parts])


@query("a15_single_target_check", "SELECT true AS doubled_target_refused, count(*) AS n FROM orders")
def a15(spark, sf):
    orders = table(spark, sf, "orders")
    names = orders.columns + ["o_orderstatus"]
    try:
        split.check_single_target(names, "o_orderstatus")
        refused = False
    except ValueError:
        refused = True
    return orders.agg(F.lit(refused).alias("doubled_target_refused"), F.count("*").alias("n"))


@query("a16_seeded_split", f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority AS label,
  {sql_split('o_orderkey')} AS split FROM orders""")
def a16(spark, sf):
    return split.train_test_split(table(spark, sf, "orders"), ["o_orderkey"], to_drop=["o_orderdate"])


@query("a16_tail_split", """SELECT o_orderkey, o_orderpriority AS label, CASE WHEN row_number() OVER (ORDER BY o_orderkey)
  <= count(*) OVER () - ceil(count(*) OVER () * 0.2) THEN 'train' ELSE 'test' END AS split FROM orders""")
def a16_tail(spark, sf):
    return split.train_test_split(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"],
                                  order="o_orderkey")


@query("a17_factorize_target", """WITH t AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS type
  FROM events), c AS (SELECT type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM t WHERE type IS NOT NULL
  GROUP BY type) SELECT event_id, t.type AS event_type, coalesce(code, -1) AS code FROM t LEFT JOIN c ON c.type = t.type""")
def a17(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("event_type"))
                                             .alias("event_type"))
    return split.factorize(rows, "event_type", "event_id")


@query("a18_encode_target", f"""WITH {PREP}, c AS (SELECT flag, row_number() OVER (ORDER BY flag) - 1 AS code
  FROM (SELECT DISTINCT flag FROM prep WHERE split = 'train' AND flag IS NOT NULL))
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p.flag, code FROM prep p LEFT JOIN c ON c.flag = p.flag""")
def a18(spark, sf):
    return split.encode_target(prep(spark, sf), "flag", ROLES).select(*ROLES.keys, "flag", "code")


@query("a19_task_inference", """SELECT 'classification' AS status, 'regression' AS price, 'clustering' AS nothing,
  CASE WHEN count(DISTINCT quality) <= 2 THEN 'classification' ELSE 'regression' END AS quality FROM labels""")
def a19(spark, sf):
    orders, labels = table(spark, sf, "orders"), table(spark, sf, "labels")
    return small_frame(spark, ["status", "price", "nothing", "quality"], [(
        split.infer_task(orders, "o_orderstatus"), split.infer_task(orders, "o_totalprice"),
        split.infer_task(split.clustering_input(orders), None), split.infer_task(labels, "quality"))])


@query("a20_sparse_features", f"""WITH {GAPS} SELECT * FROM (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 1) AS missing_percent
  FROM gaps""" for c in ("quantity", "discount", "flag")) + ")")
def a20(spark, sf):
    return profile.sparse_features(gaps(spark, sf))


@query("a21_split_summary", f"""WITH {PREP} SELECT label, count(*) AS n,
  (SELECT count(*) FROM prep WHERE split = 'train') AS train_rows, (SELECT count(*) FROM prep WHERE split = 'test')
  AS test_rows, 1::BIGINT AS categorical_columns, 4::BIGINT AS numeric_columns FROM prep WHERE split = 'train'
  GROUP BY label""")
def a21(spark, sf):
    rows = prep(spark, sf)
    summary = split.split_summary(rows, ROLES)
    return split.target_counts(rows, ROLES).select("label", "n", *[F.lit(v).cast("long").alias(k)
                                                                  for k, v in summary.items()])


@query("a21_describe_numbers", f"WITH {GAPS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  cast(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
  round(quantile_cont({c}, 0.75), 4) AS q75, cast(max({c}) AS DOUBLE) AS max FROM gaps""" for c in PROFILE_NUMERIC))
def a21_numbers(spark, sf):
    return rounded(profile.describe_numbers(gaps(spark, sf)), 4)


@query("a22_dataset_sink", f"""SELECT {sql_split('o_orderkey')} AS split, count(*) AS n, round(sum(o_totalprice), 2)
  AS total FROM orders GROUP BY 1""")
def a22(spark, sf):
    """Written by split, read back."""
    path = scratch(spark)
    rows = split.hash_split(table(spark, sf, "orders"), ["o_orderkey"])
    sinks.write_dataset(rows, path, Roles(keys=("o_orderkey",)))
    return readers.read_parquet(spark, path).groupBy("split").agg(F.count("*").alias("n"),
                                                                  F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("a23_label_map_sink", """SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
  FROM (SELECT DISTINCT o_orderpriority FROM orders)""")
def a23(spark, sf):
    path = scratch(spark)
    sinks.write_label_map(split.label_codes(table(spark, sf, "orders"), "o_orderpriority"), path)
    return readers.read_parquet(spark, path)


@query("a24_rule_table_files", """SELECT cast(l_quantity AS DOUBLE) AS q, l_discount AS d, l_linenumber || '|25' AS operator_id,
  count(*) AS n FROM lineitem GROUP BY ALL""")
def a24(spark, sf):
    path = scratch(spark)
    rules = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"),
                                                F.concat(F.col("l_linenumber"), F.lit("|25")).alias("operator_id"))
    sinks.write_rules(rules, path)
    return readers.read_rules(spark, path, ["q", "d"]).groupBy("q", "d", "operator_id").agg(F.count("*").alias("n"))


@query("a25_result_log", """SELECT o_orderstatus, 2 * count(*) AS n FROM orders GROUP BY 1""")
def a25(spark, sf):
    """Two appended runs."""
    path = scratch(spark)
    result = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    for _ in range(2):
        sinks.append_result(result, path)
    return readers.read_parquet(spark, path).groupBy("o_orderstatus").agg(F.sum("n").alias("n"))
