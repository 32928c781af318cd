"""Type splits, guards and value tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprep.functions.columns import one_row
from tableprep.operators import encode, features, guards, impute
from tableprep.plans.registry import query, table
from tableprep.plans.tables import GAPS, PREP, ROLES, gaps, prep


@query("b1_split_by_type", f"WITH {GAPS} SELECT flag, status, shipdate FROM gaps")
def b1(spark, sf):
    return guards.split_by_type(gaps(spark, sf))[0]


@query("b2_numeric_only", f"WITH {GAPS} SELECT part, quantity, price, discount, tax FROM gaps")
def b2(spark, sf):
    return guards.numeric_only(gaps(spark, sf))


@query("b3_table_guards", f"""WITH {GAPS} SELECT 'gaps' AS name, count(*) > 0 AS a, count(*) > 0 AS b, false AS c,
  false AS c1, false AS c2, false AS d FROM gaps
  UNION ALL SELECT 'numbers', true, true, count(*) FILTER (quantity IS NULL OR discount IS NULL) = 0, true, false,
  count(*) FILTER (quantity IS NULL OR discount IS NULL) = 0 FROM gaps
  UNION ALL SELECT 'clean', count(*) > 0, true, count(l_quantity) = count(*), true, false, count(l_tax) = count(*)
  FROM lineitem UNION ALL SELECT 'texts', false, count(*) > 0, false, false, true, false FROM customer
  UNION ALL SELECT 'empty', false, false, false, false, false, false""")
def b3(spark, sf):
    numbers = table(spark, sf, "lineitem").select("l_quantity", "l_tax")
    tables = {"gaps": gaps(spark, sf), "numbers": guards.numeric_only(gaps(spark, sf)), "clean": numbers,
              "texts": table(spark, sf, "customer").select("c_name", "c_mktsegment"),
              "empty": numbers.filter("l_quantity < 0")}
    rows = [(name, *guards.table_guards(df).values()) for name, df in tables.items()]
    return spark.createDataFrame(rows, "name string, a boolean, b boolean, c boolean, c1 boolean, c2 boolean, d boolean")


@query("b4_needs_imputation", f"""WITH {GAPS} SELECT count(*) > count(quantity) AS gaps,
  (SELECT count(*) > count(l_tax) FROM lineitem) AS lineitem FROM gaps""")
def b4(spark, sf):
    return one_row(spark, gaps=impute.needs_imputation(gaps(spark, sf)),
                   lineitem=impute.needs_imputation(table(spark, sf, "lineitem")))


@query("b5_needs_encoding", f"""WITH {PREP} SELECT count(flag) > 0 AS needed, count(*) > 0 AS accepted, false AS needed_after,
  count(flag) AS cells, sum(CASE WHEN flag IN (SELECT flag FROM prep WHERE split = 'train') THEN 0 ELSE 1 END)::BIGINT AS others
  FROM prep""")
def b5(spark, sf):
    """Before and after encoding, with the cells to encode and those that are missing or unknown to the train rows."""
    rows = prep(spark, sf)
    after = encode.one_hot_encoder(rows.withColumn("flag", F.coalesce("flag", F.lit("?"))), ROLES)
    hot = sum(F.col(c) for c in after.columns if c.startswith("flag_") and c != "flag_?")
    counts = rows.agg(F.count("flag").alias("cells")).first()
    return after.agg(F.lit(encode.needs_encoding(rows, ROLES)).alias("needed"), F.lit(encode.accepts_encoding(rows, ROLES)).alias("accepted"),
                     F.lit(encode.needs_encoding(after, ROLES)).alias("needed_after"), F.lit(counts["cells"]).cast("long").alias("cells"),
                     F.count_if(hot == 0).alias("others"))


@query("b6_width_guards", f"""WITH {PREP} SELECT count(*) FILTER (split = 'train') AS four_numbers, 0::BIGINT AS two_numbers FROM prep""")
def b6(spark, sf):
    """Train rows that components are made of, with four numbers and with two."""
    rows = prep(spark, sf)
    sizes = []
    for df in (rows, rows.drop("quantity", "tax")):
        made = features.pca_two(df, ROLES) if features.accepts_pca(df, ROLES) else df.limit(0).withColumn("PC1", F.lit(0.0))
        sizes.append(ROLES.train(made).filter("PC1 is not null").count())
    return one_row(spark, four_numbers=sizes[0], two_numbers=sizes[1])


@query("b7_clean_numbers", f"""WITH {GAPS} SELECT cast(part AS DOUBLE) AS part, coalesce(quantity, 0.0) AS quantity, price,
  coalesce(discount, 0.0) AS discount, tax FROM gaps""")
def b7(spark, sf):
    return guards.clean_numbers(gaps(spark, sf))


CELLS = """(SELECT json_extract_string(props, '$.k') AS s FROM events UNION ALL SELECT event_type FROM events
  UNION ALL SELECT cast(value AS VARCHAR) FROM events UNION ALL SELECT o_orderpriority FROM orders
  UNION ALL SELECT cast(cast(o_orderdate AS DATE) AS VARCHAR) FROM orders
  UNION ALL SELECT l_linenumber || '%' FROM lineitem)"""


def _cells(spark, sf):
    events, orders = table(spark, sf, "events"), table(spark, sf, "orders")
    parts = [events.select(F.get_json_object("props", "$.k").alias("s")), events.select(F.col("event_type")),
             events.select(F.col("value").cast("string")), orders.select("o_orderpriority"),
             orders.select(F.col("o_orderdate").cast("date").cast("string")),
             table(spark, sf, "lineitem").select(F.concat(F.col("l_linenumber"), F.lit("%")))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows


@query("b8_number_pattern", f"""SELECT s, count(*) AS n, regexp_matches(s,
  '^[+-]?\\d*\\.?\\d*(?:[+-:]\\d*\\.?\\d*)?%?$') AS number FROM {CELLS} GROUP BY s""")
def b8(spark, sf):
    return _cells(spark, sf).groupBy("s").agg(F.count("*").alias("n")).withColumn(
        "number", guards.is_number_text(F.col("s")))


@query("b9_not_a_number", f"""SELECT s, count(*) AS n, try_cast(trim(s) AS DOUBLE) IS NULL AS letters FROM {CELLS}
  GROUP BY s""")
def b9(spark, sf):
    return _cells(spark, sf).groupBy("s").agg(F.count("*").alias("n")).withColumn(
        "letters", guards.is_not_a_number(F.col("s")))


@query("b10_numeric_text_split", f"WITH {GAPS} SELECT flag, status FROM gaps")
def b10(spark, sf):
    return guards.split_numeric_text(gaps(spark, sf))[1]
