"""Predictors, and whole chains of operators with a predictor at the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprep.functions.columns import Roles
from tableprep.operators import chains, scale
from tableprep.operators.catalog import valid_chain
from tableprep.operators.models import bayes, linear, neighbors, svc, trees
from tableprep.operators.models.common import accuracy, classification
from tableprep.operators.split import hash_split
from tableprep.plans.registry import query, table
from tableprep.plans.tables import KEYS, PREP, ROLES, prep, sql_split

# Line items with a price band to predict from quantity, price, discount and tax.
BAND = "CASE WHEN l_extendedprice < 35000 THEN 'low' WHEN l_extendedprice < 70000 THEN 'middle' ELSE 'top' END"
BANDS = f"""bands AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS quantity,
  l_extendedprice AS price, l_discount AS discount, l_tax AS tax, {BAND} AS label, {sql_split(*KEYS)} AS split
  FROM lineitem)"""
NUMBERS = ["quantity", "price", "discount", "tax"]


def _bands(spark, sf, label: str = BAND):
    rows = hash_split(table(spark, sf, "lineitem"), KEYS)
    return rows.select(*KEYS, F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
                       F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
                       F.expr(label).alias("label"), "split")


TEST_ROWS = f"WITH {BANDS} SELECT count(*) AS rows, 0::BIGINT AS unknown, true AS learned FROM bands WHERE split = 'test'"


def _learned(predicted, floor: float):
    """Rows predicted, predictions that are no known class, and whether the accuracy reaches a floor."""
    known = predicted.agg(F.count("*").alias("rows"), F.count_if(F.col("prediction").isNull()).alias("unknown"),
                          (F.avg((F.col("label") == F.col("prediction")).cast("double")) >= floor).alias("learned"))
    return known


def _classifier(name: str, model, floor: float, scaled: bool = False, label: str = BAND, **params):
    """Registers a classifier on the price bands (a fair coin over the bands scores about 0.35)."""
    @query(name, TEST_ROWS)
    def run(spark, sf):
        rows = _bands(spark, sf, label)
        rows = scale.standard_scaler(rows, ROLES) if scaled else rows
        return _learned(model(rows, ROLES, **params), floor)
    return run


RARE = "CASE WHEN l_extendedprice > 95000 THEN 'rare' ELSE 'common' END"

_classifier("h1_random_forest", trees.random_forest, 0.95)
_classifier("h2_ada_boost", trees.ada_boost, 0.6)
_classifier("h3_bagging", trees.bagging, 0.95)
_classifier("h5_decision_tree", trees.decision_tree, 0.95)
_classifier("h11_linear_discriminant", bayes.linear_discriminant, 0.9)
_classifier("h12_linear_svc", linear.linear_svc, 0.6, scaled=True)
_classifier("h13_logistic_regression", linear.logistic_regression, 0.6, scaled=True)
_classifier("h15_passive_aggressive", linear.passive_aggressive, 0.5, scaled=True)
_classifier("h16_ridge_classifier", linear.ridge_classifier, 0.6)
_classifier("h17_ridge_classifier_cv", linear.ridge_classifier_cv, 0.6)
_classifier("h18_sgd_classifier", linear.sgd_classifier, 0.6, scaled=True)
_classifier("h21_easy_ensemble", trees.easy_ensemble, 0.9, label=RARE)
_classifier("h22_rus_boost", trees.rus_boost, 0.9, label=RARE)


# Labels that one or two columns decide, next to columns that tell nothing: every test row must get its own label.
STEPS = f"""steps AS (SELECT l_quantity AS quantity, floor(l_extendedprice / 5000)::DOUBLE AS price, l_discount AS discount,
  l_tax AS tax, (l_discount = 0)::INT::DOUBLE AS full_price, (l_tax = 0)::INT::DOUBLE AS untaxed, {{label}} AS label,
  {sql_split(*KEYS)} AS split FROM lineitem)"""


def _decided(name: str, model, label: str, columns: list[str], scaled: bool = False, **params):
    """Registers a classifier whose predictions on the test rows are fixed: counts of label and prediction."""
    @query(name, f"WITH {STEPS.format(label=label)} SELECT label, label AS prediction, count(*) AS n FROM steps WHERE split = 'test' GROUP BY ALL")
    def run(spark, sf):
        rows = _bands(spark, sf, label)
        made = rows.withColumn("full_price", (F.col("discount") == 0).cast("double")).withColumn(
            "untaxed", (F.col("tax") == 0).cast("double")).withColumn("price", F.floor(F.col("price") / 5000).cast("double"))
        made = made.select(*KEYS, *columns, "label", "split")
        predicted = model(scale.standard_scaler(made, ROLES) if scaled else made, ROLES, **params)
        return predicted.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    return run


MANY = "CASE WHEN l_quantity > 45 THEN 'rare' ELSE 'common' END"
PAID = "CASE WHEN l_discount = 0 THEN 'none' WHEN l_tax = 0 THEN 'free' ELSE 'both' END"

_decided("h6_extra_trees", trees.extra_trees, PAID, ["quantity", "price", "full_price", "untaxed"], look=4)
_decided("h8_gradient_boosting", trees.gradient_boosting, BAND, ["quantity", "price", "discount", "tax"])
_decided("h19_kernel_svc", svc.kernel_svc, PAID, ["quantity", "full_price", "untaxed"], scaled=True)
_decided("h20_balanced_forest", trees.balanced_forest, MANY, ["quantity", "discount", "tax"], look=3)

# The other classifiers on labels that a column decides: trees on flags, stumps on a threshold, linear models on two halves.
HALF = "CASE WHEN l_quantity > 25 THEN 'much' ELSE 'little' END"
for _name, _model in (("h3_bagging", trees.bagging), ("h5_decision_tree", trees.decision_tree)):
    _decided(f"{_name}_decided", _model, PAID, ["quantity", "price", "full_price", "untaxed"])
for _name, _model in (("h2_ada_boost", trees.ada_boost), ("h21_easy_ensemble", trees.easy_ensemble), ("h22_rus_boost", trees.rus_boost)):
    _decided(f"{_name}_decided", _model, MANY, ["quantity", "discount", "tax"])
for _name, _model in (("h11_linear_discriminant", bayes.linear_discriminant), ("h16_ridge_classifier", linear.ridge_classifier),
                      ("h17_ridge_classifier_cv", linear.ridge_classifier_cv), ("h12_linear_svc", linear.linear_svc),
                      ("h13_logistic_regression", linear.logistic_regression), ("h18_sgd_classifier", linear.sgd_classifier)):
    _decided(f"{_name}_decided", _model, HALF, ["quantity", "discount", "tax"], scaled=True)
_decided("h1_random_forest_decided", trees.random_forest, HALF, ["quantity"])


@query("h20_balanced_draws", f"""WITH {STEPS.format(label=MANY)}, n AS (SELECT label, count(*) AS n FROM steps WHERE split = 'train' GROUP BY label)
  SELECT tree, label, (SELECT min(n) FROM n) AS drawn FROM n, range(10) t(tree)""")
def h20_draws(spark, sf):
    """Every tree's sample holds as many rows of each class as the rarest class has."""
    task = classification(_bands(spark, sf, MANY), ROLES)
    forest = trees.balanced_trees(task, 10, 1, 0, None)
    return spark.createDataFrame([(t, label, int(n)) for t, stats in enumerate(forest.stats) for label, n in zip(task.classes, stats[0])],
                                 "tree long, label string, drawn long")


def _per_class(expression: str) -> str:
    return ", ".join(expression.replace("$c", c) for c in NUMBERS)


# Bernoulli: one-hot of "above 0", smoothed by 1 and 2.
BERNOULLI = " + ".join(f"ln(CASE WHEN t.{c} > 0 THEN (k_{c} + 1) / (n + 2.0) ELSE 1 - (k_{c} + 1) / (n + 2.0) END)"
                       for c in NUMBERS)
QUARTER = "CASE WHEN l_discount = 0 THEN 'none' WHEN l_tax = 0 THEN 'free' ELSE 'both' END"


@query("h4_bernoulli_nb", f"""WITH b0 AS ({BANDS.split('AS (', 1)[1].rsplit(')', 1)[0].replace(BAND, QUARTER)}),
  s AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total, {_per_class('count(*) FILTER ($c > 0) AS k_$c')}
  FROM b0 WHERE split = 'train' GROUP BY label), z AS (SELECT t.*, s.label AS guess, ln(n / total) + {BERNOULLI} AS score
  FROM b0 t, s WHERE t.split = 'test')
  SELECT label, prediction, count(*) AS n FROM (SELECT label, arg_max(guess, score) AS prediction FROM z
  GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, quantity, price, discount, tax, label) GROUP BY ALL""")
def h4(spark, sf):
    """The label says which of discount and tax are 0, so the binarised columns decide it."""
    predicted = bayes.bernoulli_nb(_bands(spark, sf, QUARTER), ROLES)
    return predicted.groupBy("label", "prediction").agg(F.count("*").alias("n"))


SMOOTH = "(SELECT 1e-9 * greatest(" + ", ".join(f"var_pop({c})" for c in NUMBERS) + \
         ") FROM bands WHERE split = 'train')"
GAUSS = "ln(n / total) - 0.5 * (" + " + ".join(
    f"ln(2 * pi() * (v_{c} + e)) + power(t.{c} - m_{c}, 2) / (v_{c} + e)" for c in NUMBERS) + ")"


@query("h7_gaussian_nb", f"""WITH {BANDS}, s AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total, {SMOOTH} AS e,
  {_per_class('avg($c) AS m_$c, var_pop($c) AS v_$c')} FROM bands WHERE split = 'train' GROUP BY label),
  z AS (SELECT t.*, s.label AS guess, {GAUSS} AS score FROM bands t, s WHERE t.split = 'test')
  SELECT label, prediction, count(*) AS n FROM (SELECT label, arg_max(guess, score) AS prediction FROM z
  GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, quantity, price, discount, tax, label) GROUP BY ALL""")
def h7(spark, sf):
    predicted = bayes.gaussian_nb(_bands(spark, sf), ROLES)
    return predicted.groupBy("label", "prediction").agg(F.count("*").alias("n"))


CENTROID = " + ".join(f"power(t.{c} - m_{c}, 2)" for c in NUMBERS)


@query("h14_nearest_centroid", f"""WITH {BANDS}, s AS (SELECT label, {_per_class('avg($c) AS m_$c')} FROM bands
  WHERE split = 'train' GROUP BY label), z AS (SELECT t.*, s.label AS guess, {CENTROID} AS dist FROM bands t, s
  WHERE t.split = 'test') SELECT label, prediction, count(*) AS n FROM (SELECT label, arg_min(guess, dist) AS prediction
  FROM z GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, quantity, price, discount, tax, label) GROUP BY ALL""")
def h14(spark, sf):
    predicted = bayes.nearest_centroid(_bands(spark, sf), ROLES)
    return predicted.groupBy("label", "prediction").agg(F.count("*").alias("n"))


VECTORS = f"e AS (SELECT vec_id, embedding::DOUBLE[64] AS v, label, {sql_split('vec_id')} AS split FROM embeddings)"


@query("h10_k_neighbors", f"""WITH {VECTORS}, d AS (SELECT t.vec_id, r.label FROM e t JOIN e r ON t.split = 'test'
  AND r.split = 'train' QUALIFY row_number() OVER (PARTITION BY t.vec_id ORDER BY array_distance(t.v, r.v), r.vec_id) <= 5),
  k AS (SELECT vec_id, label, count(*) AS n FROM d GROUP BY vec_id, label)
  SELECT vec_id, arg_min(label, (-n, label)) AS prediction FROM k GROUP BY vec_id""")
def h10(spark, sf):
    rows = hash_split(table(spark, sf, "embeddings"), ["vec_id"])
    wide = rows.select("vec_id", "label", "split", *[F.col("embedding")[i].cast("double").alias(f"x{i}")
                                                     for i in range(64)])
    return neighbors.k_neighbors(wide, Roles(keys=("vec_id",))).select("vec_id", "prediction")


@query("h10_k_neighbors_wide_table", TEST_ROWS)
def h10_rows(spark, sf):
    """Many rows in few dimensions: most cells are never visited."""
    rows = _bands(spark, sf).withColumn("row", F.concat_ws("-", *KEYS, "quantity", "price"))
    scaled = scale.standard_scaler(rows, Roles(keys=("row", *KEYS)))
    return _learned(neighbors.k_neighbors(scaled, Roles(keys=("row", *KEYS))), 0.9)


TARGET = "l_extendedprice * (1 - l_discount) + 1000 * l_quantity"


def _regressor(name: str, model, share: float, **params):
    @query(name, TEST_ROWS)
    def run(spark, sf):
        """The error is compared with the spread of the target."""
        predicted = model(_bands(spark, sf, TARGET), ROLES, **params)
        error = F.col("label") - F.col("prediction")
        return predicted.agg(F.count("*").alias("rows"), F.count_if(F.col("prediction").isNull()).alias("unknown"),
                             (F.sqrt(F.avg(error * error)) <= share * F.stddev_pop("label")).alias("learned"))
    return run


_regressor("h23_ard_regression", linear.ard_regression, 0.2)
_regressor("h24_ada_boost_regressor", trees.ada_boost_regressor, 0.6)
_regressor("h25_bagging_regressor", trees.bagging_regressor, 0.2)


def _sums(name: str, model, target: str, places: int):
    """Registers a regressor on a target that the quantity decides: predictions by value of the quantity."""
    @query(name, f"WITH {STEPS.format(label=target)} SELECT quantity, count(*) AS n, round(min(label), {places}) AS least, round(max(label), {places}) AS most "
                 "FROM steps WHERE split = 'test' GROUP BY quantity")
    def run(spark, sf):
        predicted = model(_bands(spark, sf, target).select(*KEYS, "quantity", "discount", "tax", "label", "split"), ROLES)
        return predicted.groupBy("quantity").agg(F.count("*").alias("n"), (F.round(F.min("prediction"), places) + 0.0).alias("least"),
                                                 (F.round(F.max("prediction"), places) + 0.0).alias("most"))
    return run


TWO_LEVELS = "CASE WHEN l_quantity > 25 THEN 100.0::DOUBLE ELSE 10.0::DOUBLE END"
_sums("h23_ard_regression_decided", linear.ard_regression, "(3 * l_quantity - 7)::DOUBLE", 3)
_sums("h24_ada_boost_regressor_decided", trees.ada_boost_regressor, TWO_LEVELS, 6)
_sums("h25_bagging_regressor_decided", trees.bagging_regressor, TWO_LEVELS, 6)


@query("h26_accuracy", """SELECT round(avg(CASE WHEN (o_totalprice > 250000) = (o_orderstatus = 'F') THEN 1.0::DOUBLE
  ELSE 0.0::DOUBLE END), 9) AS accuracy FROM orders""")
def h26(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("label"),
                                             (F.col("o_totalprice") > 250000).alias("prediction"))
    return spark.createDataFrame([(round(accuracy(rows), 9),)], "accuracy double")


# Chains predict the line status from numbers and categories with gaps. The status is random, so only the form of the
# result is fixed.
CHAIN_ROWS = f"WITH {PREP} SELECT {{}} FROM prep WHERE split = 'test'"


def _runner(spark, sf, **options):
    return chains.ChainRunner(prep(spark, sf), ROLES, **options)


@query("o1_run_chain", CHAIN_ROWS.format("'2|4|9' AS ops, count(*) AS test_rows, true AS scored"))
def o1(spark, sf):
    """Median imputer, label encoder, standard scaler, then the predictor."""
    runner = _runner(spark, sf)
    result = runner.score([2, 4, 9, 25])
    rows = runner.predict([2, 4, 9])
    return rows.agg(F.lit("|".join(map(str, result["ops"]))).alias("ops"), F.count("*").alias("test_rows"),
                    F.lit(0.0 < result["acc"] < 1.0).alias("scored"))


@query("o2_baseline_and_manual", f"""WITH {PREP} SELECT count(*) AS test_rows, true AS scored, true AS quality_rose
  FROM prep WHERE split = 'test'""")
def o2(spark, sf):
    """A chain that fills gaps has a higher quality score than the unprepared table."""
    runner = _runner(spark, sf)
    plain, manual = runner.baseline(), runner.score([1, 0], with_quality=True)
    return ROLES.test(runner.df).agg(
        F.count("*").alias("test_rows"), F.lit(0 < plain["acc"] < 1 and 0 < manual["acc"] < 1).alias("scored"),
        F.lit(manual["quality"] > plain["quality"]).alias("quality_rose"))


@query("o3_sampled_rows", f"""WITH {PREP} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, split FROM prep
  QUALIFY row_number() OVER (PARTITION BY split ORDER BY md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey,
  l_linenumber, '42')), l_orderkey, l_partkey, l_suppkey, l_linenumber)
  <= least(CASE split WHEN 'train' THEN 400 ELSE 100 END, floor(count(*) OVER (PARTITION BY split) * 0.25))""")
def o3(spark, sf):
    return chains.sample_rows(prep(spark, sf), ROLES).select(*KEYS, "split")


@query("o4_step_scores", CHAIN_ROWS.format("unnest([0, 1, 2, 3]) AS step, true AS scored").replace(
    "FROM prep WHERE split = 'test'", "FROM (SELECT 1 FROM prep LIMIT 1)"))
def o4(spark, sf):
    """One accuracy per chain start, over all rows."""
    runner = chains.ChainRunner(prep(spark, sf).persist(), ROLES)
    scores = runner.step_scores([2, 5, 6])
    return spark.createDataFrame([(i, 0 < s < 1) for i, s in enumerate(scores)], "step int, scored boolean")


def search_chains(spark, sf):
    """Scores a grid of imputers, encoders and scalers on all line items and returns the best chain."""
    rows = prep(spark, sf).persist()
    runner = chains.ChainRunner(rows, ROLES)
    grid = chains.grid_chains(spark, [[1, 2], [4, 5], [None, 9]])
    best = runner.search(grid, dataset="lineitem")
    runner.close()
    rows.unpersist()
    return best


@query("o19_chain_search", f"WITH {PREP} SELECT 'lineitem' AS dataset, true AS valid, count(*) > 0 AS scored FROM prep")
def o19(spark, sf):
    best = search_chains(spark, sf)
    return best.select("dataset", valid_chain(F.col("ops")).alias("valid"),
                       F.col("acc").between(0, 1).alias("scored"))


def flagship(spark, sf):
    """Leaderboard of prepared chains for the line status, on all rows."""
    rows = prep(spark, sf)
    runner = chains.ChainRunner(rows, ROLES)
    table_ = runner.run_table([[2, 4, 9, 25], [1, 5, 6, 25], [25]], dataset="lineitem")
    return table_.orderBy(F.desc("acc"), "ops")
