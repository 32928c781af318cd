"""Imputers, encoders, scalers and feature operators on line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprep.functions import factors
from tableprep.operators import encode, features, impute, scale
from tableprep.plans.registry import query, scratch, table
from tableprep.plans.tables import KEYS, NUMBERS, PREP, ROLES, prep, rounded

ID = ", ".join(f"p.{k}" for k in KEYS)
REST = "p.flag, p.label, p.split"


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def sql(fit: str, columns: list[str], rest: str = REST, extra: str = "") -> str:
    """`fit` is the select list of the train statistics; `columns` are built from p (rows) and f (statistics)."""
    return (f"WITH {PREP}{extra}, f AS (SELECT {fit} FROM prep WHERE split = 'train') "
            f"SELECT {', '.join([ID, *columns, rest])} FROM prep p, f")


def z(c: str, alias: str = "p") -> str:
    return f"coalesce({alias}.{c}, 0.0)"


def _rows(operator):
    return lambda spark, sf: rounded(operator(prep(spark, sf), ROLES))


def _fill(statistic: str) -> str:
    """Only quantity and discount have gaps."""
    return sql(f"{statistic.format('quantity')} AS q, {statistic.format('discount')} AS d",
               [r6("coalesce(p.quantity, f.q)", "quantity"), r6("p.price", "price"),
                r6("coalesce(p.discount, f.d)", "discount"), r6("p.tax", "tax")])


def _mode(c: str) -> str:
    return (f"(SELECT {c} FROM prep WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


RAW = [r6(f"p.{c}", c) for c in NUMBERS]

query("d1_mean_imputer", _fill("avg({})"))(_rows(impute.mean_imputer))
query("d2_median_imputer", _fill("median({})"))(_rows(impute.median_imputer))
query("d3_mode_imputer", sql(f"{_mode('quantity')} AS q, {_mode('discount')} AS d, count(*) AS n", [
    r6("coalesce(p.quantity, f.q)", "quantity"), r6("p.price", "price"), r6("coalesce(p.discount, f.d)", "discount"),
    r6("p.tax", "tax")]))(_rows(impute.mode_imputer))
query("d4_category_imputer", sql(f"{_mode('flag')} AS m, count(*) AS n", RAW,
                                 "coalesce(p.flag, f.m) AS flag, p.label, p.split"))(_rows(impute.category_imputer))
query("d5_constant_fill", sql("count(*) AS n", [r6(z(c), c) for c in NUMBERS]))(_rows(impute.constant_fill))
query("d1_mean_imputer_refit", f"""WITH {PREP}, f AS (SELECT split, avg(quantity) AS q, avg(discount) AS d FROM prep
  GROUP BY split) SELECT {ID}, {r6('coalesce(p.quantity, f.q)', 'quantity')}, {r6('p.price', 'price')},
  {r6('coalesce(p.discount, f.d)', 'discount')}, {r6('p.tax', 'tax')}, {REST}
  FROM prep p JOIN f ON f.split = p.split""")(
    lambda spark, sf: rounded(impute.mean_imputer(prep(spark, sf), ROLES, refit_test=True)))

# label is not a feature, so flag is the only category; its train values are A, N, R and MISSING
query("e1_one_hot_encoder", sql("count(*) AS n", [
    *RAW, *[f"CASE WHEN coalesce(p.flag, 'MISSING') = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag_{v}"
            for v in ("A", "MISSING", "N", "R")]], "p.label, p.split"))(_rows(encode.one_hot_encoder))
query("e2_label_encoder", f"""WITH {PREP}, v AS (SELECT DISTINCT coalesce(flag, 'MISSING') AS v FROM prep
  WHERE split = 'train' UNION SELECT 'Unknown'), c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM v)
  SELECT {ID}, {', '.join(RAW)}, cast(coalesce(c.code, (SELECT code FROM c WHERE v = 'Unknown')) AS DOUBLE) AS flag,
  p.label, p.split FROM prep p LEFT JOIN c ON c.v = coalesce(p.flag, 'MISSING')""")(_rows(encode.label_encoder))


def _scaled(fit: str, expression: str) -> str:
    fits = ", ".join(fit.replace("$x", z(c, "prep")).replace("$n", c) for c in NUMBERS)
    return sql(fits, [r6(expression.replace("$x", z(c)).replace("$n", c), c) for c in NUMBERS])


query("f1_min_max_scaler", _scaled("min($x) AS lo_$n, max($x) AS hi_$n",
                                   "($x - lo_$n) / CASE WHEN hi_$n = lo_$n THEN 1 ELSE hi_$n - lo_$n END"))(
    _rows(scale.min_max_scaler))
query("f2_max_abs_scaler", _scaled("max(abs($x)) AS m_$n", "$x / CASE WHEN m_$n = 0 THEN 1 ELSE m_$n END"))(
    _rows(scale.max_abs_scaler))
query("f3_robust_scaler", _scaled(
    "median($x) AS m_$n, quantile_cont($x, 0.75) - quantile_cont($x, 0.25) AS s_$n",
    "($x - m_$n) / CASE WHEN s_$n = 0 THEN 1 ELSE s_$n END"))(_rows(scale.robust_scaler))
query("f4_standard_scaler", _scaled("avg($x) AS m_$n, stddev_pop($x) AS s_$n",
                                    "($x - m_$n) / CASE WHEN s_$n = 0 THEN 1 ELSE s_$n END"))(
    _rows(scale.standard_scaler))
query("f7_log_transformer", _scaled("min($x) AS m_$n", "CASE WHEN m_$n >= 0 THEN ln(1 + $x) ELSE $x END"))(
    _rows(scale.log_transformer))
NORM = "sqrt(" + " + ".join(f"{z(c)} * {z(c)}" for c in NUMBERS) + ")"
query("f8_row_normalizer", sql("count(*) AS n", [
    r6(f"{z(c)} / CASE WHEN {NORM} = 0 THEN 1 ELSE {NORM} END", c) for c in NUMBERS]))(_rows(scale.row_normalizer))

EDGES = ", ".join(f"round(quantile_cont({z(c, 'prep')}, {i / 5}), 9) AS e{i}_{c}" for c in NUMBERS for i in range(6))
BINS = [" + ".join(f"(CASE WHEN round({z(c)}, 9) >= f.e{i}_{c} AND f.e{i}_{c} - f.e{i - 1}_{c} > 1e-8 "
                   f"AND f.e5_{c} - f.e{i}_{c} > 1e-8 THEN 1 ELSE 0 END)" for i in range(1, 5)) for c in NUMBERS]
query("f9_quantile_bins", sql(EDGES, [f"cast({b} AS DOUBLE) AS {c}" for b, c in zip(BINS, NUMBERS)]))(
    _rows(scale.quantile_bins))


def _grid_place(c: str) -> str:
    """Place of a value among the 1000 quantiles: linear between neighbours, the middle of a run of equal ones."""
    return f"""g_{c} AS (SELECT round(q, 9) AS q, avg(i) / 999.0 AS mid, min(i) / 999.0 AS lo, max(i) / 999.0 AS hi FROM (
  SELECT unnest(quantile_cont({z(c, 'prep')}, [t / 999.0 FOR t IN range(0, 1000)])) AS q,
    unnest(range(0, 1000)) AS i FROM prep WHERE split = 'train') GROUP BY round(q, 9)),
n_{c} AS (SELECT q, hi, mid, lead(q) OVER (ORDER BY q) AS q2, lead(lo) OVER (ORDER BY q) AS lo2 FROM g_{c})"""


query("f5_quantile_transformer", f"""WITH {PREP}, {', '.join(_grid_place(c) for c in NUMBERS)}
  SELECT {ID}, {', '.join(r6(f'''CASE WHEN n_{c}.q IS NULL THEN 0.0 WHEN round({z(c)}, 9) = n_{c}.q
    THEN CASE WHEN n_{c}.q2 IS NULL THEN (n_{c}.mid * 2 - n_{c}.hi + 1) / 2 WHEN n_{c}.mid = n_{c}.hi THEN n_{c}.mid
    ELSE n_{c}.mid END WHEN n_{c}.q2 IS NULL THEN 1.0
    ELSE n_{c}.hi + (n_{c}.lo2 - n_{c}.hi) * ({z(c)} - n_{c}.q) / (n_{c}.q2 - n_{c}.q) END''', c) for c in NUMBERS)},
  {REST} FROM prep p {' '.join(f'ASOF LEFT JOIN n_{c} ON round({z(c)}, 9) >= n_{c}.q' for c in NUMBERS)}""")(
    _rows(scale.quantile_transformer))


@query("f6_power_transformer", f"""WITH {PREP} SELECT cast(count(*) AS BIGINT) AS n, {', '.join(
    f'0.0::DOUBLE AS mean_{c}, 1.0::DOUBLE AS std_{c}' for c in NUMBERS)} FROM prep WHERE split = 'train'""")
def f6(spark, sf):
    """The transformed train columns have mean 0 and deviation 1."""
    rows = ROLES.train(scale.power_transformer(prep(spark, sf), ROLES))
    return rounded(rows.agg(F.count("*").alias("n"), *[e for c in NUMBERS for e in (
        F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))]), 5)


def one(c: str) -> str:
    return f"coalesce(p.{c}, 1.0)"


PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i:]]
query("g1_polynomial_features", sql("count(*) AS n", [
    *[r6(one(c), c) for c in NUMBERS], *[f'round({one(a)} * {one(b)}, 4) + 0.0 AS "{a}*{b}"' for a, b in PAIRS]]))(
    lambda spark, sf: _products(features.polynomial_features(prep(spark, sf), ROLES)))
query("g2_interaction_features", sql("count(*) AS n", [
    *[r6(one(c), c) for c in NUMBERS],
    *[f'round({one(a)} * {one(b)}, 4) + 0.0 AS "{a}*{b}"' for a, b in PAIRS if a != b]]))(
    lambda spark, sf: _products(features.interaction_features(prep(spark, sf), ROLES)))


def _products(df):
    plain, products = [c for c in df.columns if "*" not in c], [c for c in df.columns if "*" in c]
    staged = rounded(df.select(*plain, *[F.col(f"`{c}`") for c in products]))
    return staged.select(*plain, *[(F.round(F.col(f"`{c}`"), 4) + 0.0).alias(c) for c in products])


VARIANCE = " + ".join(f"var_pop({z(c, 'prep')})" for c in NUMBERS)


def _variance_query(name, operator, oracle):
    @query(name, oracle)
    def run(spark, sf):
        """Variances of the components over the train rows."""
        rows = ROLES.train(operator(prep(spark, sf), ROLES))
        names = ROLES.numeric(rows)
        total = sum((F.var_pop(c) for c in names[1:]), F.var_pop(names[0]))
        return rows.agg(F.count("*").alias("n"), F.lit(len(names)).cast("long").alias("components"),
                        F.round(total / 1e6, 3).alias("variance"),
                        F.round(F.abs(F.avg(names[0])) + 0.0, 3).alias("mean"))
    return run


def _all_components():
    return (f"WITH {PREP} SELECT count(*) AS n, 4::BIGINT AS components, round(({VARIANCE}) / 1e6, 3) AS variance, "
            f"0.0::DOUBLE AS mean FROM prep WHERE split = 'train'")


_variance_query("g3_pca_auto", features.pca_auto, _all_components())
_variance_query("g4_pca_full", features.pca_full, _all_components())
_variance_query("g6_incremental_pca", features.incremental_pca, _all_components())


def _in_two_batches(rows, roles):
    """The second batch of rows meets the saved state of the first."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    first = F.col("l_linenumber") <= 3
    factors.save_factor(spark, features.incremental_fit(rows.filter(first), roles), path)
    return features.incremental_transform(rows, roles, features.incremental_fit(rows.filter(~first), roles, factors.load_factor(spark, path)))


_variance_query("g6_incremental_pca_two_batches", _in_two_batches, _all_components())


def _two_components():
    """Price dwarfs the other columns, so the first two components hold all but the two smallest variances (< 1e-2)."""
    return (f"WITH {PREP} SELECT count(*) AS n, 2::BIGINT AS components, round(({VARIANCE}) / 1e6, 3) AS variance, "
            f"0.0::DOUBLE AS mean FROM prep WHERE split = 'train'")


_variance_query("g5_pca_two", features.pca_two, _two_components())
_variance_query("g7_kernel_pca", features.kernel_pca, _two_components())


@query("g8_truncated_svd", f"""WITH {PREP} SELECT count(*) AS n, round(({' + '.join(
    f'sum({z(c, "prep")} * {z(c, "prep")})' for c in NUMBERS)}) / 1e9, 2) AS energy FROM prep WHERE split = 'train'""")
def g8(spark, sf):
    """Two directions hold the whole energy of these columns, up to the two smallest ones."""
    rows = ROLES.train(features.truncated_svd(prep(spark, sf), ROLES))
    return rows.agg(F.count("*").alias("n"),
                    F.round(F.sum(F.col("SVD1") * F.col("SVD1") + F.col("SVD2") * F.col("SVD2")) / 1e9, 2).alias("energy"))


@query("g8_truncated_svd_wide", """SELECT sum(e) AS energy, max(e) AS largest FROM (SELECT round(sum(l_quantity * l_quantity), 3) AS e
  FROM lineitem GROUP BY l_partkey ORDER BY e DESC LIMIT 2)""")
def g8_wide(spark, sf):
    """One column per part, holding the quantity: the leading directions are the parts with the largest sums of squares."""
    items = table(spark, sf, "lineitem").select("l_partkey", "l_quantity")
    width = items.agg(F.max("l_partkey")).first()[0] + 1
    made = features.truncated_svd_sparse(items, F.array("l_partkey"), F.array("l_quantity"), width)
    sums = made.agg(*[F.sum(F.col("svd")[i] * F.col("svd")[i]).alias(f"e{i}") for i in range(2)])
    return sums.select(F.round(F.col("e0") + F.col("e1"), 3).alias("energy"), F.round("e0", 3).alias("largest"))


@query("g9_random_trees_embedding", f"""WITH {PREP} SELECT count(*) AS n, 100::BIGINT AS trees FROM prep""")
def g9(spark, sf):
    """Every row has one active leaf per tree."""
    rows = features.random_trees_embedding(prep(spark, sf), ROLES, dense=False)
    return rows.agg(F.count("*").alias("n"), F.max(F.size(F.array_distinct("embed"))).cast("long").alias("trees"))


@query("g10_variance_filter", f"WITH {PREP} SELECT {ID}, {', '.join(RAW)}, {REST} FROM prep p")
def g10(spark, sf):
    return rounded(features.variance_filter(prep(spark, sf).withColumn("constant", F.lit(1.0)), ROLES))
