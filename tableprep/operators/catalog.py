"""The numbered operators that a chain is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Operator names in id order, by category.
CATALOG = {
    "Imputer": ["ImputerCatPrim", "ImputerMeanPrim", "ImputerMedianPrim", "ImputerNumPrim"],
    "Encoder": ["LabelEncoderPrim", "OneHotEncoderPrim"],
    "Fprocessor": ["MinMaxScalerPrim", "MaxAbsScalerPrim", "RobustScalerPrim", "StandardScalerPrim",
                   "QuantileTransformerPrim", "LogTransformerPrim", "PowerTransformerPrim", "NormalizerPrim",
                   "KBinsDiscretizerOrdinalPrim"],
    "Fengine": ["PolynomialFeaturesPrim", "InteractionFeaturesPrim", "PCA_AUTO_Prim", "PCA_LAPACK_Prim",
                "PCA_ARPACK_Prim", "IncrementalPCA_Prim", "KernelPCA_Prim", "TruncatedSVD_Prim",
                "RandomTreesEmbeddingPrim"],
    "Fselection": ["VarianceThresholdPrim"],
}
DONE_NAME = "LogisticRegressionPrim"
# At most one operator of each group may be in a chain.
EXCLUSIVE = [[1, 2, 3], [4, 5], [6, 7, 8, 9], [15, 16, 23], [17, 18, 19, 20, 21, 22]]
# Bonus for finishing after an operator of the category.
FINISH_BONUS = {"Imputer": 1, "Encoder": 1, "Fprocessor": 5, "Fengine": 5, "Fselection": 5}

NAMES = [name for names in CATALOG.values() for name in names]
CATEGORIES = [category for category, names in CATALOG.items() for _ in names]
DONE = len(NAMES)


def catalog_table(spark: SparkSession) -> DataFrame:
    """(op, name, category) of the operators and of the final predictor."""
    rows = [(i, n, c) for i, (n, c) in enumerate(zip(NAMES, CATEGORIES))] + [(DONE, DONE_NAME, "Predictor")]
    return spark.createDataFrame(rows, "op int, name string, category string")


def category_of(op: Column) -> Column:
    return F.get(F.lit([*CATEGORIES, "Predictor"]), op.cast("int"))


def find_operator(name: Column) -> Column:
    """Id of the first operator whose name contains the text or is contained in it; otherwise the final step."""
    text = F.regexp_replace(name, "[<>]", "")
    result = F.lit(DONE)
    for i in reversed(range(DONE)):
        result = F.when(F.lit(NAMES[i]).contains(text) | text.contains(NAMES[i]), F.lit(i)).otherwise(result)
    return F.when(text == "blank", F.lit(DONE)).otherwise(result)


def describe_operators(ops: list[int]) -> str:
    names = [*NAMES, DONE_NAME]
    lines = ["(op_id. Name):", *[f"{i}. {names[i]}" for i in ops]]
    return "\n".join(lines + (["(the final step ends the chain)"] if DONE in ops else []))


def one_per_group(ops: Column) -> Column:
    """At most one operator of every exclusive group."""
    ok = F.lit(True)
    for group in EXCLUSIVE:
        ok = ok & (F.size(F.filter(ops, lambda x: x.isin(group))) <= 1)
    return ok


def valid_chain(ops: Column, one_per_category: bool = False) -> Column:
    """No operator twice in a row, nothing after the final step, one operator per exclusive group.

    `one_per_category` also asks that no category occurs twice.
    """
    before = F.slice(ops, F.lit(1), F.greatest(F.size(ops) - 1, F.lit(0)))
    after = F.slice(ops, F.lit(2), F.size(ops))
    repeats = F.exists(F.zip_with(before, after, lambda a, b: a == b), lambda same: same)
    ok = ~repeats & ~F.array_contains(before, DONE) & one_per_group(ops)
    if one_per_category:
        kinds = F.transform(F.filter(ops, lambda x: x < DONE), category_of)
        ok = ok & (F.size(F.array_distinct(kinds)) == F.size(kinds))
    return ok


def allowed_next(chosen: int, candidates: list[int]) -> list[int]:
    """Candidates left after an operator was chosen: its exclusive group goes."""
    if chosen == DONE:
        return candidates
    gone = {op for group in EXCLUSIVE if chosen in group for op in group}
    return [c for c in candidates if c not in gone]
