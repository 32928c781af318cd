"""Shared parts of the predictors: inputs, labels, per-class sums and scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from tableprep.functions.columns import Roles, col, finite_or_zero
from tableprep.functions.moments import dot, gram

MAX_CLASSES = 1_000
FEATURES, TARGET = "_features", "_y"


@dataclass
class Task:
    """Train and test rows of a dataset with cleaned numbers; classes in sorted order."""

    df: DataFrame
    roles: Roles
    names: list[str]
    classes: list = field(default_factory=list)
    rows: int = 0

    @property
    def x(self) -> list[Column]:
        return [col(c) for c in self.names]

    @property
    def train(self) -> DataFrame:
        return self.roles.train(self.df)

    @property
    def test(self) -> DataFrame:
        return self.roles.test(self.df)

    def vectors(self, rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.names, outputCol=FEATURES).transform(rows)

    def class_of(self, index: Column) -> Column:
        return F.get(F.array(*[F.lit(c) for c in self.classes]), index.cast("int"))

    def predicted(self, rows: DataFrame, prediction: Column) -> DataFrame:
        """Test rows as they came in, with a `prediction` column."""
        hidden = {FEATURES, TARGET}
        return rows.select(*[col(c) for c in self.df.columns if c not in hidden], prediction.alias("prediction"))

    def by_score(self, scores: Sequence[Column]) -> DataFrame:
        """Predicts the class with the highest score, the first on ties. One projection of the test rows."""
        return self.predicted(self.test, self.class_of(argmax(scores)))


def argmax(scores: Sequence[Column]) -> Column:
    """Index of the highest score, the first on ties."""
    pairs = F.array(*[F.struct((-s).alias("s"), F.lit(i).alias("i")) for i, s in enumerate(scores)])
    return F.array_min(pairs)["i"] if len(scores) > 1 else F.lit(0)


def _numbers(df: DataFrame, roles: Roles) -> tuple[DataFrame, list[str]]:
    """Keys, split, label and the numeric features with missing and infinite values as 0."""
    names = roles.numeric(df)
    keep = [c for c in df.columns if c not in roles.features(df)]
    return df.select(*[col(c) for c in keep], *[finite_or_zero(df, c).alias(c) for c in names]), names


def classification(df: DataFrame, roles: Roles) -> Task:
    """The label is turned into a class index; the driver holds the list of classes only."""
    seen = roles.train(df).select(roles.label).dropna().groupBy(roles.label).count().limit(MAX_CLASSES + 1).collect()
    classes = sorted(r[0] for r in seen)
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes: use a regressor")
    if not classes:
        raise ValueError("no labelled train row")
    rows, names = _numbers(df, roles)
    codes = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    rows = rows.withColumn(TARGET, F.try_element_at(codes, col(roles.label)))
    task = Task(rows.filter(F.col(TARGET).isNotNull() | (col(roles.split) != "train")), roles, names, classes,
                sum(r[1] for r in seen))
    return task


def regression(df: DataFrame, roles: Roles) -> Task:
    rows, names = _numbers(df, roles)
    rows = rows.withColumn(TARGET, col(roles.label).cast("double"))
    return Task(rows.filter(F.col(TARGET).isNotNull() | (col(roles.split) != "train")), roles, names)


@dataclass
class ClassSums:
    """Counts, means and population variances per class, from one grouped aggregation."""

    n: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    @property
    def total(self) -> float:
        return float(self.n.sum())

    @property
    def center(self) -> np.ndarray:
        return self.n @ self.mean / self.total

    @property
    def pooled_var(self) -> np.ndarray:
        """Variance of each feature over all rows."""
        spread = (self.mean - self.center) ** 2
        return self.n @ (self.var + spread) / self.total


def class_sums(task: Task) -> ClassSums:
    k, d = len(task.classes), len(task.names)
    n, mean, var = np.zeros(k), np.zeros((k, d)), np.zeros((k, d))
    rows = task.train.groupBy(TARGET).agg(F.count("*").alias("n"), F.array(*[F.avg(x) for x in task.x]).alias("m"),
                                          F.array(*[F.var_pop(x) for x in task.x]).alias("v"))
    for r in rows.collect():
        i = int(r[TARGET])
        n[i], mean[i], var[i] = r["n"], r["m"], r["v"]
    return ClassSums(n, mean, var)


def scatter(task: Task, center: np.ndarray) -> np.ndarray:
    """Sum of (x - center)(x - center)' over the train rows."""
    return gram(task.train, dict(zip(task.names, task.x)), center)


def linear_scores(task: Task, weights: np.ndarray, offsets: np.ndarray) -> list[Column]:
    return [dot(task.x, w, b) for w, b in zip(weights, offsets)]


def accuracy(predicted: DataFrame, label: str = "label") -> float | None:
    """Share of rows whose prediction equals the label."""
    return predicted.agg(F.avg(F.coalesce(col(label) == F.col("prediction"), F.lit(False)).cast("double"))).first()[0]


def rmse(predicted: DataFrame, label: str = "label") -> float | None:
    error = col(label).cast("double") - F.col("prediction")
    return predicted.agg(F.sqrt(F.avg(error * error))).first()[0]
