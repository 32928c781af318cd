"""Classifiers made of per-class sums: one aggregation to fit, one projection to predict."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tableprep.functions.columns import Roles
from tableprep.functions.moments import dot
from tableprep.operators.models.common import TARGET, class_sums, classification, linear_scores, scatter

VAR_SMOOTHING = 1e-9  # fixed value: share of the largest variance added to all


def bernoulli_nb(df: DataFrame, roles: Roles = Roles(), alpha: float = 1.0) -> DataFrame:
    """Naive Bayes on whether each number is above 0."""
    task = classification(df, roles)
    rows = {int(r[TARGET]): r for r in task.train.groupBy(TARGET).agg(
        F.count("*").alias("n"), F.array(*[F.count_if(x > 0) for x in task.x]).alias("k")).collect()}
    total = sum(r["n"] for r in rows.values())
    scores = []
    for i in range(len(task.classes)):
        n = rows[i]["n"]
        p = (np.array(rows[i]["k"]) + alpha) / (n + 2 * alpha)
        on = [F.when(x > 0, 1.0).otherwise(0.0) for x in task.x]
        scores.append(dot(on, np.log(p) - np.log(1 - p), math.log(n / total) + float(np.log(1 - p).sum())))
    return task.by_score(scores)


def gaussian_nb(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Naive Bayes with a normal distribution per class and column."""
    task = classification(df, roles)
    sums = class_sums(task)
    var = sums.var + VAR_SMOOTHING * sums.pooled_var.max()
    scores = []
    for i in range(len(task.classes)):
        score = F.lit(float(np.log(sums.n[i] / sums.total) - 0.5 * np.log(2 * np.pi * var[i]).sum()))
        for x, m, v in zip(task.x, sums.mean[i], var[i]):
            score = score - (x - float(m)) * (x - float(m)) * F.lit(float(0.5 / v))
        scores.append(score)
    return task.by_score(scores)


def nearest_centroid(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """The class whose mean is closest."""
    task = classification(df, roles)
    sums = class_sums(task)
    scores = []
    for m in sums.mean:
        distance = F.lit(0.0)
        for x, c in zip(task.x, m):
            distance = distance + (x - float(c)) * (x - float(c))
        scores.append(-distance)
    return task.by_score(scores)


def linear_discriminant(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Normal classes with one shared covariance; the linear scores come from a d x d solve on the driver."""
    task = classification(df, roles)
    sums = class_sums(task)
    center = sums.center
    apart = sums.mean - center
    within = scatter(task, center) - (sums.n[:, None] * apart).T @ apart
    freedom = max(sums.total - len(task.classes), 1.0)
    weights = apart @ np.linalg.pinv(within / freedom, hermitian=True)
    offsets = -0.5 * (weights * apart).sum(axis=1) + np.log(sums.n / sums.total) - weights @ center
    return task.by_score(linear_scores(task, weights, offsets))
