"""Linear predictors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.sql import DataFrame, functions as F

from tableprep.functions.columns import Roles
from tableprep.functions.moments import dot, gram
from tableprep.operators.models.common import (FEATURES, TARGET, Task, class_sums, classification, linear_scores,
                                               regression, scatter)

RIDGE_ALPHAS = (0.1, 1.0, 10.0)  # fixed values
PARALLEL_FITS = 4
STEP_ROWS = 64  # rows whose passive-aggressive steps are averaged into one


def one_vs_rest(task: Task, classifier, rows: DataFrame | None = None) -> DataFrame:
    """Fits one binary model per class on Spark and predicts the test rows."""
    if len(task.classes) == 1:
        return task.by_score([F.lit(0.0)])
    train = (task.vectors(task.train) if rows is None else rows).select(FEATURES, TARGET)
    classifier = classifier.setFeaturesCol(FEATURES).setLabelCol(TARGET)
    if len(task.classes) == 2:  # the fit keeps its rows itself, in blocks
        model = classifier.fit(train)
    else:
        train.persist()  # vectors are made once for all classes
        model = OneVsRest(classifier=classifier, featuresCol=FEATURES, labelCol=TARGET, parallelism=PARALLEL_FITS).fit(train)
        train.unpersist()
    scored = model.transform(task.vectors(task.test).drop(TARGET))
    return task.predicted(scored, task.class_of(F.col("prediction")))


def logistic_regression(df: DataFrame, roles: Roles = Roles(), c: float = 1.0, max_iter: int = 100) -> DataFrame:
    """One-vs-rest logistic regression with an L2 penalty: the model that scores chains.

    Spark minimises the mean loss, so strength 1 / (c * rows) stands for a penalty against the summed loss.
    """
    task = classification(df, roles)
    n = max(task.rows, 1)
    return one_vs_rest(task, LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
                                                maxIter=max_iter))


def sgd_classifier(df: DataFrame, roles: Roles = Roles(), alpha: float = 1e-4, max_iter: int = 100) -> DataFrame:
    """Log loss with a penalty of `alpha`: the objective that stochastic descent approaches, solved directly."""
    task = classification(df, roles)
    return one_vs_rest(task, LogisticRegression(regParam=alpha, elasticNetParam=0.0, standardization=False,
                                                maxIter=max_iter))


def linear_svc(df: DataFrame, roles: Roles = Roles(), c: float = 1.0, max_iter: int = 100) -> DataFrame:
    """Linear support vectors, one-vs-rest, with the plain hinge loss."""
    task = classification(df, roles)
    n = max(task.rows, 1)
    return one_vs_rest(task, LinearSVC(regParam=1.0 / (c * n), standardization=False, maxIter=max_iter))


def _ridge_parts(task: Task):
    sums = class_sums(task)
    center = sums.center
    cross = 2 * sums.n[:, None] * (sums.mean - center)  # X'y of the centred +1/-1 targets
    return sums, center, scatter(task, center), cross


def _ridge_fit(sums, center, moments, cross, alpha: float):
    weights = np.linalg.solve(moments + alpha * np.eye(len(center)), cross.T).T
    return weights, 2 * sums.n / sums.total - 1 - weights @ center


def ridge_classifier(df: DataFrame, roles: Roles = Roles(), alpha: float = 1.0) -> DataFrame:
    """Ridge regression on +1/-1 targets per class, from one matrix of second moments."""
    task = classification(df, roles)
    return task.by_score(linear_scores(task, *_ridge_fit(*_ridge_parts(task), alpha)))


def ridge_classifier_cv(df: DataFrame, roles: Roles = Roles(), alphas=RIDGE_ALPHAS) -> DataFrame:
    """As `ridge_classifier`, with the alpha of least leave-one-out error.

    The left-out residual of a row is e / (1 - h), so one more scan scores all alphas.
    """
    task = classification(df, roles)
    sums, center, moments, cross = _ridge_parts(task)
    fits = [_ridge_fit(sums, center, moments, cross, a) for a in alphas]
    inverses = [np.linalg.inv(moments + a * np.eye(len(center))) for a in alphas]
    n, k, names = sums.total, len(task.classes), task.names

    def errors(batches):
        total = np.zeros(len(alphas))
        for pdf in batches:
            x = pdf[names].to_numpy()
            y = np.where(np.arange(k) == pdf[TARGET].to_numpy()[:, None], 1.0, -1.0)
            for i, ((w, b), inverse) in enumerate(zip(fits, inverses)):
                leverage = 1 / n + np.einsum("ij,jk,ik->i", x - center, inverse, x - center)
                total[i] += (((y - x @ w.T - b) / (1 - leverage)[:, None]) ** 2).sum()
        yield pd.DataFrame({"i": range(len(alphas)), "e": total})

    rows = task.train.select(*task.x, TARGET).mapInPandas(errors, "i int, e double")
    best = rows.groupBy("i").agg(F.sum("e").alias("e")).orderBy("e", "i").first()["i"]
    return task.by_score(linear_scores(task, *fits[best]))


def passive_aggressive(df: DataFrame, roles: Roles = Roles(), c: float = 1.0, epochs: int = 5) -> DataFrame:
    """Passive-aggressive updates (PA-I, one-vs-rest) by iterative parameter mixing.

    An epoch starts everywhere from the shared weights. A task updates its own by one step per Arrow batch, the mean of its
    rows' PA-I steps as matrix products; the tasks' weights are averaged, and so on.
    """
    task = classification(df, roles)
    k, names = len(task.classes), task.names
    weights = np.zeros((k, len(names) + 1))
    for _ in range(epochs):
        start = weights

        def epoch(batches):
            w, n = start.copy(), 0
            for pdf in batches:
                every = np.column_stack([pdf[names].to_numpy(), np.ones(len(pdf))])
                signs = np.where(np.arange(k) == pdf[TARGET].to_numpy()[:, None], 1.0, -1.0)
                for x, y in zip(np.array_split(every, -(-len(every) // STEP_ROWS)), np.array_split(signs, -(-len(every) // STEP_ROWS))):
                    loss = np.maximum(0.0, 1 - y * (x @ w.T))
                    active = np.maximum(1, (loss > 0).sum(axis=0))  # rows that ask for a step, per class
                    w += ((np.minimum(c, loss / (x ** 2).sum(axis=1)[:, None]) * y).T @ x) / active[:, None]
                n += len(pdf)
            if n:
                yield pd.DataFrame({"n": [n], "w": [w.ravel().tolist()]})

        parts = task.train.select(*task.x, TARGET).mapInPandas(epoch, "n long, w array<double>")
        mixed = parts.select("n", F.posexplode("w").alias("i", "v")).groupBy("i").agg(
            (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v")).collect()
        weights = np.array([r["v"] for r in sorted(mixed, key=lambda r: r["i"])]).reshape(weights.shape)
    return task.by_score(linear_scores(task, weights[:, :-1], weights[:, -1]))


def ard_regression(df: DataFrame, roles: Roles = Roles(), max_iter: int = 300, tol: float = 1e-3,
                   prune: float = 1e4, prior: float = 1e-6) -> DataFrame:
    """Bayesian regression with one precision per weight; weights of very high precision are dropped.

    Spark sums the second moments of columns and target once; the iterations are on d x d matrices.
    """
    task = regression(df, roles)
    d = len(task.names)
    columns = {**dict(zip(task.names, task.x)), TARGET: F.col(TARGET)}
    row = task.train.agg(F.count("*"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(columns.values())]).first()
    n, center = row[0], np.array(row[1:])
    moments = gram(task.train, columns, center)
    xx, xy, yy = moments[:d, :d], moments[:d, d], moments[d, d]
    alpha, precision = n / (yy + 1e-12), np.ones(d)
    weights, kept = np.zeros(d), np.ones(d, dtype=bool)
    for _ in range(max_iter):
        if not kept.any():
            break
        old = weights.copy()
        part = np.ix_(kept, kept)
        sigma = np.linalg.pinv(np.diag(precision[kept]) + alpha * xx[part], hermitian=True)
        weights = np.zeros(d)
        weights[kept] = alpha * sigma @ xy[kept]
        used = 1 - precision[kept] * np.diag(sigma)
        precision[kept] = (used + 2 * prior) / (weights[kept] ** 2 + 2 * prior)
        residual = max(yy - 2 * weights @ xy + weights @ xx @ weights, 0.0)
        alpha = (n - used.sum() + 2 * prior) / (residual + 2 * prior)
        kept &= precision < prune
        weights[~kept] = 0.0
        if np.abs(old - weights).sum() < tol:
            break
    return task.predicted(task.test, dot(task.x, weights, center[d] - weights @ center[:d]))
