"""Running, scoring and searching chains of operators."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product
from threading import Lock

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tableprep.functions.columns import Roles, col
from tableprep.operators import encode, features, impute, quality, scale
from tableprep.operators.catalog import DONE, EXCLUSIVE, valid_chain
from tableprep.operators.logs import leaderboard
from tableprep.operators.models.common import accuracy
from tableprep.operators.models.linear import logistic_regression
from tableprep.operators.split import DEFAULT_SEED

SAMPLE_SHARE = 0.25    # fixed value: largest part of the rows that a sampled score uses
SMALL_SAMPLE = (400, 100)  # fixed values: train and test rows
LARGE_SAMPLE = (800, 200)  # fixed values

# Operators in id order; each takes (frame, roles) and returns the frame with fitted values applied to every row.
OPERATORS: list[Callable[[DataFrame, Roles], DataFrame]] = [
    impute.category_imputer, impute.mean_imputer, impute.median_imputer, impute.mode_imputer,
    encode.label_encoder, encode.one_hot_encoder,
    scale.min_max_scaler, scale.max_abs_scaler, scale.robust_scaler, scale.standard_scaler,
    scale.quantile_transformer, scale.log_transformer, scale.power_transformer, scale.row_normalizer,
    scale.quantile_bins,
    features.polynomial_features, features.interaction_features, features.pca_auto, features.pca_full,
    features.pca_two, features.incremental_pca, features.kernel_pca, features.truncated_svd,
    features.random_trees_embedding, features.variance_filter,
]

# Operators that only add a projection: their frames cost less to compute from a persisted one than to persist again.
PROJECTIONS = {impute.category_imputer, impute.mean_imputer, impute.median_imputer, impute.mode_imputer, encode.one_hot_encoder,
               scale.min_max_scaler, scale.max_abs_scaler, scale.robust_scaler, scale.standard_scaler}


def sample_rows(df: DataFrame, roles: Roles, sizes: tuple[int, int] = SMALL_SAMPLE, seed: int = DEFAULT_SEED):
    """A seeded sample for quick scores: the given number of train and test rows, a quarter of each at most.

    Rows are taken in the order of a hash of their keys; every task keeps no more rows than are wanted.
    """
    order = F.md5(F.concat_ws("|", *[col(k).cast("string") for k in roles.keys], F.lit(str(seed))))
    counts = {r[0]: r[1] for r in df.groupBy(roles.split).count().collect()}
    parts = []
    for name, size in zip(("train", "test"), sizes):
        keep = min(size, int(counts.get(name, 0) * SAMPLE_SHARE))
        rows = df.filter(col(roles.split) == name).withColumn("_order", order).orderBy("_order", *roles.keys)
        parts.append(rows.limit(keep).drop("_order"))
    return parts[0].unionByName(parts[1])


class ChainRunner:
    """Applies chains to one dataset and scores them. Results of chain starts are kept and shared.

    `keep` is how many prepared frames stay held; 0 computes every frame from the input again. A held frame is persisted,
    unless it is a projection of a persisted one. The predictor sees all numeric columns unless `columns` limits them.
    """

    def __init__(self, df: DataFrame, roles: Roles = Roles(), predictor=logistic_regression, metric=accuracy,
                 keep: int = 4, operators: Sequence[Callable] = OPERATORS, columns: int | None = None):
        self.df, self.roles, self.predictor, self.metric = df, roles, predictor, metric
        self.keep, self.operators, self.columns = keep, operators, columns
        self._frames: OrderedDict[tuple, DataFrame] = OrderedDict()
        self._scores: dict[tuple, dict] = {}
        self._lock = Lock()

    def prepared(self, ops: Sequence[int]) -> DataFrame:
        """The dataset after the operators, built on the longest start that is still held."""
        key = tuple(op for op in ops if op != DONE)
        if not key:
            return self.df
        with self._lock:
            held = self._frames.get(key)
            if held is not None:
                self._frames.move_to_end(key)
                return held
        operator = self.operators[key[-1]]
        frame = operator(self.prepared(key[:-1]), self.roles)
        if not self.keep:
            return frame
        if operator not in PROJECTIONS or not self._on_persisted(key[:-1]):
            frame.persist()
        with self._lock:
            frame = self._frames.setdefault(key, frame)
            old = [k for k in self._frames if k != key[:len(k)]][:max(len(self._frames) - self.keep, 0)]
            for k in old:  # the starts of this chain stay
                self._frames.pop(k).unpersist()
        return frame

    def _on_persisted(self, key: tuple) -> bool:
        """Whether the frame of these operators, or one that it is a projection of, is persisted."""
        while True:
            frame = self._frames.get(key) if key else self.df
            if frame is not None and _persisted(frame):
                return True
            if not key or self.operators[key[-1]] not in PROJECTIONS:
                return False
            key = key[:-1]

    def predict(self, ops: Sequence[int]) -> DataFrame:
        frame = self.prepared(ops)
        names = self.roles.numeric(frame)[:self.columns]
        others = [c for c in frame.columns if c not in self.roles.features(frame)]
        return self.predictor(frame.select(*[col(c) for c in others + names]), self.roles)

    def score(self, ops: Sequence[int], with_quality: bool = False) -> dict:
        """{ops, acc, prepare_seconds, total_seconds[, quality]}; a chain scored before is not run again."""
        key = tuple(op for op in ops if op != DONE)
        if key not in self._scores:
            start = time.monotonic()
            self.prepared(key)
            middle = time.monotonic()
            acc = self.metric(self.predict(key), self.roles.label)
            self._scores[key] = {"ops": list(key), "acc": acc, "prepare_seconds": middle - start,
                                 "total_seconds": time.monotonic() - start}
        result = self._scores[key]
        if with_quality and "quality" not in result:
            rows = self.roles.train(self.prepared(key))
            result["quality"] = quality.scorecard(rows.select(*[col(c) for c in self.roles.features(rows)]))["total"]
        return dict(result)

    def baseline(self) -> dict:
        """Score and quality of the unprepared table."""
        return self.score([], with_quality=True)

    def step_scores(self, ops: Sequence[int]) -> list[float]:
        """Accuracy after no operator, the first, the first two, and so on."""
        ops = [op for op in ops if op != DONE]
        return [self.score(ops[:i])["acc"] for i in range(len(ops) + 1)]

    def search(self, chains: Sequence[Sequence[int]], parallel: int = 2, dataset: str = "dataset",
               higher_is_better: bool = True) -> DataFrame:
        """Scores all chains and returns the best one. Each chain is a set of Spark jobs; a few run side by side."""
        return leaderboard(self.run_table(chains, parallel, dataset), "dataset", higher_is_better)

    def run_table(self, chains: Sequence[Sequence[int]], parallel: int = 2, dataset: str = "dataset") -> DataFrame:
        """(dataset, ops, acc) of every chain."""
        with ThreadPoolExecutor(parallel) as pool:
            scores = list(pool.map(self.score, chains))
        rows = [(dataset, [*s["ops"], DONE], s["acc"]) for s in scores]
        return self.df.sparkSession.createDataFrame(rows, "dataset string, ops array<int>, acc double")

    def close(self) -> None:
        for frame in self._frames.values():
            frame.unpersist()
        self._frames.clear()


def _persisted(df: DataFrame) -> bool:
    return df.storageLevel.useMemory or df.storageLevel.useDisk


def grid_chains(spark: SparkSession, choices: Sequence[Sequence[int | None]]) -> list[list[int]]:
    """Valid chains that take one operator (or none) from each place."""
    chains = [[op for op in c if op is not None] + [DONE] for c in product(*choices)]
    return _valid(spark, chains)


def random_chains(spark: SparkSession, count: int, longest: int = 8, seed: int = DEFAULT_SEED) -> list[list[int]]:
    """Valid random chains: no repeats in a row and one operator per exclusive group."""
    rng = np.random.default_rng(seed)
    group = {op: i for i, ops in enumerate(EXCLUSIVE) for op in ops}
    chains = []
    for _ in range(count):
        chain: list[int] = []
        for _ in range(int(rng.integers(1, longest + 1))):
            used = {group[op] for op in chain if op in group}
            free = [op for op in range(DONE) if group.get(op) not in used and op not in chain[-1:]]
            chain.append(int(rng.choice(free)))
        chains.append([*chain, DONE])
    return _valid(spark, chains)


def _valid(spark: SparkSession, chains: list[list[int]]) -> list[list[int]]:
    rows = spark.createDataFrame([(c,) for c in chains], "ops array<int>").distinct()
    return sorted(list(r["ops"]) for r in rows.filter(valid_chain(F.col("ops"))).collect())
