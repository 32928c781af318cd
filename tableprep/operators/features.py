"""Feature construction and selection on the numeric columns."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from tableprep.functions import factors
from tableprep.functions.columns import Roles, col, filled, number
from tableprep.functions.moments import dot

FEWEST = 3  # fixed value: numeric columns from which on a projection does something


def _others(df: DataFrame, roles: Roles) -> list[Column]:
    numeric = roles.numeric(df)
    return [col(c) for c in df.columns if c not in numeric]


def _check_width(names: list[str], width: int | None) -> None:
    if width is not None and len(names) > width:
        raise ValueError(f"{len(names)} numeric columns, {width} allowed")


def _products(df: DataFrame, roles: Roles, squares: bool, width: int | None) -> DataFrame:
    names = roles.numeric(df)
    if not names:
        return df
    _check_width(names, width)
    # missing numbers are filled once, then multiplied
    staged = df.select(*_others(df, roles), *[filled(df, c, 1.0).alias(c) for c in names])
    terms = [(col(a) * col(b)).alias(f"{a}*{b}") for i, a in enumerate(names)
             for b in names[i if squares else i + 1:]]
    return staged.select("*", *terms)


def polynomial_features(df: DataFrame, roles: Roles = Roles(), width: int | None = None) -> DataFrame:
    """Every number and every product of two, squares included, as `a*b` columns; missing numbers count as 1. With a
    `width`, a table of more numeric columns raises."""
    return _products(df, roles, True, width)


def interaction_features(df: DataFrame, roles: Roles = Roles(), width: int | None = None) -> DataFrame:
    """Every number and every product of two different ones."""
    return _products(df, roles, False, width)


def accepts_pca(df: DataFrame, roles: Roles = Roles()) -> bool:
    """The projection operators ask for more than four columns, more than two of them numeric."""
    return len(roles.features(df)) > 4 and len(roles.numeric(df)) > 2


def _assembled(df: DataFrame, roles: Roles, names: list[str], output: str) -> DataFrame:
    staged = df.select(*_others(df, roles), *[filled(df, c).alias(c) for c in names])
    return VectorAssembler(inputCols=names, outputCol=output).transform(staged)


def _projected(df: DataFrame, roles: Roles, names: list[str], axes: np.ndarray, mean: np.ndarray, prefix: str) -> DataFrame:
    """The numeric columns replaced by their projections on the columns of `axes`, in one projection of the rows."""
    x = [filled(df, c) for c in names]
    return df.select(*_others(df, roles), *[dot(x, axes[:, i], -float(mean @ axes[:, i])).alias(f"{prefix}{i + 1}") for i in range(axes.shape[1])])


def _arrays(df: DataFrame, roles: Roles, names: list[str]) -> DataFrame:
    """The train rows as arrays of numbers."""
    return roles.train(df).select(F.array(*[filled(df, c).cast("double") for c in names]).alias("x"))


def pca(df: DataFrame, roles: Roles = Roles(), components: int | None = None) -> DataFrame:
    """Principal components `PC1..` of the centred numeric columns (`accepts_pca` says when they are worth it).

    Spark ML aggregates the covariance over the partitions; its projection does not centre, so centring comes first.
    The largest loading of a component is made positive.
    """
    names = roles.numeric(df)
    if len(names) < FEWEST:
        return df
    rows = _assembled(df, roles, names, "_raw")
    center = StandardScaler(withMean=True, withStd=False, inputCol="_raw", outputCol="_centred")
    centred = center.fit(roles.train(rows)).transform(rows)
    k = min(components or len(names), len(names))
    model = PCA(k=k, inputCol="_centred", outputCol="_pc").fit(roles.train(centred))
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    projected = model.transform(centred).withColumn("_pc", vector_to_array("_pc"))
    return projected.select(*_others(df, roles), *[(F.col("_pc")[i] * F.lit(float(s or 1.0))).alias(f"PC{i + 1}")
                                                   for i, s in enumerate(signs)])


def pca_auto(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """All components. This and the other projections leave a table of fewer than `FEWEST` numeric columns as it is."""
    return pca(df, roles)


def pca_full(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """All components by full decomposition: the same result as `pca_auto`."""
    return pca(df, roles)


def pca_two(df: DataFrame, roles: Roles = Roles(), components: int = 2) -> DataFrame:
    """The leading components by a Krylov method: no covariance matrix is made, so the columns may be many."""
    names = roles.numeric(df)
    if len(names) < FEWEST:
        return df
    found = factors.leading(_arrays(df, roles, names), len(names), components, center=True)
    return _projected(df, roles, names, found.axes, found.mean, "PC")


def incremental_fit(df: DataFrame, roles: Roles = Roles(), state: factors.Factor | None = None, most: int | None = None) -> factors.Factor:
    """The state after the train rows of one more batch; `factors.save_factor` and `load_factor` keep it. With `most`, that
    many leading directions are carried from batch to batch, else all, and batches give what one table would."""
    names = roles.numeric(df)
    new = factors.factor_of(_arrays(df, roles, names), len(names), most)
    return new if state is None else state.merge(new)


def incremental_transform(df: DataFrame, roles: Roles, state: factors.Factor) -> DataFrame:
    """Projection on the directions of a state, as `PC1..`."""
    names = roles.numeric(df)
    if len(names) != len(state.mean):
        raise ValueError(f"the state was made from {len(state.mean)} columns, the table has {len(names)}")
    return _projected(df, roles, names, state.directions()[1], state.mean, "PC") if names else df


def incremental_pca(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """All components from mergeable states: tasks reduce their rows to a short factor, factors are merged in groups."""
    return incremental_transform(df, roles, incremental_fit(df, roles)) if len(roles.numeric(df)) >= FEWEST else df


def kernel_pca(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Two components with the linear kernel: those of `pca_two` up to sign."""
    return pca(df, roles, 2)


def truncated_svd(df: DataFrame, roles: Roles = Roles(), components: int = 2) -> DataFrame:
    """Projection on the leading right singular vectors of the uncentred columns, as `SVD1..`, by a Krylov method."""
    names = roles.numeric(df)
    if len(names) < FEWEST:
        return df
    found = factors.leading(_arrays(df, roles, names), len(names), components, center=False)
    return _projected(df, roles, names, found.axes, found.mean, "SVD")


def truncated_svd_sparse(df: DataFrame, indices: Column, values: Column, width: int, roles: Roles = Roles(), components: int = 2,
                         output: str = "svd", center: bool = False) -> DataFrame:
    """The same for rows of `width` columns given by the arrays of their filled places (from 0) and numbers, such as one-hot
    columns by the ten thousand: adds the array `output`. With `center` these are the principal components. A row whose
    arrays are null gets null and counts for nothing."""
    rows = df.withColumn("_i", indices.cast("array<int>")).withColumn("_v", values.cast("array<double>"))
    given = F.col("_i").isNotNull() & F.col("_v").isNotNull()
    train, keep = roles.train(rows).where(given).select("_i", "_v"), [*[col(c) for c in df.columns], given.alias("_given")]
    filled_in = [F.when(given, F.col(c)).otherwise(F.array().cast(t)) for c, t in (("_i", "array<int>"), ("_v", "array<double>"))]
    if width > factors.WIDE:
        made = factors.project_wide(rows, keep, *filled_in, *factors.wide_axes(train, width, components, center), output)
    else:
        found = factors.leading(train, width, components, center)
        made = factors.project(rows, keep, filled_in, found.axes, found.mean, output)
    return made.withColumn(output, F.when(F.col("_given"), col(output))).drop("_given")


def truncated_svd_vectors(df: DataFrame, vector: str, roles: Roles = Roles(), components: int = 2, output: str = "svd",
                          center: bool = False) -> DataFrame:
    """The same for a column of Spark ML vectors of one size, sparse or dense, which the array `output` replaces."""
    held = F.unwrap_udt(col(vector))
    width = roles.train(df).agg(F.max(F.coalesce(held["size"], F.size(held["values"])))).first()[0] or 0
    arrays = df.select(*[col(c) for c in df.columns if c != vector], *[c.alias(n) for c, n in zip(factors.sparse_row(col(vector)), ("_si", "_sv"))])
    return truncated_svd_sparse(arrays, F.col("_si"), F.col("_sv"), width, roles, components, output, center).drop("_si", "_sv")


def random_trees_embedding(df: DataFrame, roles: Roles = Roles(), trees: int = 100, depth: int = 5, seed: int = 0,
                           dense: bool = True, width: int | None = None) -> DataFrame:
    """One-hot leaf of each of many random trees, as `embed_0..` columns (or one array of active positions).

    Trees are grown on a random target with one candidate feature per split, so the cuts ignore the label.
    """
    names = roles.numeric(df)
    if not names:
        return df
    _check_width(names, width)
    rows = _assembled(df, roles, names, "_raw")
    target = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c) for c in names], F.lit(seed))), 1, 8), 16, 10)
    train = roles.train(rows).select("_raw", (target.cast("double") / 2.0 ** 32).alias("_y"))
    forest = RandomForestRegressor(featuresCol="_raw", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed,
                                   bootstrap=False, featureSubsetStrategy="1", leafCol="_leaf").fit(train)
    leaves = [(t.numNodes + 1) // 2 for t in forest.trees]
    starts = np.concatenate([[0], np.cumsum(leaves)])
    active = F.zip_with(vector_to_array(F.col("_leaf")), F.array(*[F.lit(int(s)) for s in starts[:-1]]),
                        lambda leaf, start: leaf.cast("int") + start)
    result = forest.transform(rows).select(*_others(df, roles), active.alias("embed"))
    if not dense:
        return result
    hot = [F.when(F.col("embed")[t] == int(starts[t] + i), 1.0).otherwise(0.0).alias(f"embed_{starts[t] + i}")
           for t in range(trees) for i in range(leaves[t])]
    return result.select(*_others(df, roles), *hot)


def variance_filter(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Drops numeric columns that do not vary over the train rows."""
    names = roles.numeric(df)
    if not names:
        return df
    row = roles.train(df).agg(*[(F.min(number(df, c)) == F.max(number(df, c))).alias(f"c{i}")
                                for i, c in enumerate(names)]).first()
    return df.drop(*[c for c, flat in zip(names, row) if flat is None or flat])
