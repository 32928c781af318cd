"""Data-quality scores of a whole table, 0 to 100."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import StandardScaler, Tokenizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableprep.functions.columns import (col, dtype, filled, is_missing, number, numeric_columns, string_columns)
from tableprep.functions.nearest import neighbours_within
from tableprep.functions.ordered import running_sums
from tableprep.functions.quantiles import counted_quantiles, exact_quantiles, sketched
from tableprep.operators.cleanup import any_date
from tableprep.operators.guards import is_not_a_number
from tableprep.session import cut_lineage

# Starts of a text that count as a date or a time.
DATE_PATTERNS = [
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\d{2}/\d{2}/\d{2}",
    r"\d{4}年\d{2}月\d{2}日",
    r"\d{2}年\d{2}月\d{2}日",
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}",
    r"\d{2}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}",
    r"\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}",
    r"\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}",
    r"\d{4}年\d{2}月\d{2}日 \d{2}:\d{2}:\d{2}",
    r"\d{2}年\d{2}月\d{2}日 \d{2}:\d{2}:\d{2}",
]
VALID_TEXT = r"^[A-Za-z0-9_]+$"  # fixed value
FREE_DAYS, MOST_DAYS = 3, 97     # fixed values: days before points are lost, most points lost
MARKER = "timestamp_column"      # fixed value: a column of this name switches timeliness on
DATES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _score(bad: int, cells: int) -> float:
    return (1 - bad / cells) * 100 if cells else 100.0


def _total(counts: Sequence[Column]) -> Column:
    return sum(counts, F.lit(0))


def _empty_cells(df: DataFrame) -> list[Column]:
    texts = string_columns(df)
    return [F.count_if(is_missing(df, c) | (col(c) == "") if c in texts else is_missing(df, c)) for c in df.columns]


def _invalid_cells(df: DataFrame) -> list[Column]:
    return [F.count_if(~col(c).rlike(VALID_TEXT)) for c in string_columns(df)]


def completeness(df: DataFrame) -> float:
    """Share of cells that are neither missing nor an empty text."""
    n, bad = df.agg(F.count("*"), _total(_empty_cells(df))).first()
    return _score(bad, n * len(df.columns))


def validity(df: DataFrame) -> float:
    """Share of cells that are not texts with other characters than letters, digits and underscores."""
    n, bad = df.agg(F.count("*"), _total(_invalid_cells(df))).first()
    return _score(bad, n * len(df.columns))


def is_date_value(x: Column) -> Column:
    """The value parses as a date or starts like one."""
    text = x.cast("string")
    return F.coalesce(F.try_to_timestamp(text).isNotNull() | text.rlike("^(?:" + "|".join(DATE_PATTERNS) + ")"),
                      F.lit(False))


def date_columns(df: DataFrame, share: float = 0.9) -> list[str]:
    """Date columns, and text columns where at least `share` of the rows hold a date. One aggregation."""
    texts = string_columns(df)
    row = df.agg(F.count("*"), *[F.count_if(is_date_value(col(c))).alias(f"c{i}") for i, c in enumerate(texts)]).first()
    found = [c for c, k in zip(texts, row[1:]) if row[0] and k / row[0] >= share]
    return [c for c in df.columns if c in found or isinstance(dtype(df, c), DATES)]


def timeliness(df: DataFrame, now: datetime.datetime | None = None) -> tuple[float, int]:
    """(score, number of values older than three days).

    A value loses one point for each full day beyond three, 97 at most; date columns are averaged. Missing values, and
    texts in none of the known spellings, neither score nor count as old.
    """
    names = date_columns(df)
    if not names:
        return 0.0, 0
    now_micros = F.unix_micros(F.lit(now.isoformat(sep=" ")).cast("timestamp") if now else F.current_timestamp())

    def days(c: str) -> Column:
        ts = any_date(col(c)) if c in string_columns(df) else col(c).cast("timestamp")
        return F.floor((now_micros - F.unix_micros(ts)) / 86_400_000_000)

    # least and greatest pass over a null; a date that is missing or unreadable must not score at all
    lost = [F.when(days(c).isNotNull(), F.least(F.greatest(days(c) - FREE_DAYS, F.lit(0)), F.lit(MOST_DAYS))) for c in names]
    row = df.agg(_total([F.count_if(days(c) > FREE_DAYS) for c in names]),
                 *[F.avg(100 - x).alias(f"c{i}") for i, x in enumerate(lost)]).first()
    scores = [s for s in row[1:] if s is not None]
    return (sum(scores) / len(scores) if scores else 0.0), row[0]


def iqr_outliers(df: DataFrame, gap: float = 1.5, independent: bool = False) -> int:
    """Values outside the quartiles by more than `gap` interquartile ranges, missing numbers counting as 0.

    Columns are taken in order, and rows with an outlier are left out for the columns after it. The rows left are only
    ever described by a filter on the bounds found so far, applied right after the scan; nothing is cached. Each row leaves
    at its first outlier, so the outliers are the rows that are gone at the end.
    `independent` looks at every column over all rows at once.
    """
    x = {c: filled(df, c) for c in numeric_columns(df)}

    def outside(c: str, q: list[float]) -> Column:
        return (x[c] < q[0] - gap * (q[1] - q[0])) | (x[c] > q[1] + gap * (q[1] - q[0]))

    if independent:
        bounds = exact_quantiles(df, x, [0.25, 0.75])
        tests = [outside(c, q) for c, q in bounds.items() if q[0] is not None]
        return df.agg(_total([F.count_if(t) for t in tests])).first()[0] if tests else 0
    left, start = df, None
    sketch = sketched(df, x, [0.25, 0.75])  # one for all columns; the rows that leave hardly move the quartiles
    for c in x:
        rows, q = counted_quantiles(left, {c: x[c]}, [0.25, 0.75], sketch)[c]
        start = rows if start is None else start
        if not rows:
            return start if start is not None else 0
        left = left.filter(~outside(c, q))
    return start - left.count() if x else 0


def accuracy(df: DataFrame, gap: float = 1.5) -> float:
    """100 minus the percentage of cells that are outliers."""
    return _score(iqr_outliers(df, gap), df.count() * len(df.columns))


def scorecard(df: DataFrame, now: datetime.datetime | None = None) -> dict[str, float | None]:
    """Completeness, validity, accuracy, timeliness (if the table has the marker column) and their mean.

    The counts of completeness and validity share one scan.
    """
    n, empty, invalid = df.agg(F.count("*"), _total(_empty_cells(df)), _total(_invalid_cells(df))).first()
    cells = n * len(df.columns)
    scores = {"completeness": _score(empty, cells), "validity": _score(invalid, cells),
              "accuracy": _score(iqr_outliers(df), cells),
              "timeliness": timeliness(df, now)[0] if MARKER in df.columns else None}
    known = [s for s in scores.values() if s is not None]
    return {**scores, "total": sum(known) / len(known)}


def two_means(counts: DataFrame) -> DataFrame:
    """(c, first, second): the centres of the best two clusters of every column c, from (c, v, n) with distinct values.

    In one dimension the best clusters are the values up to some cut and those above it. Running counts and sums over the
    sorted values give the spread between both sides at every cut, so all columns take one pass and no iterations. What is
    broadcast here and below is one row per column.
    """
    whole = counts.groupBy("c").agg(F.sum("n").alias("all"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    centred = counts.join(F.broadcast(whole), "c").withColumn("s", (F.col("v") - F.col("mean")) * F.col("n"))
    cuts = running_sums(centred, "c", "v", ["n", "s"])
    below, above = F.col("upto_n"), F.col("all") - F.col("upto_n")
    between = F.when(above > 0, F.col("upto_s") * F.col("upto_s") / below / above)
    best = F.max_by(F.struct((F.col("mean") + F.col("upto_s") / below).alias("first"), (F.col("mean") - F.col("upto_s") / above).alias("second")),
                    F.when(above > 0, F.struct(between, -F.col("v"))))
    found = cuts.groupBy("c").agg(best.alias("m"), F.first("mean").alias("mean"))
    return found.select("c", F.coalesce("m.first", "mean").alias("first"), F.coalesce("m.second", "mean").alias("second"))


def _quantile_of_counts(counts: DataFrame, share: float) -> DataFrame:
    """(c, edge): the quantile of every column, between neighbouring ranks in a straight line, from (c, d, n) with distinct d."""
    whole = counts.groupBy("c").agg(F.sum("n").alias("all"))
    upto = running_sums(counts.join(F.broadcast(whole), "c"), "c", "d", ["n"])
    place = (F.col("all") - 1) * share
    at = lambda rank: F.min(F.when(F.col("upto_n") > rank, F.col("d")))
    found = upto.groupBy("c").agg(at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high"), F.first(place - F.floor(place)).alias("rest"))
    return found.select("c", (F.col("low") + (F.col("high") - F.col("low")) * F.col("rest")).alias("edge"))


def kmeans_outliers(df: DataFrame, share: float = 0.95) -> int:
    """Per column the two best clusters; values farther from the nearer centre than `share` of the column count as outliers.

    Text cells that are no numbers are outliers too. A row dropped for a bad cell stays out for later columns, and rows with a
    missing cell are left out. Values that are not finite are left aside. The clusters are those of least spread (of equal
    ones, the lowest cut); all columns are counted in one pass.
    """
    bad, x = [], []
    for i, c in enumerate(df.columns):
        text = c in string_columns(df)
        bad.append(F.when(is_not_a_number(col(c)) if text else F.lit(False), F.lit(i)))
        x.append(F.trim(col(c)).try_cast("double") if text else number(df, c).cast("double"))
    gone = F.coalesce(*bad, F.lit(len(x)))
    cells = [F.struct(F.lit(i).alias("c"), v.alias("v")) for i, v in enumerate(x)]
    lost = F.struct(F.lit(-1).alias("c"), F.when(F.col("_gone") < len(x), 0.0).alias("v"))
    kept = F.filter(F.array(lost, *cells), lambda e: (F.abs(e["v"]) < float("inf")) & (e["c"] < F.col("_gone")))
    rows = df.dropna().withColumn("_gone", gone).select(F.explode(kept).alias("e"))
    counts = cut_lineage(rows.groupBy("e.c", (F.col("e.v") + 0.0).alias("v")).agg(F.count("*").alias("n")))
    values = counts.where("c >= 0")
    far = F.least(F.abs(F.col("v") - F.col("first")), F.abs(F.col("v") - F.col("second")))
    distances = cut_lineage(values.join(F.broadcast(two_means(values)), "c").groupBy("c", far.alias("d")).agg(F.sum("n").alias("n")))
    outside = distances.join(F.broadcast(_quantile_of_counts(distances, share)), "c").where("d > edge").select("n")
    return counts.where("c < 0").select("n").unionByName(outside).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def text_vectors(df: DataFrame, name: str, size: int = 32, seed: int = 0, min_count: int = 1) -> DataFrame:
    """Mean word vector of each text, from a Word2Vec model fitted on the same column, as (id, vec).

    The model keeps a vector for every word seen at least `min_count` times; raise it where words are many.
    """
    rows = Tokenizer(inputCol="_text", outputCol="_words").transform(
        df.select(F.monotonically_increasing_id().alias("id"), F.coalesce(col(name).cast("string"), F.lit(""))
                  .alias("_text")))
    rows = rows.persist()
    cores = df.sparkSession.sparkContext.defaultParallelism
    model = Word2Vec(vectorSize=size, minCount=min_count, seed=seed, numPartitions=cores, inputCol="_words",
                     outputCol="_vec").fit(rows)
    return model.transform(rows).select("id", vector_to_array("_vec").alias("vec"))


def vector_outliers(vectors: DataFrame, eps: float = 0.5, min_points: int = 5, standardize: bool = True) -> int:
    """Number of (id, vec) rows that density clustering calls noise.

    A row is noise if fewer than `min_points` rows (itself included) lie within `eps`, and none of the rows within `eps`
    has that many. So two neighbour counts are enough; no clusters are built.
    """
    if standardize:
        rows = vectors.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("_v"))
        sample = StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_s").fit(rows)
        n = rows.count()
        # Spark divides by the sample deviation; population deviation is wanted
        scale = float(np.sqrt(n / (n - 1))) if n > 1 else 1.0
        vectors = sample.transform(rows).select(
            "id", F.transform(vector_to_array("_s"), lambda v: v * scale).alias("vec"))
    vectors = cut_lineage(vectors)
    counts = neighbours_within(vectors, vectors, eps)
    near = cut_lineage(vectors.join(counts, vectors["id"] == counts["qid"], "left")
                       .select("id", "vec", F.coalesce("near", F.lit(0)).alias("near")))
    core, rest = near.filter(F.col("near") >= min_points), near.filter(F.col("near") < min_points)
    reached = neighbours_within(rest, core.select("id", "vec"), eps).filter("near > 0")
    return rest.count() - reached.count()


def text_outliers(df: DataFrame, names: Sequence[str] | None = None, eps: float = 0.5, min_points: int = 5) -> int:
    """Noise texts over all text columns."""
    names = string_columns(df) if names is None else names
    return sum(vector_outliers(text_vectors(df, c), eps, min_points) for c in names)


def uniqueness(df: DataFrame, keys: Sequence[str], reference: DataFrame | None = None,
               reference_keys: Sequence[str] | None = None) -> dict[str, float | None]:
    """Distinct keys per row, and distinct keys found in a reference table per key of that table, in percent."""
    distinct = df.select(*keys).distinct()
    rows, known = df.count(), distinct.count()
    result = {"unique_rows": 100.0 * known / rows if rows else 100.0, "covered": None}
    if reference is not None:
        pairs = list(zip(keys, reference_keys or keys))
        wanted = reference.select(*[F.col(r).alias(k) for k, r in pairs]).distinct()
        total = wanted.count()
        result["covered"] = 100.0 * wanted.join(distinct, list(keys), "left_semi").count() / total if total else 100.0
    return result


def consistency(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> float:
    """Percentage of equal cells between two versions of a table, matched by unique keys.

    Every column the two share is compared; a row missing on one side differs in all of them.
    """
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    a = left.select(*keys, F.struct(*[col(c) for c in shared]).alias("_a"))
    b = right.select(*keys, F.struct(*[col(c) for c in shared]).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    equal = [F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()
                        & F.col("_a")[c].eqNullSafe(F.col("_b")[c])) for c in shared]
    n, same = both.agg(F.count("*"), _total(equal)).first()
    return 100.0 * same / (n * len(shared)) if n and shared else 100.0
