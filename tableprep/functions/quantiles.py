"""Exact linear-interpolated quantiles without bringing a column into one task.

Spark's `percentile` keeps every distinct value of a column in a single hash map. The functions here use bounded state:
`exact_quantiles` narrows an interval around each wanted rank by repeated histograms, and `quantile_grid` range-partitions the
distinct values when very many quantiles are wanted.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableprep.functions.columns import number
from tableprep.session import cut_lineage

BUCKETS = 2048        # histogram buckets per interval and scan
COLLECT_ROWS = 4_000  # an interval with at most this many rows is sorted and read
BATCH = 24            # intervals handled by one job
ACCURACY, SLACK = 5_000, 5e-4  # of the sketch, and how far a bracket reaches beyond a wanted share on both sides


def _expressions(df: DataFrame, columns) -> dict[str, Column]:
    if isinstance(columns, Mapping):
        return {k: v.cast("double") for k, v in columns.items()}
    return {c: number(df, c) for c in columns}


def exact_quantiles(df: DataFrame, columns: Sequence[str] | Mapping[str, Column],
                    probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of each column over its non-missing values; all-missing columns give None."""
    return {c: values for c, (_, values) in counted_quantiles(df, columns, probs).items()}


def _place(p: float, n: int) -> float:
    """Rank of a quantile; a whole number where only rounding keeps it from being one."""
    h = p * (n - 1)
    return float(round(h)) if abs(h - round(h)) <= 1e-14 * n else h


def sketched(df: DataFrame, columns: Sequence[str] | Mapping[str, Column], probs: Sequence[float]) -> dict[str, tuple]:
    """(rows, minimum, maximum, [(low, high) per prob]) of each column, missing values left out: one scan for a batch of
    columns. An approximate sketch gives the brackets that most likely hold the quantiles."""
    exprs = _expressions(df, columns)
    names, found = list(exprs), {}
    places = sorted({min(1.0, max(0.0, p + side)) for p in probs for side in (-SLACK, SLACK)})
    for start in range(0, len(names), BATCH):
        part = names[start:start + BATCH]
        row = df.agg(*[F.struct(F.count(exprs[c]), F.min(exprs[c]), F.max(exprs[c]),
                                F.percentile_approx(exprs[c], places, ACCURACY)).alias(f"c{i}") for i, c in enumerate(part)]).first()
        for c, (n, low, high, guess) in zip(part, map(tuple, row)):
            at = dict(zip(places, guess or []))
            found[c] = (n, low, high, [(at[max(0.0, p - SLACK)], at[min(1.0, p + SLACK)]) for p in probs] if n else [])
    return found


def counted_quantiles(df: DataFrame, columns: Sequence[str] | Mapping[str, Column], probs: Sequence[float],
                      sketch: Mapping[str, tuple] | None = None) -> dict[str, tuple[int, list[float | None]]]:
    """As `exact_quantiles`, with the number of non-missing values of each column.

    Scan 1 sketches all columns; a caller that has a sketch of a table with about the same values saves it. Scan 2 counts
    the values below and inside each bracket, exactly. A bracket of few rows is read off value by value; a longer one is
    cut into buckets of equal width, with the smallest and largest value of each, and the bucket that holds a wanted rank
    becomes the next interval. A rank outside its bracket is searched in the whole range. A bucket of one repeated value
    ends the search at once, however many rows it holds. All steps are plain hash aggregations.
    """
    exprs = _expressions(df, columns)
    sketch = sketched(df, exprs, probs) if sketch is None else sketch
    found: dict[tuple[str, int], float] = {}
    sizes, todo, names = {c: 0 for c in exprs}, [], [c for c in exprs if sketch[c][0]]
    for start in range(0, len(names), BATCH):
        part = names[start:start + BATCH]
        counts = df.agg(*[F.struct(F.count(x), *[f(x, *ends) for ends in sketch[c][3] for f in (
            lambda v, low, high: F.count_if(v < low), lambda v, low, high: F.count_if(v.between(low, high)))]).alias(f"c{i}")
            for i, c in enumerate(part) for x in [exprs[c]]]).first()
        for c, (n, *inside) in zip(part, map(tuple, counts)):
            sizes[c] = n
            left = {k for p in probs if n for k in (math.floor(_place(p, n)), math.ceil(_place(p, n)))}
            for (low, high), below, rows in zip(sketch[c][3], inside[::2], inside[1::2]):
                held = {k for k in left if below <= k < below + rows}
                if held and low == high:  # one repeated value, as often in columns of few values
                    found.update({(c, k): low + 0.0 for k in held})
                elif held:
                    todo.append(_Span(c, low, high, rows, below, held, 1.0))
                left -= held
            if left:
                todo.append(_Span(c, -math.inf, math.inf, n, 0, left, 1.0))

    # ends of a wider bracket need not be values, so nothing more is settled before the first split
    while todo:
        todo = [child for start in range(0, len(todo), BATCH)
                for child in _settle(_split(df, exprs, todo[start:start + BATCH], found), found)]

    def value(c: str, p: float) -> float | None:
        if not sizes[c]:
            return None
        h = _place(p, sizes[c])
        low, high = found[c, math.floor(h)], found[c, math.ceil(h)]
        return low if low == high else low + (high - low) * (h - math.floor(h))

    return {c: (sizes[c], [value(c, p) for p in probs]) for c in exprs}


@dataclass
class _Span:
    """The `rows` values of a column from `low` to `high`; `below` values are smaller. Holds the wanted ranks."""

    column: str
    low: float
    high: float
    rows: int
    below: int
    ranks: set[int]
    share: float  # part of the parent's rows; near 1 means that equal widths did not help


def _settle(spans: list[_Span], found) -> list[_Span]:
    for s in spans:
        for k in list(s.ranks):
            if k == s.below or s.low == s.high:
                found[s.column, k] = s.low
            elif k == s.below + s.rows - 1:
                found[s.column, k] = s.high
            else:
                continue
            s.ranks.discard(k)
    return [s for s in spans if s.ranks]


def _squash(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def _bucket(x: Column, s: _Span) -> Column:
    """Bucket number: never falls as x grows. Equal widths, on a log scale where plain widths did not split."""
    low, high = s.low, s.high
    if s.share > 0.5 and s.below:
        squash = lambda v: math.copysign(math.log1p(abs(v)), v)
        if squash(high) - squash(low) > 1e-9 * max(1.0, abs(squash(high))):
            x, low, high = _squash(x), squash(low), squash(high)
    if math.isinf(low) or math.isinf(high):  # infinities get buckets of their own, the finite part is next
        return F.when(x == -math.inf, 0).when(x == math.inf, 2).otherwise(1)
    if low == high:
        return F.lit(0)
    # halves keep high - low finite over the whole double range
    width = high / 2 - low / 2
    if not width or not math.isfinite(1 / width):
        return F.when(x == low, 0).when(x == high, 2).otherwise(1)
    part = (x / 2 - low / 2) / width
    return F.greatest(F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1)), F.lit(0)).cast("int")


def _split(df: DataFrame, exprs, spans: list[_Span], found) -> list[_Span]:
    few = [s for s in spans if s.rows <= COLLECT_ROWS]
    many = [s for s in spans if s.rows > COLLECT_ROWS]

    def cells(part: list[_Span], key) -> DataFrame:
        held = [F.when(exprs[s.column].between(s.low, s.high),
                       F.struct(F.lit(i).alias("j"), key(exprs[s.column], s).alias("b"), exprs[s.column].alias("v")))
                for i, s in enumerate(part)]
        # most rows lie in no interval; they must not be copied once for each
        near = df.where(reduce(Column.__or__, [exprs[s.column].between(s.low, s.high) for s in part]))
        return near.select(F.explode(F.array(*held)).alias("s")).filter("s is not null").select("s.*")

    children = []
    if few:
        rows: dict[int, list] = {}
        for r in cells(few, lambda x, s: F.lit(0)).groupBy("j", "v").agg(F.count("*").alias("n")).collect():
            rows.setdefault(r["j"], []).append((r["v"], r["n"]))
        for j, s in enumerate(few):
            at, values = s.below, sorted(rows[j])
            for v, n in values:
                found.update({(s.column, k): v for k in s.ranks if at <= k < at + n})
                at += n
    if many:
        buckets: dict[int, list] = {}
        grouped = cells(many, _bucket).groupBy("j", "b").agg(F.count("*").alias("n"), F.min("v").alias("low"),
                                                            F.max("v").alias("high"))
        for r in grouped.collect():
            buckets.setdefault(r["j"], []).append((r["b"], r["low"], r["high"], r["n"]))
        for j, s in enumerate(many):
            at = s.below
            for _, low, high, n in sorted(buckets.get(j, [])):
                held = {k for k in s.ranks if at <= k < at + n}
                if held:
                    children.append(_Span(s.column, low, high, n, at, held, n / s.rows))
                at += n
    return children


def quantile_grid(df: DataFrame, columns: Sequence[str] | Mapping[str, Column], points: int) -> dict[str, list[float]]:
    """`min(points, rows)` evenly spaced exact quantiles of each column.

    Distinct values are counted first, so repeats are merged before the shuffle, and range-partitioned by (column,
    value). The checkpoint fixes the partition numbers; the driver reads one total per partition and the few values
    whose rank range holds a wanted rank.
    """
    exprs = _expressions(df, columns)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), x.alias("v")) for i, x in enumerate(exprs.values())])).alias("s")).select("s.*")
    counts = long.filter("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
    counts = cut_lineage(counts.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()))
    totals = {(r["c"], r["part"]): r["n"] for r in counts.groupBy("c", "part").agg(F.sum("n").alias("n")).collect()}
    offsets, size = {}, {}
    for (c, part), n in sorted(totals.items()):
        offsets[c, part] = size.get(c, 0)
        size[c] = size.get(c, 0) + n
    spark = df.sparkSession
    edges = spark.createDataFrame([(c, p, o, size[c], min(points, size[c])) for (c, p), o in offsets.items()],
                                  "c int, part int, off long, total long, m long")
    order = Window.partitionBy("c", "part").orderBy("v")
    runs = (counts.join(F.broadcast(edges), ["c", "part"])
            .withColumn("stop", F.col("off") + F.sum("n").over(order)).withColumn("start", F.col("stop") - F.col("n")))
    # A run of equal values covers ranks [start, stop). Wanted ranks lie at i * (total-1)/(m-1); the neighbours of each
    # one are needed as well, for interpolation.
    step = (F.col("total") - 1) / F.greatest(F.col("m") - 1, F.lit(1))
    last = F.floor((F.col("stop") + 1) / F.greatest(step, F.lit(1e-12)))
    wanted = runs.filter((step <= 1) | (F.least(last, F.col("m") - 1) * step >= F.col("start") - 2))
    rows: dict[int, list] = {}
    for r in wanted.select("c", "v", "start", "stop").collect():
        rows.setdefault(r["c"], []).append((r["start"], r["stop"], r["v"]))
    grids: dict[str, list[float]] = {}
    for i, name in enumerate(exprs):
        n = size.get(i, 0)
        m = min(points, n)
        spans = sorted(rows.get(i, []))
        grid, j = [], 0
        for t in range(m):
            h = t * (n - 1) / (m - 1) if m > 1 else 0.0
            while spans[j][1] <= math.floor(h):
                j += 1
            low = spans[j][2]
            high = low if math.ceil(h) < spans[j][1] else spans[j + 1][2]
            grid.append(low if low == high else low + (high - low) * (h - math.floor(h)))
        grids[name] = grid
    return grids
