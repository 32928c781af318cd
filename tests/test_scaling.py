"""Steps whose work must not grow faster than the table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.functions import nearest, quantiles
from tableprep.functions.columns import Roles
from tableprep.operators import cleanup
from tableprep.operators.models import growing, trees
from tableprep.operators.models.common import classification


def test_only_readings_that_fit_both_ends_are_tried_on_all_rows(spark, monkeypatch):
    rows = [("apple", "1", "03/04/2020", "2020-01-01"), ("pear", "2.5", "12/31/2021", "x"), (None, None, None, None),
            ("zebra", "7", "1/2/2022", "2021-05-05")]
    df = spark.createDataFrame(rows, "word string, n string, day string, broken string").coalesce(1)
    tried, read = [], cleanup.read_date
    monkeypatch.setattr(cleanup, "read_date", lambda x, form: tried.append((str(x), form)) or read(x, form))
    made = cleanup.coerce(df)
    assert [c for c in made.columns if not c.startswith("day_")] == ["word", "n", "broken"] and "day_YEAR" in made.columns
    assert [r["day_YEAR"] for r in made.collect()] == [2020.0, 2021.0, None, 2022.0]
    assert [r["n"] for r in made.collect()] == [1.0, 2.5, None, 7.0]
    on_rows = [(x, form) for x, form in tried if "word" in x or "`n`" in x or "'n'" in x or "day" in x]
    assert not [x for x, _ in on_rows if "word" in x]
    assert len({form for x, form in on_rows if "day" in x}) < len(cleanup.DATE_FORMATS) / 2


@pytest.mark.parametrize("values, numeric, spelled", [
    (["5", "x", "7"], False, False), (["2020-01-01", "no", "2021-01-01"], False, False), ([None, None], False, False), (["1", None, "1e3"], True, False),
    (["2020-01-05", "2021-02-03"], False, True)])
def test_a_middle_value_still_rules_a_reading_out(spark, values, numeric, spelled):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    made = cleanup.coerce(df)
    assert (made.schema[0].dataType.simpleString() == "double" and made.columns == ["c"]) == numeric
    assert ("c_YEAR" in made.columns) == spelled


def test_columns_of_few_values_need_no_split(spark, monkeypatch):
    df = spark.range(10_000).select((F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).cast("double").alias("b"))
    monkeypatch.setattr(quantiles, "_split", lambda *_: pytest.fail("a scan for a value that is known"))
    got = quantiles.exact_quantiles(df, ["a", "b"], [0.2, 0.6, 0.9])
    a = np.arange(10_000) % 7
    b = (np.arange(10_000) % 2)[np.arange(10_000) % 3 > 0]
    assert np.allclose(got["a"], np.quantile(a, [0.2, 0.6, 0.9])) and np.allclose(got["b"], np.quantile(b, [0.2, 0.6, 0.9]))
    assert math.copysign(1, got["a"][0]) == 1


def plain(a, b):
    diff = a[:, None, :] - b[None, :, :]
    return np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_blocks_by_products_give_plain_distances(shift):
    rng = np.random.default_rng(3)
    b = np.round(rng.normal(size=(300, 5)), 1) + shift
    b[50:90] = b[7]
    a = np.vstack([b[:40], np.round(rng.normal(size=(60, 5)), 1) + shift])
    d = plain(a, b)
    for radius in (0.0, 0.5, float(np.sqrt(1.25)), float(d[3, 9]), 3.0):
        assert (nearest.count_within(a, b, radius) == (d <= radius).sum(axis=1)).all()
    none, kth = np.full(len(a), np.nan), np.sort(d, axis=1)[:, 6]
    for limit in (none, kth, np.where(np.arange(len(a)) % 2, kth, np.nan)):
        i, j, dist = nearest.closest(a, b, 7, limit)
        assert (j.reshape(len(a), 7) == d.argsort(axis=1, kind="stable")[:, :7]).all() and (dist == d[i, j]).all()


def test_blocks_with_huge_and_missing_entries():
    b = np.array([[0.0, 1.0], [1e200, 0.0], [np.nan, 0.0], [np.inf, 0.0], [0.0, 1.5]])
    with np.errstate(all="ignore"):
        d = plain(b, b)
        assert (nearest.count_within(b, b, 0.6) == (d <= 0.6).sum(axis=1)).all()


def test_few_pairs_need_plain_differences(monkeypatch):
    rng = np.random.default_rng(4)
    a, seen, of_pairs = rng.normal(size=(400, 16)), [], nearest._of_pairs
    monkeypatch.setattr(nearest, "_of_pairs", lambda a, b, i, j: seen.append(len(i)) or of_pairs(a, b, i, j))
    nearest.count_within(a, a, 4.0)
    nearest.closest(a, a, 5, np.full(len(a), np.nan))
    assert sum(seen) < 400 * 400 / 20


def test_a_query_skips_cells_on_the_far_side(spark):
    """All cells reach far along one axis, so that their radii alone would leave none out."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 8, 1_600) * 10.0 + rng.normal(size=1_600), rng.normal(size=1_600) * 20])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").cache()
    cells = nearest._Cells(df)
    d = plain(x, x)
    reach = cells.reach
    choose = lambda d, rows: (d - reach <= 1.0, np.full(len(d), 1.0))
    assert len(cells.used) > 30 and cells.send(df, choose).count() == len(x)  # small cells are one group, a query goes there once
    cells.group = np.arange(len(cells.used))
    sent = cells.send(df, choose).count()
    ball = (plain(x, cells.pivots[cells.used]) - reach <= 1.0).sum()
    assert sent < 0.9 * ball
    near = {r["qid"]: r["near"] for r in nearest.neighbours_within(df, df, 1.0).collect()}
    assert near == dict(enumerate((d <= 1.0).sum(axis=1)))
    hits = nearest.nearest(df, df, 4).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("h")).collect()
    order = d.argsort(axis=1, kind="stable")[:, :4]
    assert all([h["id"] for h in r["h"]] == order[r["qid"]].tolist() for r in hits) and len(hits) == len(x)


def test_boosting_works_on_merged_rows(spark, monkeypatch):
    """Rounds see rows of the same buckets and class once, however often they come."""
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.integers(0, 4, 3_000), rng.integers(0, 3, 3_000)]).astype(float)
    y = (x[:, 0] > 2) ^ (rng.random(3_000) < 0.2)
    df = spark.createDataFrame([(i, *map(float, v), "ab"[int(c)], "train") for i, (v, c) in enumerate(zip(x, y))], "k long, p double, q double, label string, split string")
    task = classification(df.repartition(5), Roles(keys=("k",)))
    weigher = trees._weigher
    total = spark.sparkContext.accumulator(0)

    def counted(*args):
        run = weigher(*args)

        def wrapped(batches):
            def each():
                for pdf in batches:
                    total.add(len(pdf))
                    yield pdf
            return run(each())
        return wrapped

    monkeypatch.setattr(trees, "_weigher", counted)
    stumps = trees.boost(task, 1, 0)[0]
    assert stumps and 0 < total.value <= 24
    counts = growing.merged(growing.bucketed(growing.raw_base(task), [np.arange(4.0), np.arange(3.0)])).collect()
    assert len(counts) <= 24 and sum(r["n"] for r in counts) == 3_000


def test_a_balanced_forest_reads_different_rows(spark, monkeypatch):
    sizes, kept = [], trees.cut_lineage
    monkeypatch.setattr(trees, "cut_lineage", lambda df: sizes.append((made := kept(df)).count()) or made)
    df = spark.range(4_000).select(F.col("id").alias("k"), (F.col("id") % 20).cast("double").alias("a"), F.lit("train").alias("split"),
                                   F.when(F.col("id") % 20 > 16, "x").otherwise("z").alias("label")).repartition(7)
    forest = trees.balanced_trees(classification(df, Roles(keys=("k",))), 4, 1, 3, None)
    assert sizes == [20]
    assert [s[0].tolist() for s in forest.stats] == [[600, 600]] * 4  # as many draws of each class as the rarer one has rows
    assert len({tuple(s[1]) for s in forest.stats} | {tuple(s[2]) for s in forest.stats}) >= 2


def test_counts_within_a_radius_send_no_vectors(spark, monkeypatch):
    from tableprep.functions import nearest

    rng = np.random.default_rng(21)
    x = np.round(rng.normal(size=(150, 3)) * 2, 1)
    x[140:] = x[5]
    rows = [(int(i) if i < 148 else 147, v.tolist()) for i, v in enumerate(x)]  # an id that comes more than once adds up
    df = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    monkeypatch.setattr(nearest, "PACK_ROWS", 7)
    monkeypatch.setattr(nearest, "PACKS", 2)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 20)
    monkeypatch.setattr(nearest._Cells, "send", None)
    monkeypatch.setattr(nearest._Cells, "blocks", None)
    want = {}
    for (i, _), n in zip(rows, (np.sqrt(((x[:, None] - x) ** 2).sum(axis=2)) <= 1.0).sum(axis=1)):
        want[i] = want.get(i, 0) + int(n)
    assert {r["qid"]: r["near"] for r in nearest.neighbours_within(df, df, 1.0).collect()} == want
