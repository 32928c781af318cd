"""Analytics over the logs of chain runs.

A step log has one row per step: key columns of the run, a gap-free `step` from 1, `op` and `acc`. A run table has one row
per run: `dataset`, `ops` (array) and `acc`. Windows go over (run, block of steps), never over a whole long run.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tableprep.functions.columns import col
from tableprep.functions.counts import is_small
from tableprep.functions.ordered import ROWS_PER_BLOCK, drop_context, overlapping_blocks
from tableprep.operators.catalog import CATEGORIES, DONE, FINISH_BONUS, find_operator
from tableprep.session import cut_lineage

EPSILON = 1e-6            # fixed value of the step reward
COST_OFFSET = 10          # fixed value of the weighted reward
BEST_RUNS, RULES_PER_SIZE, NGRAMS = 10, 3, (2, 3, 4)  # fixed values
MAX_CHAIN = 9             # fixed value: longest greedy chain


def _window(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, "_block").orderBy("step")


def step_rewards(log: DataFrame, keys: Sequence[str], baseline: Column | float = 0.0,
                 block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Adds `reward`: relative gain over the step before, plus a bonus on the final step by the operator before it."""
    rows = overlapping_blocks(log, "step", 1, block)
    first = F.col("step") == 1
    base = F.lit(baseline) if not isinstance(baseline, Column) else baseline
    previous = F.when(first, base).otherwise(F.lag("acc").over(_window(keys)))
    bonus = F.get(F.lit([float(FINISH_BONUS[c]) for c in CATEGORIES] + [0.0]), F.lag("op").over(_window(keys)))
    rows = rows.withColumn("_previous", previous).withColumn("_bonus", bonus)
    reward = (F.col("acc") - F.col("_previous")) / (F.col("_previous") + EPSILON)
    finish = F.when(F.col("op") == DONE, F.coalesce("_bonus", F.lit(0.0))).otherwise(0.0)
    return drop_context(rows.withColumn("reward", reward + finish)).drop("_previous", "_bonus")


def weighted_rewards(log: DataFrame, keys: Sequence[str], plain: tuple[float, float], w_quality: float, w_cost: float,
                     classifier: bool = True, block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Adds `reward` to runs with `downstream`, `quality` and `cost`, in `step` order.

    Gain in the downstream score over the better of the last run and the unprepared table, plus weighted relative gain
    in quality, minus weighted relative cost. `plain` is (downstream, quality) of the unprepared table, whose cost is 0.
    """
    rows = overlapping_blocks(log, "step", 1, block)
    values = {"downstream": plain[0], "quality": plain[1], "cost": 0.0}
    for name, start in values.items():
        rows = rows.withColumn(f"_{name}", F.when(F.col("step") == 1, F.lit(float(start)))
                               .otherwise(F.lag(name).over(_window(keys))))
    last = F.col("_downstream")
    gain = (F.col("downstream") - F.greatest(last, F.lit(plain[0])) if classifier
            else F.least(last, F.lit(plain[0])) - F.col("downstream"))
    gain = gain / F.nullif(last, F.lit(0.0))
    if not classifier:  # an error of 0 cannot be improved
        gain = F.coalesce(gain, F.when(last == 0, 0.0))
    quality = (F.col("quality") - F.col("_quality")) / F.nullif(F.col("_quality"), F.lit(0.0))
    cost = (F.col("cost") - F.col("_cost") + COST_OFFSET) / (F.col("_cost") + COST_OFFSET)
    rows = rows.withColumn("reward", gain + w_quality * quality - w_cost * cost)
    return drop_context(rows).drop(*[f"_{n}" for n in values])


def leaderboard(runs: DataFrame, key: str = "dataset", higher_is_better: bool = True) -> DataFrame:
    """Best run per dataset (ties: the smaller operator list). Merges on the map side."""
    order = -F.col("acc") if higher_is_better else F.col("acc")
    best = runs.groupBy(key).agg(F.min(F.struct(order.alias("o"), F.col("ops"), F.col("acc"))).alias("b"))
    return best.select(key, F.col("b.ops").alias("ops"), F.col("b.acc").alias("acc"))


def best_runs(runs: DataFrame, key: str = "dataset", keep: int = BEST_RUNS) -> DataFrame:
    """Per dataset the best runs with different operator lists, as (dataset, ops, acc, rank).

    Equal lists keep their best accuracy. The rank limit is applied in every task before the shuffle.
    """
    distinct = runs.groupBy(key, "ops").agg(F.max("acc").alias("acc"))
    order = Window.partitionBy(key).orderBy(F.desc("acc"), "ops")
    return distinct.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def ngram_counts(runs: DataFrame, ops: str = "ops", sizes: Sequence[int] = NGRAMS) -> DataFrame:
    """(size, pattern, n): how often operators follow one another directly."""
    def grams(size: int) -> Column:
        starts = F.when(F.size(ops) >= size, F.sequence(F.lit(1), F.size(ops) - (size - 1))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(size).alias("size"), F.slice(ops, i, size).alias("pattern")))

    gram = runs.select(F.explode(F.concat(*[grams(s) for s in sizes])).alias("g"))
    return gram.groupBy(F.col("g.size").alias("size"), F.col("g.pattern").alias("pattern")).agg(F.count("*").alias("n"))


def next_step_rules(counts: DataFrame, chain: Sequence[int], keep: int = RULES_PER_SIZE) -> DataFrame:
    """The most frequent patterns of each size that start with the last operator of `chain`, as (size, pattern, n)."""
    order = Window.partitionBy("size").orderBy(F.desc("n"), "pattern")
    top = counts.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= keep).drop("_rank")
    return top.filter(F.col("pattern")[0] == F.lit(chain[-1] if chain else None))


def rules_text(rules: DataFrame, names: Sequence[str]) -> str:
    """The rules of `next_step_rules`, one line each: how often, then the operators in their order."""
    rows = rules.orderBy("size", F.desc("n"), "pattern").collect()
    return "\n".join(f"{r['n']}x  " + " > ".join(f"{names[op]} [{op}]" for op in r["pattern"]) for r in rows)


def score_slopes(episodes: DataFrame, keys: Sequence[str], window: int = 10, block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Adds `slope`: least-squares slope of `acc` over the last `window` steps, where that many exist."""
    rows = overlapping_blocks(episodes, "step", window - 1, block)
    frame = _window(keys).rowsBetween(-(window - 1), 0)
    slope = F.when(F.col("step") >= window, F.regr_slope("acc", F.col("step").cast("double")).over(frame))
    return drop_context(rows.withColumn("slope", slope))


def _runs(batches, group: list[str]):
    """(key, rows) of successive runs of equal keys in a sorted stream of frames."""
    now, parts = None, []
    for pdf in batches:
        changes = (pdf[group] != pdf[group].shift()).any(axis=1).to_numpy()
        edges = [*np.flatnonzero(changes), len(pdf)]
        for first, last in zip(edges[:-1], edges[1:]):
            key = tuple(pdf[group].iloc[first])
            if parts and key != now:
                yield now, pd.concat(parts)
                parts = []
            now = key
            parts.append(pdf.iloc[first:last])
    if parts:
        yield now, pd.concat(parts)


PACKED = 10_000  # short rows that a task hands on together


def _hits(following: list[int], first: int) -> list[int]:
    """Places of the hits: from one to the first place that is far enough behind it."""
    found = []
    while first < len(following):
        found.append(first)
        first = following[first]
    return found


def plateau_hits(episodes: DataFrame, keys: Sequence[str], threshold: float = 0.01, window: int = 10, wait: int = 5,
                 block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Adds `hit`: slope at or below the threshold, and at least `wait` steps after the hit before.

    Which steps hit depends on the earlier hits. Each block is first played through for every possible rest of the
    waiting time at its start (0 to wait - 1); the short list of outcomes per block is then chained along the run, and
    the blocks are played once more from their true start.
    """
    keys = list(keys)
    if block < wait:
        raise ValueError("a block must be at least as long as the waiting time")
    rows = cut_lineage(score_slopes(episodes, keys, window, block).withColumn("_block", F.floor(F.col("step") / block)))
    group = [*keys, "_block"]
    candidates = rows.filter(F.col("slope") <= threshold).select(*group, "step")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema[:-1])

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition(*group).sortWithinPartitions(*group, "step")

    # A rest of r at a block start means that no step before start + r may hit. Rows come sorted, so a task reads its
    # blocks as one stream and holds the steps of a single block.
    def outcomes(batches):
        found = []
        for key, rows in _runs(batches, group):
            steps = rows["step"].to_numpy()
            following = np.searchsorted(steps, steps + wait).tolist()
            ends = []
            for r in range(wait):
                hits = _hits(following, int(np.searchsorted(steps, key[-1] * block + r)))
                ready = steps[hits[-1]] + wait if hits else key[-1] * block + r
                ends.append(max(0, int(ready - (key[-1] + 1) * block)))
            found.append((*key, ends))
            if len(found) >= PACKED:
                yield pd.DataFrame(found, columns=[*group, "ends"])
                found = []
        if found:
            yield pd.DataFrame(found, columns=[*group, "ends"])

    ends = in_order(candidates).mapInPandas(outcomes, f"{kinds}, ends array<long>")

    # One short row per block: the rests are chained along the blocks of a run.
    link = F.struct("_block", "ends")
    start = F.struct(F.lit(-2).cast("long").alias("last"), F.lit(0).cast("long").alias("rest"),
                     F.array().cast("array<struct<_block:bigint,_rest:bigint>>").alias("done"))

    def chain(state, b):
        rest = F.when(b["_block"] == state["last"] + 1, state["rest"]).otherwise(F.lit(0).cast("long"))
        return F.struct(b["_block"].alias("last"), F.get(b["ends"], rest.cast("int")).alias("rest"),
                        F.array_append(state["done"], F.struct(b["_block"].alias("_block"), rest.alias("_rest"))).alias("done"))

    rests = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(link)).alias("links")).select(
        *keys, F.explode(F.aggregate("links", start, chain, lambda s: s["done"])).alias("r")).select(*keys, "r.*")

    def mark(batches):
        found = []
        for key, rows in _runs(batches, group):
            steps = rows["step"].to_numpy()
            first = int(np.searchsorted(steps, key[-1] * block + rows["_rest"].iloc[0]))
            hits = _hits(np.searchsorted(steps, steps + wait).tolist(), first)
            found += [(*key[:-1], int(s)) for s in steps[hits]]
            if len(found) >= PACKED:
                yield pd.DataFrame(found, columns=[*keys, "step"])
                found = []
        if found:
            yield pd.DataFrame(found, columns=[*keys, "step"])

    marked = in_order(candidates.join(rests, group).select(*group, "step", "_rest"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema if f.name != "_block")
    hits = marked.mapInPandas(mark, kinds).withColumn("hit", F.lit(True))
    return rows.drop("_block").join(hits, [*keys, "step"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def drop_alarms(log: DataFrame, keys: Sequence[str], block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Adds `alarm` (0 to 3) to every step of a run, counting the baseline as step 1.

    1: accuracy fell below 0.6 of the step before. 2: two falls of at least 0.001 in a row. 3: the mean change since the
    start is negative after three changes. 0: none, or fewer than three scores. The mean of the changes is the change
    since the start over their number, so it needs the first score alone and no running sum.
    """
    first = log.filter(F.col("step") == 1).select(*keys, F.col("acc").alias("_first"))
    rows = overlapping_blocks(log, "step", 2, block)
    one, two = F.lag("acc", 1).over(_window(keys)), F.lag("acc", 2).over(_window(keys))
    rows = drop_context(rows.withColumn("_one", one).withColumn("_two", two)).join(first, list(keys))
    step, acc = F.col("step"), F.col("acc")
    last, before = acc - F.col("_one"), F.col("_one") - F.col("_two")
    alarm = (F.when(step <= 2, 0).when(acc < F.col("_one") * 0.6, 1)
             .when((F.round(last, 9) <= -0.001) & (F.round(before, 9) <= -0.001), 2)
             .when((step >= 4) & (F.round((acc - F.col("_first")) / (step - 1), 9) < 0), 3).otherwise(0))
    return rows.withColumn("alarm", alarm).drop("_one", "_two", "_first")


def stagnation_alarms(episodes: DataFrame, keys: Sequence[str], lowest: float = 0.005, buffer: int = 40,
                      block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Adds `alarm`: more than five episodes known, and none of the last `buffer` gained `lowest` or more (`gain`)."""
    rows = overlapping_blocks(episodes, "step", buffer - 1, block)
    top = F.max("gain").over(_window(keys).rowsBetween(-(buffer - 1), 0))
    return drop_context(rows.withColumn("alarm", (F.col("step") > 5) & (top < lowest)))


def parse_chain(text: Column) -> Column:
    """Operator ids suggested in a text, or null.

    A code fence is stripped, then `suggested_pipeline` or `pipe` is read from JSON; its names are looked up unless all
    items are numbers. Without JSON the first bracketed list of numbers counts.
    """
    fenced = F.regexp_extract(text, r"(?s)^\s*```(?:json)?\n(.*?)\n```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.trim(text))
    doc = F.try_parse_json(body)
    wanted = [F.try_variant_get(doc, f"$.{key}", "array<string>") for key in ("suggested_pipeline", "pipe")]
    items = F.transform(F.coalesce(*wanted), lambda x: F.trim(x))
    digits = F.forall(items, lambda x: x.rlike(r"^\d+$"))
    named = F.when(digits, F.transform(items, lambda x: x.try_cast("int"))).otherwise(F.transform(items, find_operator))
    plain = F.regexp_extract(text, r"\[(\d+(?:,\s*\d+)*)\]", 1)
    loose = F.when(doc.isNull() & (plain != ""), F.transform(F.split(plain, r",\s*"), lambda x: x.try_cast("int")))
    return F.coalesce(named, loose)


def parse_weights(text: Column) -> Column:
    """map id -> weight from the `id: number` pairs between the first { and the last }."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    pairs = F.regexp_extract_all(body, F.lit(r'"?\d+"?:\s*\d+(?:\.\d+)?'), F.lit(0))
    parts = F.transform(pairs, lambda p: F.struct(
        F.regexp_extract(p, r"(\d+)", 1).try_cast("int").alias("key"),
        F.regexp_extract(p, r":\s*(\d+(?:\.\d+)?)", 1).try_cast("double").alias("value")))
    # a repeated id keeps its last weight
    ids = F.array_distinct(F.transform(parts, lambda p: p["key"]))
    weights = F.transform(ids, lambda i: F.element_at(F.filter(parts, lambda p: p["key"] == i), -1)["value"])
    return F.map_from_arrays(ids, weights)


def normalize_weights(weights: Column, allowed: Column | None = None) -> Column:
    """Weights scaled to sum 1; ids outside `allowed` (an array) get 0 first. Null if nothing is left."""
    if allowed is not None:
        weights = F.transform_values(weights, lambda k, v: F.when(F.array_contains(allowed, k), v).otherwise(0.0))
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda t, v: t + v)
    return F.when(total > 0, F.transform_values(weights, lambda k, v: v / total))


def transition_values(transitions: DataFrame, sweeps: int = 10, gamma: float = 0.9) -> DataFrame:
    """(state, action, q): values of the actions by repeated sweeps of mean reward + gamma * best value of the next state.

    Transitions (state, action, next_state, reward) are merged to counts once; the sweeps work on that short table.
    """
    model = cut_lineage(transitions.groupBy("state", "action", "next_state").agg(
        F.count("*").alias("n"), F.sum("reward").alias("r")))
    best = None
    for i in range(sweeps):
        if best is None:
            step = model.withColumn("v", F.lit(0.0))
        else:
            step = model.join(best, model["next_state"] == best["s"], "left").withColumn(
                "v", F.coalesce("v", F.lit(0.0)))
        q = step.groupBy("state", "action").agg(
            (F.sum(F.col("r") + F.lit(gamma) * F.col("n") * F.col("v")) / F.sum("n")).alias("q"))
        if i + 1 < sweeps:
            best = q.groupBy(F.col("state").alias("s")).agg(F.max("q").alias("v"))
            best = cut_lineage(best) if i % 4 == 3 else best
    return q


def greedy_chains(values: DataFrame, longest: int = MAX_CHAIN, done: int = DONE) -> DataFrame:
    """(start, ops): from every state follow the best action (the smaller on ties) to the final step.

    A chain ends with the final step after `longest` operators, or where no value is known or the best is not positive.
    """
    best = values.groupBy("state").agg(F.min(F.struct((-F.col("q")).alias("o"), F.col("action"))).alias("b"))
    policy = cut_lineage(best.select(F.col("state").alias("_at"), F.when(F.col("b.o") < 0, F.col("b.action"))
                                     .otherwise(F.lit(done)).alias("_next")))
    table = F.broadcast(policy) if is_small(policy) else policy
    chains = policy.filter(F.col("_at") != done).select(
        F.col("_at").alias("start"), F.array("_at").alias("ops"), F.col("_at").alias("_now"))
    for i in range(longest):
        chains = chains.join(table, chains["_now"] == table["_at"], "left").drop("_at")
        step = F.lit(done) if i + 1 == longest else F.coalesce("_next", F.lit(done))
        ended = F.col("_now") == done
        chains = chains.select("start", F.when(ended, F.col("ops")).otherwise(F.array_append("ops", step)).alias("ops"),
                               F.when(ended, F.col("_now")).otherwise(step).alias("_now"))
    return chains.drop("_now")
