"""Toxicity by weak supervision: many lexicon and pattern voters, a generative model of how far they can be trusted and
how they depend on each other, and a linear classifier trained on the labels that the model thinks likely.

1. Features of a text are its words and the first 4, 5, 6 and 8 bytes of its longer words, as hashes. A bounded sample of
   labelled rows shows which of them go with the label: the strongest become lexicon voters, more serve the classifier.
2. Every document gets a bit mask of the voters that fire. Over the counts of all masks, expectation-maximisation
   estimates how often each voter fires in toxic and in clean documents. A class is a mixture of kinds, so voters may be
   correlated within it. Known labels (training folds alone) hold their documents' class fixed.
3. Voters that are still correlated inside the kinds share their evidence where they fire together. This gives
   posterior labels.
4. A logistic regression learns the posterior labels of a bounded sample of documents and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.llm import shingles
from tableprep.llm.common import written

#: Bounds of the fits, in rows: labelled rows that show the features, documents that train the classifier.
LABELLED_ROWS, TRAINING_ROWS = 8_000, 16_000
FEATURES, LEXICONS = 3_000, 56
PREFIXES = (4, 5, 6, 8)
ROUNDS, FEWEST = 15, 5
CLEAN_KINDS, TOXIC_KINDS = 2, 5

_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
PATTERNS = ("shouting", "exclaiming", "numbers", "repeating")


def fold(key: Column) -> Column:
    """0 to 4; rows of fold 0 are held out. A null key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


@dataclass(frozen=True)
class Model:
    """features: sorted hashes; weights: their weights, then the bias."""

    features: np.ndarray
    weights: np.ndarray


def _hits(column: pa.Array, table: np.ndarray | None) -> Iterator[tuple]:
    """(first row, rows, bytes, offsets, words' rows, row and feature of every distinct hit); a table keeps its own hashes
    alone and gives positions in it."""
    for first, data, offsets in shingles.slices(column):
        row, start, end = shingles.words(data, offsets, shingles.PUNCTUATED)
        sums = shingles.byte_sums(data)
        rows, found = [row], [shingles.span_hashes(sums, start, end)]
        for n in PREFIXES:
            long = end - start > n
            rows.append(row[long])
            found.append(shingles.mix(shingles.span_hashes(sums, start[long], start[long] + n) + np.uint64(n)))
        at, value = np.concatenate(rows), np.concatenate(found)
        if table is not None:
            place = np.searchsorted(table, value)
            place[place == len(table)] = 0
            keep = table[place] == value if len(table) else np.zeros(len(value), bool)
            both = np.unique(at[keep] * max(1, len(table)) + place[keep])
            at, value = both // max(1, len(table)), both % max(1, len(table))
        else:
            order = np.lexsort((value, at))
            at, value = at[order], value[order]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (value[1:] != value[:-1])
            at, value = at[new], value[new]
        yield first, len(offsets) - 1, data, offsets, row, found[0], at, value


def _pattern_bits(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One bit per pattern voter, for every row of a slice."""
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    length = np.maximum(1, np.diff(offsets))
    twice = np.zeros(len(data), np.int64)
    twice[1:] = (data[1:] == 33) & (data[:-1] == 33)
    n = np.bincount(row, minlength=len(offsets) - 1)
    again = np.zeros(len(row), np.int64)
    again[1:] = (row[1:] == row[:-1]) & (words[1:] == words[:-1])
    stutter = np.bincount(row, weights=again, minlength=len(offsets) - 1)
    votes = (total(_UPPER[data]) > 0.3 * length, total(twice) > 0, total(_DIGIT[data]) > 0.2 * length, stutter > 0.3 * np.maximum(1, n))
    return sum(v.astype(np.int64) << i for i, v in enumerate(votes))


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for first, rows, _, _, _, _, at, value in _hits(batch.column(0), None):
            feature, where = np.unique(value, return_inverse=True)
            hot = np.bincount(where, weights=label[first:first + rows][at], minlength=len(feature))
            n = np.bincount(where, minlength=len(feature))
            yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(n.astype(np.int64)),
                                              pa.array(hot.astype(np.int64))], ["feature", "n", "hot"])


def choose_features(labelled: DataFrame, rows: int, hot: int) -> np.ndarray:
    """Hashes, ascending, of the features that go with the label or against it, from (text, label) rows."""
    if not rows:
        return np.zeros(0, np.uint64)
    counts = labelled.mapInArrow(_feature_counts, "feature long, n long, hot long").groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("hot").alias("hot")).where(F.col("n") >= FEWEST)
    share = hot / rows
    gap = F.col("hot") - F.col("n") * share
    strength = gap * gap / (F.col("n") * max(share * (1 - share), 1e-9))  # chi square of the feature and the label
    best = counts.select("feature", strength.alias("strength")).orderBy(F.desc("strength"), "feature").limit(FEATURES).toArrow()
    return np.sort(best.column("feature").to_numpy().view(np.uint64))


def choose_lexicon(hits: list[np.ndarray], label: np.ndarray, features: int) -> np.ndarray:
    """Features that become voters, one after the other: each time the telling one that finds most toxic texts, where a
    text counts half as much for every voter that has found it."""
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    column = np.concatenate(hits).astype(np.int64) if hits else np.zeros(0, np.int64)
    n = np.bincount(column, minlength=features)
    hot = np.bincount(column, weights=label[row], minlength=features)
    share = label.mean() if len(label) else 0.0
    telling = (n >= FEWEST) & ((hot + 0.5) / (n + 1) > max(0.5, 3 * share))
    worth, chosen = label.astype(float), []
    for _ in range(LEXICONS):
        gain = np.where(telling, np.bincount(column, weights=worth[row], minlength=features) * hot / np.maximum(1, n), 0.0)
        best = int(gain.argmax()) if features else 0
        if not features or gain[best] < 0.5:
            break
        chosen.append(best)
        found = np.zeros(len(hits), bool)
        found[row[column == best]] = True
        worth[found] /= 2
        # what fires almost only where this voter does would repeat it
        telling &= np.bincount(column, weights=found[row], minlength=features) < 0.9 * n
    return np.array(chosen, np.int64)


def _masks(lexicon: np.ndarray):
    order = np.argsort(lexicon)
    table = lexicon[order]
    bit = order + len(PATTERNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, rows, data, offsets, row, words, at, value in _hits(batch.column(1), table):
                mask = _pattern_bits(data, offsets, row, words)
                np.bitwise_or.at(mask, at, np.int64(1) << bit[value].astype(np.int64) if len(bit) else value)
                out.append(mask)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))],
                                             ["id", "mask"])
    return run


@dataclass(frozen=True)
class LabelModel:
    """A class is a mixture of kinds (clean kinds first), inside which voters fire on their own: voters that go together
    in a class do so through its kinds. share: of each kind; rates: firing rate by kind and voter; correlation: what is
    left of it between voters inside the kinds. Firing voters that are correlated share their evidence."""

    share: np.ndarray
    rates: np.ndarray
    correlation: np.ndarray

    def kinds(self, votes: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Chance of every kind for each row of votes; a known class leaves its own kinds alone."""
        evidence = votes / np.maximum(1.0, votes @ self.correlation)
        log = np.log(self.share) + evidence @ np.log(self.rates).T + (1 - votes) @ np.log(1 - self.rates).T
        if known is not None:
            toxic = np.arange(len(self.share)) >= CLEAN_KINDS
            log = np.where((known[:, None] >= 0) & ((known[:, None] == 1) != toxic), -np.inf, log)
        chance = np.exp(log - log.max(axis=1, keepdims=True))
        return chance / chance.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self.kinds(votes)[:, CLEAN_KINDS:].sum(axis=1)


def votes_of(mask: np.ndarray, voters: int) -> np.ndarray:
    return ((mask[:, None] >> np.arange(voters)) & 1).astype(float)


def _expected(model: LabelModel, voters: int, pairs: bool):
    """Expected counts, firings and, if wanted, joint firings of each kind, as rows (kind, i, j, n); voter 0 stands for
    the kind itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(model.share), voters + 1, voters + 1))
        for batch in batches:
            votes = votes_of(batch.column(0).to_numpy(zero_copy_only=False), voters)
            chance = model.kinds(votes, batch.column(1).to_numpy(zero_copy_only=False))
            n = batch.column(2).to_numpy(zero_copy_only=False)
            full = np.concatenate((np.ones((len(votes), 1)), votes), axis=1)
            for c in range(len(model.share)):
                w = chance[:, c] * n
                if pairs:
                    sums[c] += (full * w[:, None]).T @ full
                else:
                    sums[c, 0] += w @ full
        c, i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(i), pa.array(j), pa.array(sums[c, i, j])], ["kind", "i", "j", "n"])
    return run


def fit_label_model(masks: DataFrame, first: np.ndarray, balance: float, rounds: int = ROUNDS) -> LabelModel:
    """From counted masks (mask, known: 0, 1 or -1, n), by expectation-maximisation from a first guess of the firing rates
    (clean, toxic). The counts stay distributed; what comes back are sums over kinds and voters and, once, over pairs of
    voters."""
    voters = first.shape[1]

    def sums(model: LabelModel, pairs: bool) -> np.ndarray:
        rows = (masks.mapInArrow(_expected(model, voters, pairs), "kind long, i long, j long, n double")
                .groupBy("kind", "i", "j").agg(F.sum("n")).collect())
        out = np.zeros((CLEAN_KINDS + TOXIC_KINDS, voters + 1, voters + 1))
        for c, i, j, n in rows:
            out[c, i, j] = n
        return out

    kinds = CLEAN_KINDS + TOXIC_KINDS
    share = np.repeat([(1 - balance) / CLEAN_KINDS, balance / TOXIC_KINDS], [CLEAN_KINDS, TOXIC_KINDS])
    rates = np.repeat(first, [CLEAN_KINDS, TOXIC_KINDS], axis=0)
    apart = np.random.default_rng(7).uniform(0.3, 2.0, (kinds, voters))  # kinds of a class must differ to part ways
    model = LabelModel(share, np.clip(rates * apart, 1e-6, 0.99), np.eye(voters))
    for _ in range(rounds):
        found = sums(model, False)[:, 0]
        model = LabelModel((found[:, 0] + 1) / (found[:, 0].sum() + kinds), (found[:, 1:] + 0.1) / (found[:, :1] + 1), model.correlation)
    both = sums(model, True)
    n = np.maximum(both[:, :1, :1], 1)
    mean = both[:, 0, 1:] / n[:, 0]
    covariance = both[:, 1:, 1:] / n - mean[:, :, None] * mean[:, None, :]
    spread = np.sqrt(np.maximum(np.einsum("cii->ci", covariance), 1e-9))
    rest = covariance / (spread[:, :, None] * spread[:, None, :])
    # a voter's dependence counts where it fires: kinds weigh by their joint firings
    fired = both[:, 1:, 1:] + 1e-9
    correlation = np.clip((rest * fired).sum(axis=0) / fired.sum(axis=0), 0, 1)
    correlation[correlation < 0.2] = 0
    np.fill_diagonal(correlation, 1.0)
    return LabelModel(model.share, model.rates, correlation)


def _sampled(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, values = [np.zeros(1, np.int64)], []
            for _, rows, _, _, _, _, at, value in _hits(batch.column(1), table):
                ends.append(ends[-1][-1] + np.cumsum(np.bincount(at, minlength=rows)))
                values.append(value)
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            hits = pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), hits], [batch.schema.names[0], "hits"])
    return run


def _lists(rows: pa.Table) -> list[np.ndarray]:
    column = rows.column("hits").combine_chunks()
    return np.split(column.values.to_numpy(), column.offsets.to_numpy()[1:-1]) if len(column) else []


def fit_classifier(hits: list[np.ndarray], target: np.ndarray, features: int, rounds: int = 150, decay: float = 2e-5) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps; the last weight is the bias."""
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    column = np.concatenate(hits).astype(np.int64) if hits else np.zeros(0, np.int64)
    weights, speed = np.zeros(features + 1), np.zeros(features + 1)
    squares = np.full(features + 1, 1e-8)
    if not len(hits):
        return weights
    for _ in range(rounds):
        ahead = weights + 0.9 * speed
        logit = np.bincount(row, weights=ahead[column], minlength=len(hits)) + ahead[-1]
        error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target
        slope = np.append(np.bincount(column, weights=error[row], minlength=features), error.sum()) / len(hits)
        slope[:-1] += decay * ahead[:-1]
        squares += slope ** 2
        speed = 0.9 * speed - 0.1 * slope / np.sqrt(squares)
        weights = weights + speed
    return weights


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from labels outside fold 0 alone. `docs` gives texts, `labels` (key, label 0 or 1). Labels that are null or
    have a null key are left out, and of a key labelled twice the larger label counts. Without any label the classifier
    scores by its bias."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    gold = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(F.col(key)) != 0))
            .groupBy(F.col(key).alias("id")).agg(F.max(F.col(label)).cast("long").alias("label")))
    sample = gold.orderBy(F.xxhash64("id"), "id").limit(LABELLED_ROWS)
    sample = written(docs.join(F.broadcast(sample), "id").select("text", "label"))  # LABELLED_ROWS ids at most
    rows, hot = sample.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    table = choose_features(sample, rows, hot)
    seen = sample.select("label", "text").mapInArrow(_sampled(table), "label long, hits array<int>").toArrow()
    found, label = _lists(seen), seen.column("label").to_numpy()
    chosen = choose_lexicon(found, label, len(table))
    lexicon, voters = table[chosen], len(PATTERNS) + len(chosen)
    owner = np.repeat(label, [len(h) for h in found])
    column = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
    fired = np.array([np.bincount(column[owner == c], minlength=len(table))[chosen] for c in (0, 1)])
    first = np.full((2, voters), 0.05)
    first[:, len(PATTERNS):] = (fired + 0.1) / np.array([[rows - hot + 1], [hot + 1]])

    masks = docs.mapInArrow(_masks(lexicon), f"id {docs.schema['id'].dataType.simpleString()}, mask long")
    counted = written(masks.join(gold, "id", "left").groupBy("mask", F.coalesce("label", F.lit(-1)).alias("known")).agg(
        F.count(F.lit(1)).alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    label_model = fit_label_model(counted, first, (hot + 1) / (rows + 2))

    each = max(1, -(-total // TRAINING_ROWS))
    part = docs.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(each)) == 0)
    few = part.mapInArrow(_masks(lexicon), f"id {docs.schema['id'].dataType.simpleString()}, mask long")
    drawn = part.mapInArrow(_sampled(table), f"id {docs.schema['id'].dataType.simpleString()}, hits array<int>")
    drawn = drawn.dropDuplicates(["id"]).join(few.dropDuplicates(["id"]), "id").join(gold, "id", "left")
    rows = drawn.select("hits", "mask", F.coalesce("label", F.lit(-1)).alias("known")).limit(2 * TRAINING_ROWS).toArrow()
    known = rows.column("known").to_numpy()
    target = label_model.posterior(votes_of(rows.column("mask").to_numpy(), voters))
    target = np.where(known >= 0, known, target)
    return Model(table, fit_classifier(_lists(rows), target, len(table)))


def _scores(column: pa.Array, model: Model) -> np.ndarray:
    out = []
    for _, rows, _, _, _, _, at, value in _hits(column, model.features):
        logit = np.bincount(at, weights=model.weights[value], minlength=rows) + model.weights[-1]
        out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row. A null or empty text is scored by the bias; repeated rows and null
    keys come back as they are; an empty table gives no rows; other columns are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), model))], [batch.schema.names[0], "score"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    found = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")
    return found.select(key, (fold(F.col(key)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose score stays below `limit`."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), model) < limit))

    return docs.mapInArrow(run, docs.schema)
