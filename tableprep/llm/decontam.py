"""Benchmark decontamination: a BM25 inverted index of test items, searched by every passage of every document.

The index is small and goes to the tasks; passages are the queries. Block-max WAND with a fixed threshold decides which
parts of the index a passage has to look at: a passage whose terms' maxima can't reach the lowest threshold looks nowhere;
else its terms' maxima per block of items are added up and only blocks that may reach a threshold are scored exactly.
Retrieved items are verified by the overlap of their question and of their answer with the passage; items without an
answer of their own also by the overlap of their whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.llm import shingles

K1, B = 1.2, 0.75
#: Items per block of the index, and items per index: more items make further indexes, searched one after the other.
BLOCK, MOST_ITEMS = 16, 200_000
#: A passage retrieves an item if its score reaches this share of what the item's own text would score.
RETRIEVE, OVERLAP, GRAM = 0.6, 0.8, 5


def last_sentence(text: Column) -> tuple[Column, Column]:
    """(question, answer) of an item without an answer of its own: its last sentence serves as answer, unless it is the
    only one."""
    answer = F.regexp_extract(text, r"(?s)[.!?]\s+([^.!?]+[.!?]*\s*)$", 1)
    return F.substring(text, F.lit(1), F.length(text) - F.length(answer)), answer


@dataclass(frozen=True)
class Index:
    """terms: sorted word hashes; most: each term's best score; entries of a term (one per block that has it) run from
    first[t] to first[t + 1] with block and best score; postings of an entry run from start[e] to start[e + 1] with item
    and score. Items are sorted by threshold, so that blocks hold alike ones. parts: (question, answer) as term numbers. whole: whether the item's whole text may decide."""

    ids: np.ndarray
    terms: np.ndarray
    most: np.ndarray
    first: np.ndarray
    block: np.ndarray
    best: np.ndarray
    start: np.ndarray
    item: np.ndarray
    score: np.ndarray
    threshold: np.ndarray
    parts: list[tuple[tuple[int, ...], tuple[int, ...]]]
    whole: np.ndarray
    words: int

    @property
    def floors(self) -> np.ndarray:
        """The lowest threshold of each block."""
        return np.minimum.reduceat(self.threshold, np.arange(0, len(self.threshold), BLOCK))


def _hashed(column: pa.Array) -> list[np.ndarray]:
    out = []
    for _, data, offsets in shingles.slices(column):
        row, start, end = shingles.words(data, offsets, shingles.PUNCTUATED)
        ends = np.cumsum(np.bincount(row, minlength=len(offsets) - 1))[:-1]
        out += np.split(shingles.word_hashes(data, start, end), ends)
    return out


def build(items: pa.Table, retrieve: float = RETRIEVE) -> Index | None:
    """The index of (id, question, answer, and perhaps whole) rows; None if no item has a word. Items without a word are left out."""
    question, answer = (_hashed(items.column(c).combine_chunks()) for c in ("question", "answer"))
    flags = items.column("whole").to_pylist() if "whole" in items.column_names else [False] * len(items)
    found = [(i, q, a, f) for i, q, a, f in zip(items.column("id").to_pylist(), question, answer, flags) if len(q) + len(a)]
    if not found:
        return None
    whole = [np.concatenate((q, a)) for _, q, a, _ in found]
    terms, term = np.unique(np.concatenate(whole), return_inverse=True)
    length = np.array([len(w) for w in whole])
    owner = np.repeat(np.arange(len(whole)), length)
    pair, times = np.unique(owner * len(terms) + term, return_counts=True)
    owner, term = pair // len(terms), pair % len(terms)
    df = np.bincount(term, minlength=len(terms))
    rarity = np.log1p((len(whole) - df + 0.5) / (df + 0.5))
    score = rarity[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * length[owner] / length.mean()))
    own = np.bincount(owner, weights=score, minlength=len(whole))
    order = np.argsort(own, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sort = np.lexsort((place[owner], term))
    term, item, score = term[sort], place[owner][sort], score[sort]
    entry = np.ones(len(term), bool)
    entry[1:] = (term[1:] != term[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)
    start = np.flatnonzero(entry)
    at = np.searchsorted(terms, np.concatenate(whole))
    split = np.split(at, np.cumsum(length)[:-1])
    parts = [(tuple(split[k][:len(found[k][1])].tolist()), tuple(split[k][len(found[k][1]):].tolist())) for k in order]
    return Index(np.array([found[k][0] for k in order]), terms, np.maximum.reduceat(score, np.searchsorted(term, np.arange(len(terms)))),
                 np.searchsorted(term[start], np.arange(len(terms) + 1)), item[start] // BLOCK, np.maximum.reduceat(score, start),
                 np.append(start, len(term)), item, score, retrieve * own[order], parts,
                 np.array([found[k][3] for k in order], bool), int(length.max()))


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (k, j) with first[k] <= j < last[k]."""
    n = last - first
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + first[k]


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(key, return_inverse=True)
    return keys, np.bincount(where, weights=value, minlength=len(keys))


def retrieve(index: Index, window: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, score) of all items that reach their threshold, from distinct (window, term) pairs."""
    k, entry = _spread(index.first[term], index.first[term + 1])
    blocks, floors = int(index.block.max()) + 1, index.floors
    key = window[k] * blocks + index.block[entry]
    keys, bound = _summed(key, index.best[entry])
    alive = keys[bound >= floors[keys % blocks] * (1 - 1e-9)]
    keep = np.isin(key, alive)
    k, posting = _spread(index.start[entry[keep]], index.start[entry[keep] + 1])
    items = len(index.ids)
    keys, score = _summed(window[np.repeat(np.arange(len(window)), index.first[term + 1] - index.first[term])[keep][k]] * items
                          + index.item[posting], index.score[posting])
    good = score >= index.threshold[keys % items] * (1 - 1e-9)
    return keys[good] // items, keys[good] % items, score[good]


def _share(part: tuple[int, ...], passage: list[int]) -> float:
    """Share of a part's distinct word n-grams that the passage has (1 for an empty part)."""
    if not part:
        return 1.0
    n = min(GRAM, len(part))
    grams = {part[i:i + n] for i in range(len(part) - n + 1)}
    there = {tuple(passage[i:i + n]) for i in range(len(passage) - n + 1)}
    return len(grams & there) / len(grams)


def search_slice(index: Index, data: np.ndarray, offsets: np.ndarray, overlap: float) -> Iterator[tuple]:
    """(row, item, score, question's overlap, answer's overlap) of verified hits, the best passage of each pair.

    Passages are twice as long as the longest item and start every half of that, so any copy lies whole in one."""
    row, start, end = shingles.words(data, offsets, shingles.PUNCTUATED)
    if not len(row):
        return
    hashes = shingles.word_hashes(data, start, end)
    place = np.searchsorted(index.terms, hashes)
    place[place == len(index.terms)] = 0
    known = index.terms[place] == hashes
    term = np.where(known, place, -1)
    n = np.bincount(row, minlength=len(offsets) - 1)
    begin = np.cumsum(n) - n
    count = np.where(n > 0, np.maximum(1, -(-(n - index.words) // index.words)), 0)
    owner, k = _spread(np.zeros_like(count), count)
    left = begin[owner] + k * index.words
    right = np.minimum(left + 2 * index.words, begin[owner] + n[owner])
    most = np.concatenate(([0.0], np.cumsum(np.where(known, index.most[place], 0.0))))
    # repeated terms only raise this bound, and a little room is left for rounding
    near = np.flatnonzero(most[right] - most[left] >= index.threshold[0] * (1 - 1e-6))
    window, spot = _spread(left[near], right[near])
    spot, window = spot[known[spot]], window[known[spot]]
    pair = np.unique(window * len(index.terms) + term[spot])
    found: dict[tuple[int, int], tuple] = {}
    for w, item, score in zip(*(x.tolist() for x in retrieve(index, pair // len(index.terms), pair % len(index.terms)))):
        passage = term[left[near[w]]:right[near[w]]].tolist()
        question, answer = (_share(p, passage) for p in index.parts[item])
        both = question >= overlap and answer >= overlap
        if both or index.whole[item] and _share(sum(index.parts[item], ()), passage) >= overlap:
            key = (int(owner[near[w]]), item)
            found[key] = max(found.get(key, ()), (score, question, answer))
    for (doc, item), rest in sorted(found.items()):
        yield doc, item, *rest


def indexes(items: DataFrame, key: str = "item_id") -> Iterator[Index]:
    """Indexes of all items (integer `key`, question, answer, and perhaps boolean whole), MOST_ITEMS or so in each; further ones have statistics of
    their own. Null parts count as ''."""
    wanted = items.select(F.col(key).cast("long").alias("id"), F.coalesce("question", F.lit("")).alias("question"),
                          F.coalesce("answer", F.lit("")).alias("answer"),
                          F.coalesce(F.col("whole") if "whole" in items.columns else F.lit(False), F.lit(False)).alias("whole"))
    blocks = max(1, -(-wanted.count() // MOST_ITEMS))
    for block in range(blocks):
        index = build(wanted.where(F.pmod(F.xxhash64("id", "question"), F.lit(blocks)) == block).toArrow())
        if index is not None:
            yield index


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", overlap: float = OVERLAP) -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap): every document that holds a test item, with the score of
    its best passage. `items` has integer item_id, question and answer. Both overlaps must reach `overlap`; where a boolean
    column `whole` is true (the answer is only cut from the text), it is enough that the whole item's overlap does.

    Words are runs of letters and digits, A-Z lower-cased. An overlap is the share of a part's distinct five-word n-grams
    (shorter parts: the whole part) that the passage has. Null texts, questions and answers count as ''; items without a
    word never match; repeated documents and items give repeated hits; equal items with different ids each match. Rows
    with a null key come back under that key. Empty tables give no rows. Other columns are left out. Every document is
    searched whole, by every index.
    """
    spark = docs.sparkSession
    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id long, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    for k, index in enumerate(indexes(items)):
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, data, offsets in shingles.slices(batch.column(1)):
                    rows = list(search_slice(index, data, offsets, overlap))
                    if rows:
                        doc, item, *rest = zip(*rows)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array([first + d for d in doc])), pa.array(index.ids[list(item)]),
                             *(pa.array(x, pa.float64()) for x in rest)],
                            [batch.schema.names[0], "item_id", "score", "question_overlap", "answer_overlap"])

        found = docs.select(key, text).mapInArrow(run, schema)
        out = out.unionByName(found) if k else found
    return out


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", overlap: float = OVERLAP) -> DataFrame:
    """The rows of `docs`, all columns, that hold no test item; one pass per index, without a shuffle."""
    at = docs.columns.index(text)
    for index in indexes(items):
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, data, offsets in shingles.slices(batch.column(at)):
                    keep[[first + row[0] for row in search_slice(index, data, offsets, overlap)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
