"""Document fingerprints from prefix polynomial hashes.

`PrefixHash` keeps, for two prime moduli, the hash of every prefix of a text. Any span's hash follows from two entries,
so spans of two texts are compared in constant time and the longest common extension of two positions is a binary search.
A fingerprint keeps the hash of the whole text and a ladder of prefix and suffix hashes whose lengths grow by about a
fifth, so that the common start and end of two documents can be searched on the fingerprints alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import blocks_for

MODULI = (2147483647, 2147483629)
BASES = (1103515245, 69069069)
#: Hex digits of each rung, and the rungs: four to an octave, from 8 code points on.
DIGITS = 6
_tables: dict[int, tuple[np.ndarray, ...]] = {}


def rungs(n: int) -> np.ndarray:
    """Lengths of the ladder of a text of n code points."""
    if n < 8:
        return np.zeros(0, np.int64)
    return np.floor(8 * 2 ** (np.arange(int(4 * np.log2(n / 8)) + 2) / 4)).astype(np.int64).clip(max=n + 1)


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n, kept for the next text; doubled as longer texts come."""
    if which not in _tables or len(_tables[which][0]) < n:
        mod, out = MODULI[which], []
        size = max(1 << 12, 1 << int(n - 1).bit_length())
        for base in (BASES[which], pow(BASES[which], -1, mod)):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.concatenate((table, table * np.uint64(pow(base, len(table), mod)) % np.uint64(mod)))
            out.append(table)
        _tables[which] = tuple(out)
    return tuple(t[:n] for t in _tables[which])


class PrefixHash:
    """Hashes of all prefixes of a text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.sums = []
        for which, mod in enumerate(MODULI):
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(points * _powers(which, self.n)[0] % np.uint64(mod), out=sums[1:])
            self.sums.append(sums % np.uint64(mod))

    def spans(self, start, end) -> np.ndarray:
        """62-bit hashes of the spans [start, end); equal texts give equal hashes wherever they stand."""
        start, end = np.asarray(start), np.asarray(end)
        parts = []
        for which, mod in enumerate(MODULI):
            shift = _powers(which, self.n + 1)[1][start]
            parts.append((self.sums[which][end] + np.uint64(mod) - self.sums[which][start]) % np.uint64(mod) * shift % np.uint64(mod))
        return (parts[0] << np.uint64(31)) | parts[1]

    def same(self, start: int, other: PrefixHash, at: int, length: int) -> bool:
        return bool(self.spans(start, start + length) == other.spans(at, at + length))

    def extension(self, start: int, other: PrefixHash, at: int, backwards: bool = False) -> int:
        """Longest common extension from `start` here and `at` there (or up to them, backwards), by binary search."""
        low, high = 0, min(start, at) if backwards else min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            back = middle if backwards else 0
            if self.same(start - back, other, at - back, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def fingerprint(self) -> str:
        """Length, hash of all, then the rungs of the prefix ladder and of the suffix ladder."""
        steps = rungs(self.n)
        steps = steps[steps <= self.n]
        short = lambda values: "".join(f"{int(v) & (16 ** DIGITS - 1):0{DIGITS}x}" for v in values)
        front = self.spans(np.zeros(len(steps), np.int64), steps)
        back = self.spans(self.n - steps, np.full(len(steps), self.n))
        return f"{self.n:x}-{int(self.spans(0, self.n)):016x}-{short(front)}-{short(back)}"


def likeness(a: str, b: str) -> float:
    """Share of the longer text that a common start and a common end cover, as far as the two ladders show it: a binary
    search over each. 1 for equal fingerprints, 0 without a common start or end of eight code points."""
    if a == b:
        return 1.0
    (n, _, *x), (m, _, *y) = a.split("-"), b.split("-")
    n, m = int(n, 16), int(m, 16)
    steps, found = rungs(min(n, m)), 0
    for one, two in zip(x, y):
        low, high = 0, min(len(one), len(two)) // DIGITS
        while low < high:
            middle = (low + high + 1) // 2
            spot = slice((middle - 1) * DIGITS, middle * DIGITS)
            low, high = (middle, high) if one[spot] == two[spot] else (low, middle - 1)
        found += int(steps[low - 1]) if low else 0
    return min(found, n, m) / max(n, m, 1)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (spare, id, text) in order of blocks; every row meets the next one, the last of a block its spare row."""
    held = None  # (id, text, fingerprint) of the row before

    def finish(row, text: str, mark: str | None):
        key, own, prints = row
        changed = edited(own, text)
        other = PrefixHash(changed).fingerprint()
        return (key, len(own), hashlib.sha256(changed.encode()).hexdigest(), prints, other, likeness(prints, other),
                likeness(prints, mark))

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    empty = PrefixHash("").fingerprint()
    for batch in batches:
        out = []
        for spare, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            text = text or ""
            if spare and held is None:
                continue  # another row with the next block's first key
            prints = PrefixHash(text).fingerprint()
            if held is not None:
                out.append(finish(held, text, prints))
            held = None if spare else (key, text, prints)
            if key is None:
                out.append(finish(held, "", empty))
                held = None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)


def fingerprint_table(df: DataFrame, key: str = "doc_id", text: str = "text", rows_per_block: int = 20_000) -> DataFrame:
    """Fingerprint of every text and of its edited text: the last floor(n / 2) code points give way to as many (or all)
    of the next document's, in descending order of the integer key; after the last comes the first.

    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is empty.
    Equal keys follow each other by text; repeated rows each come back. A row with a null key has no place in the order:
    its next text is empty. A single document is its own next. An empty table gives no rows. Other columns are left out.

    Texts move once: keys are cut into blocks at quantiles that are keys themselves, and the first row of each block is
    also sent to the block before, as its spare last row. Blocks stream through sorted partitions.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = docs.count()
    blocks = blocks_for(rows, rows_per_block)
    share = [i / blocks for i in range(1, blocks)] or [0.5]
    cuts = docs.agg(F.max("id").alias("top"), F.percentile_approx("id", share, 8 * blocks).alias("cuts")).first()
    heads = np.unique(np.array([] if cuts.top is None else [cuts.top, *(cuts.cuts if blocks > 1 else [])], np.int64))
    spread = spark.sparkContext.broadcast(heads)

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(spread.value, ids.to_numpy(), "left").astype(np.int32))

    @F.pandas_udf("boolean")
    def is_head(ids: pd.Series) -> pd.Series:
        return pd.Series(np.isin(ids.to_numpy(), spread.value))

    placed = docs.where("id is not null").select("id", "text", block_of("id").alias("block"), is_head("id").alias("head"))
    before = F.pmod(F.col("block") + 1, F.lit(max(1, len(heads))))  # blocks count upwards, the order goes down
    spots = F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("spare")))
    both = F.concat(spots, F.array(F.struct(before.alias("block"), F.lit(True).alias("spare"))))
    placed = placed.select("id", "text", F.explode(F.when(F.col("head"), both).otherwise(spots)).alias("spot"))
    loose = docs.where("id is null").select(F.lit(False).alias("spare"), "id", "text")
    dealt = (placed.select("spot.block", "spot.spare", "id", "text").repartition("block")
             .sortWithinPartitions("block", "spare", F.desc("id"), "text").select("spare", "id", "text"))
    columns = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")
    found = dealt.mapInArrow(_rows, columns).unionByName(loose.mapInArrow(_rows, columns))
    return found.withColumnRenamed("id", key)
