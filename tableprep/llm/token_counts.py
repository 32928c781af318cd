"""Token counts by rank-synchronous array merging.

The new words of a slice of texts lie one after the other in one numpy array of symbols, cut into sequences. In every round
each sequence finds the lowest rank among its neighbouring pairs, all sequences merge the pairs of that rank at the same
time, and only the pairs next to a merge are looked up again. Sequences without a pair that merges leave the array. The
symbols that survive are the tokens; characters without a piece count as their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SPACE = "▁"
#: Characters of text per slice, and words whose count a task remembers before it starts afresh.
SLICE_CHARS, REMEMBERED = 2_000_000, 1_000_000
NEVER = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Ranks:
    """What merging needs. points, symbols: code points with a piece of their own, sorted, and its id; pairs: left id * size
    + right id of all pairs that merge, sorted, with the rank and the id of what they make; eager: by rank, whether a piece can
    take part in a merge of lower rank than its own; bigrams: pairs of characters inside pieces; longest: characters of the
    longest piece; space: id of the single space; spaces: tokens of a run of so many spaces; period: beyond that list every
    further so many spaces are one token more."""

    points: np.ndarray
    symbols: np.ndarray
    size: int
    pairs: np.ndarray
    pair_rank: np.ndarray
    pair_made: np.ndarray
    eager: np.ndarray
    bigrams: np.ndarray
    longest: int
    space: int
    spaces: list[int]
    period: int

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id made) of pairs; the rank is NEVER if they don't merge."""
        key = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        spot = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        found = self.pairs[spot] == key
        return np.where(found, self.pair_rank[spot], NEVER), self.pair_made[spot]


def _space_blocks(n: int, known: set[int]) -> list[int]:
    """Lengths of the tokens of n spaces when all runs have the same score: always the leftmost pair that makes a piece."""
    sizes, i = [1] * n, 0
    while i + 1 < len(sizes):
        if sizes[i] + sizes[i + 1] in known:
            sizes[i:i + 2] = [sizes[i] + sizes[i + 1]]
            i = max(i - 1, 0)
        else:
            i += 1
    return sizes


def load(path: str) -> Ranks:
    """Reads a SentencePiece model file on the driver. Byte-pair models with byte fallback, identity normalisation, a
    leading space and pieces that hold spaces at their start alone are understood; others are refused."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    normal, trainer = model.normalizer_spec, model.trainer_spec
    plain = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
    number, runs = {p: i for p, i, _ in plain}, [(len(p), s) for p, _, s in plain if set(p) == {SPACE}]
    order = sorted((x for x in plain if set(x[0]) != {SPACE} and len(x[0]) > 1), key=lambda x: -x[2])
    scores = [s for _, _, s in order]
    if (trainer.model_type != 2 or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix
            or not normal.escape_whitespaces or sum(p.type == 6 for p in model.pieces) != 256 or SPACE not in number
            or any(p.type in (4, 5) for p in model.pieces) or len(set(scores)) < len(scores)
            or len({s for _, s in runs}) > 1 or runs[0][1] >= min(scores, default=np.inf)
            or any(SPACE in p[1:] and set(p) != {SPACE} for p, _, _ in plain)):
        raise ValueError("only byte-pair models with byte fallback, identity normalisation and plain spaces are supported")

    rank = {p: r for r, (p, _, _) in enumerate(order)}
    eager = np.zeros(len(order), bool)
    pairs = []
    for piece, r in rank.items():
        for k in range(1, len(piece)):
            left, right = piece[:k], piece[k:]
            if left in number and right in number:
                pairs.append((number[left] * len(model.pieces) + number[right], r, number[piece]))
                for part in (left, right):
                    if rank.get(part, -1) > r:
                        eager[rank[part]] = True
    pairs.sort()
    points = np.array(sorted((ord(p), i) for p, i in number.items() if len(p) == 1), np.int64).reshape(-1, 2)
    bigrams = np.unique(np.array([ord(a) << 32 | ord(b) for p in rank for a, b in zip(p, p[1:])], np.int64))
    known = {n for n, _ in runs}
    widest, least = max(known), 4 * max(known)
    period = _space_blocks(least, known)[0]
    spaces = [len(_space_blocks(n, known)) for n in range(least + 1)]
    if any(spaces[n] != spaces[n - period] + 1 for n in range(2 * widest, least + 1)):
        raise ValueError("runs of spaces without a steady pattern are not supported")
    columns = np.array(pairs, np.int64).reshape(-1, 3).T
    return Ranks(points[:, 0], points[:, 1], len(model.pieces), *columns, eager, bigrams, max(map(len, number)), number[SPACE],
                 spaces, period)


def _chosen(ranks: Ranks, hit: np.ndarray, rank: np.ndarray, sequence: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which hits (indices of pairs with their sequence's lowest rank) merge now: those that merging one by one from the left
    would merge before anything else can touch them. Of pairs in touch every other one; a piece that may at once take part
    in a lower merge holds back hits that its growth might reach."""
    same = np.diff(sequence[hit], prepend=-1) == 0
    begins = ~same | (np.diff(hit, prepend=-2) != 1)
    order = np.arange(len(hit))
    plain = (order - np.maximum.accumulate(np.where(begins, order, 0))) % 2 == 0
    clear = ~same | (np.diff(at[hit], prepend=0) > 2 * ranks.longest)
    return hit[np.where(ranks.eager[rank[hit]], clear, plain)]


def count_tokens(ranks: Ranks, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, leaves its space alone) of words, each with its leading space mark and no other."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    length = np.array([len(w) for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), length)
    spot = np.minimum(np.searchsorted(ranks.points, points), len(ranks.points) - 1)
    symbol = np.where(ranks.points[spot] == points, ranks.symbols[spot], -1)
    # a character without a piece is as many tokens as it has bytes
    extra = np.where(symbol < 0, (points >= 0x80) * 1 + (points >= 0x800) + (points >= 0x10000), 0)
    tokens = np.bincount(word, extra, len(words)).astype(np.int64)
    alone = np.zeros(len(words), bool)
    # no merge crosses two characters that stand side by side in no piece: sequences end there
    joint = np.isin(points[:-1] << 32 | points[1:], ranks.bigrams) & (word[:-1] == word[1:])
    sequence = np.concatenate(([0], np.cumsum(~joint))) if len(points) else np.zeros(0, np.int64)
    at = np.arange(len(points))
    rank, made = np.full(len(points), NEVER), np.full(len(points), -1)
    inside = np.flatnonzero(joint)
    rank[inside], made[inside] = ranks.look_up(symbol[inside], symbol[inside + 1])
    heads = np.concatenate(([0], np.cumsum(length)[:-1])).astype(np.int64)
    while len(symbol):
        starts = np.flatnonzero(np.diff(sequence, prepend=-1))
        sizes = np.diff(starts, append=len(symbol))
        least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        over = least == NEVER
        if over.any():
            tokens += np.bincount(word[over], minlength=len(words))
            first = over & (at == heads[word])
            alone[word[first]] = symbol[first] == ranks.space
            stay = ~over
            symbol, word, sequence, at, rank, made, least = (x[stay] for x in (symbol, word, sequence, at, rank, made, least))
            if not len(symbol):
                break
        merge = _chosen(ranks, np.flatnonzero(rank == least), rank, sequence, at)
        symbol[merge] = made[merge]
        keep = np.ones(len(symbol), bool)
        keep[merge + 1] = False
        place = (np.cumsum(keep) - 1)[merge]
        symbol, word, sequence, at, rank, made = (x[keep] for x in (symbol, word, sequence, at, rank, made))
        again = np.unique(np.concatenate((place, place - 1)))
        again = again[again >= 0]
        closed = (again == len(symbol) - 1)
        after = np.minimum(again + 1, len(symbol) - 1)
        closed |= sequence[after] != sequence[again]
        new_rank, made[again] = ranks.look_up(symbol[again], symbol[after])
        rank[again] = np.where(closed, NEVER, new_rank)
    return tokens, alone


class Counter:
    """Counts tokens of texts; remembers words for a while. One per task."""

    def __init__(self, ranks: Ranks):
        self.ranks, self.known = ranks, {}  # word -> its tokens; words that leave their space alone are in `loose`
        self.loose: set[str] = set()

    def _learn(self, new: list[str]) -> None:
        tokens, alone = count_tokens(self.ranks, [SPACE + w for w in new])
        self.known.update(zip(new, tokens.tolist()))
        self.loose.update(w for w, a in zip(new, alone.tolist()) if a)

    def _run(self, n: int) -> int:
        more = max(0, -(-(n - len(self.ranks.spaces) + 1) // self.ranks.period))
        return self.ranks.spaces[n - more * self.ranks.period] + more

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known, self.loose = {}, set()
        split = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
        new = set().union(*split) - self.known.keys() - {""}
        if new:
            self._learn(sorted(new))
        return [self._total(words) for words in split]

    def _total(self, words: list[str]) -> int:
        if "" not in words:
            return sum(map(self.known.__getitem__, words))
        total = empty = 0
        for w in words:  # a run of spaces takes the word's own space too, if the word leaves it alone
            if not w:
                empty += 1
                continue
            total += self.known[w]
            if empty:
                loose = w in self.loose
                total += self._run(empty + loose) - loose
                empty = 0
        return total + self._run(empty)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def count_table(df: DataFrame, ranks: Ranks, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text.

    n_bytes is the length in UTF-8, over_limit says that there are more than `limit` tokens. A null or empty text has none.
    Strings that look like special tokens are ordinary text, as the library has it. Repeated rows and null keys come back as
    they are; an empty table gives no rows; other columns are left out. The row order does not matter.
    """
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            n = pa.array([x for part in _slices(texts.to_pylist()) for x in counter.count(part)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)],
                                             [batch.schema.names[0], "n_bytes", "n_tokens", "over_limit"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
