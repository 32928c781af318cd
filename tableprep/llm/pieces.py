"""SentencePiece encoding and decoding (byte-pair models) by suffix-array matching.

The distinct new words of a batch are laid out one after the other and a suffix array of that text is built. Every piece of
the vocabulary is looked up in it by binary search; its range lists all places where the piece occurs. These occurrences
are the edges of a lattice. Sorted by the position where they end, they are relaxed: a prefix's best last piece is the one
edge that the merge rules allow after the best last piece of the prefix where it starts. The result is the encoding that
merging pairs by rank gives.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Characters of text per suffix array, and words whose encoding a task remembers before it starts afresh.
SLICE_CHARS, REMEMBERED = 2_000_000, 500_000
NEVER = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as arrays, in order of id. text: the piece; single: the byte of byte pieces, else -1; made: when merging makes
    a piece (its rank; -1 for single characters); left, right: what it is made of; pairs, pair_rank: all pairs of pieces
    that merge, sorted, and the rank of what they make; symbols: sorted code points of all pieces; matched: the pieces that
    encoding can give (no byte pieces, no runs of spaces), as rows of symbols (0 beyond the end) with their lengths; bigrams: pairs of characters
    inside pieces; runs: score and id of each run of spaces, by length."""

    text: list[str]
    single: np.ndarray
    made: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray
    pair_rank: np.ndarray
    symbols: np.ndarray
    matched: np.ndarray
    rows: np.ndarray
    lengths: np.ndarray
    bigrams: np.ndarray
    runs: dict[int, tuple[float, int]]
    bytes_: np.ndarray

    @property
    def unknown(self) -> int:
        """Stands for a character without a piece, until its bytes replace it."""
        return len(self.text)


def _last_merge(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The pair whose merge makes `piece`, when its characters are merged by rank; None if merging ends elsewhere."""
    parts = list(piece)
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], NEVER), i))
        if parts[best] + parts[best + 1] not in rank:
            return None
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 1:
            return None
    return (parts[0], parts[1]) if len(parts) == 2 else None


def _level(rows: np.ndarray, bits: int) -> np.ndarray:
    """Rows of a few symbols as one number each, in the rows' order."""
    out = np.zeros(len(rows), np.int64)
    for column in rows.T:
        out = (out << bits) | column
    return out


def load(path: str) -> Vocabulary:
    """Reads a model file on the driver. Byte-pair models with byte fallback, identity normalisation and a leading space
    are understood; others are refused."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    normal, trainer = model.normalizer_spec, model.trainer_spec
    reader = sentencepiece.SentencePieceProcessor(model_file=path)
    text = [reader.id_to_piece(i) for i in range(reader.get_piece_size())]
    is_byte = np.array([reader.is_byte(i) for i in range(len(text))])
    plain = [i for i, p in enumerate(model.pieces) if p.type == 1]
    space_runs = [i for i in plain if set(text[i]) == {SPACE}]
    number_of_spaces = {text[i]: i for i in space_runs}
    score = {text[i]: model.pieces[i].score for i in plain}
    lowest = min((score[text[i]] for i in plain if len(text[i]) > 1 and i not in space_runs), default=0.0)
    if (trainer.model_type != 2 or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix
            or not normal.escape_whitespaces or is_byte.sum() != 256
            or any(score[text[i]] >= lowest for i in space_runs if len(text[i]) > 1) or SPACE not in number_of_spaces
            or any(SPACE in text[i][1:] and i not in space_runs for i in plain)):
        raise ValueError("only byte-pair models with byte fallback, identity normalisation and plain spaces are supported")

    order = sorted((i for i in plain if len(text[i]) > 1 and i not in space_runs), key=lambda i: (-score[text[i]], i))
    rank = {text[i]: r for r, i in enumerate(order)}
    number = {text[i]: i for i in plain}
    made, left, right = (np.full(len(text) + 1, -1, np.int64) for _ in range(3))
    matched = [i for i in plain if len(text[i]) == 1]
    for i in order:
        pair = _last_merge(text[i], rank)
        if pair is not None and pair[0] in number and pair[1] in number:
            made[i], left[i], right[i] = rank[text[i]], number[pair[0]], number[pair[1]]
            matched.append(i)
    pairs = [(number[p[:k]] * (len(text) + 1) + number[p[k:]], r) for p, r in rank.items() for k in range(1, len(p))
             if p[:k] in number and p[k:] in number]
    pairs.sort()
    symbols = np.array(sorted({ord(c) for i in plain for c in text[i]}), np.uint32)
    matched = np.array(sorted(matched))
    lengths = np.array([len(text[i]) for i in matched])
    rows = np.zeros((len(matched), int(lengths.max())), np.int64)
    for k, i in enumerate(matched):
        rows[k, :lengths[k]] = np.searchsorted(symbols, [ord(c) for c in text[i]]) + 1
    inside = np.unique([a * 65536 + b for row, n in zip(rows, lengths) for a, b in zip(row[:n - 1], row[1:n])])
    single = np.array([int(text[i][3:5], 16) if is_byte[i] else -1 for i in range(len(text))])
    at_byte = np.empty(256, np.int64)
    at_byte[single[single >= 0]] = np.flatnonzero(single >= 0)
    return Vocabulary(text, single, made, left, right, np.array([p for p, _ in pairs]), np.array([r for _, r in pairs]), symbols,
                      matched, rows, lengths, inside,
                      {len(text[i]): (score[text[i]], i) for i in space_runs}, at_byte)


def _may_follow(v: Vocabulary, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether merging would leave the pieces side by side. Their merges are undone, the latest first; if the pieces then
    in touch could merge before the merge just undone, merging would have crossed the border."""
    fine = np.zeros(len(first), bool)
    here = np.arange(len(first))
    first, second, limit = first.copy(), second.copy(), np.full(len(first), NEVER)
    while len(here):
        key = first * (v.unknown + 1) + second
        place = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
        crossed = np.where(v.pairs[place] == key, v.pair_rank[place], NEVER) < limit
        a, b = v.made[first], v.made[second]
        whole = (a < 0) & (b < 0)
        fine[here[whole & ~crossed]] = True
        go = ~(whole | crossed)
        here, first, second, a, b = here[go], first[go], second[go], a[go], b[go]
        undo = a > b
        limit = np.where(undo, a, b + 1)  # of equal merges the left one comes first
        first, second = np.where(undo, v.right[first], first), np.where(undo, second, v.left[second])
    return fine


def _search(values: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray, after: bool) -> np.ndarray:
    """For each target the first place in [low, high) whose value is not below it (`after`: above it); binary search."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        value = values[np.minimum(middle, len(values) - 1)]
        right = open_ & ((value <= target) if after else (value < target))
        low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
    return low


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of keys; equal keys share a rank, from 1 on."""
    order = np.argsort(key)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0) + 1
    return order, rank


def _edges(v: Vocabulary, symbol: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, number among v.matched) of all occurrences of pieces; `room` is what is left of the segment."""
    bits = max(1, int(len(v.symbols)).bit_length())
    step = 60 // bits
    levels = -(-v.rows.shape[1] // step)
    ahead = lambda x, n: np.where(room > n, np.append(x[n:], np.zeros(min(n, len(x)), x.dtype)), 0)
    key = np.zeros(len(symbol), np.int64)
    for n in range(step):
        key = (key << bits) | ahead(symbol, n)
    suffixes, rank = _ranked(key)  # the suffix array, by prefix doubling up to the longest piece
    reach = step
    while reach < v.rows.shape[1]:
        suffixes, rank = _ranked((rank << 32) | ahead(rank, reach))
        reach *= 2
    low, high = np.zeros(len(v.matched), np.int64), np.full(len(v.matched), len(symbol))
    for level in range(levels):
        values = ahead(key, level * step)[suffixes] if level else key[suffixes]
        part = v.rows[:, level * step:(level + 1) * step]
        width = np.clip(v.lengths - level * step, 0, step)
        blank = np.int64(1) << (bits * (step - np.minimum(width, step)))
        least = _level(part, bits) << (bits * (step - part.shape[1]))
        on = width > 0
        new_low = _search(values, low[on], high[on], least[on], False)
        high[on] = _search(values, low[on], high[on], (least + blank - 1)[on], True)
        low[on] = new_low
    n = high - low
    piece = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n) + low[piece]
    return suffixes[at], piece


def encode_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of words, each with its leading space mark; no other space marks may occur."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    length = np.array([len(w) for w in words], np.int64)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    symbol = np.searchsorted(v.symbols, points)
    symbol = np.where(v.symbols[np.minimum(symbol, len(v.symbols) - 1)] == points, symbol + 1, 0)
    # no merge crosses a pair of characters that no piece holds: segments between such places are on their own
    cut = np.ones(len(points) + 1, bool)
    cut[1:-1] = ~np.isin(symbol[:-1] * 65536 + symbol[1:], v.bigrams)
    cut[np.cumsum(length)[:-1]] = True
    begin = np.flatnonzero(cut)
    segment = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    head, tail = begin[segment], begin[segment + 1]
    start, piece = _edges(v, symbol, tail - np.arange(len(points)))
    token, stop = v.matched[piece], start + v.lengths[piece]
    strange = np.flatnonzero(symbol == 0)
    start, token, stop = (np.concatenate(x) for x in ((start, strange), (token, np.full(len(strange), v.unknown)), (stop, strange + 1)))
    depth = stop - head[start]
    order = np.argsort(depth, kind="stable")
    start, token, stop, depth = start[order], token[order], stop[order], depth[order]
    last, source = np.full(len(points), -1, np.int64), np.zeros(len(points), np.int64)  # by the last character covered
    steps = np.flatnonzero(np.diff(depth, prepend=0, append=NEVER))
    for a, b in zip(steps[:-1], steps[1:]):
        s, t = start[a:b], token[a:b]
        first = s == head[s]
        before = np.where(first, -1, last[s - 1])
        good = first.copy()
        ask = np.flatnonzero(~first & (before >= 0))
        good[ask] = _may_follow(v, before[ask], t[ask])
        last[stop[a:b][good] - 1], source[stop[a:b][good] - 1] = t[good], s[good]
    ids, at = [], []
    spot = begin[1:] - 1
    while len(spot):
        ids.append(last[spot])
        at.append(source[spot])
        spot = source[spot][source[spot] != head[source[spot]]] - 1
    ids, at = np.concatenate(ids), np.concatenate(at)
    order = np.argsort(at)
    ids, at = ids[order], at[order]
    raw = np.where(ids == v.unknown, np.where(points[at] < 0x80, 1, np.where(points[at] < 0x800, 2, np.where(points[at] < 0x10000, 3, 4))), 1)
    if (ids == v.unknown).any():
        ids, at = np.repeat(ids, raw), np.repeat(at, raw)
        data = points[np.unique(at[ids == v.unknown])].astype("<u4").tobytes().decode("utf-32-le").encode()
        ids[ids == v.unknown] = v.bytes_[np.frombuffer(data, np.uint8)]
    bounds = np.concatenate(([0], np.cumsum(length)))
    return ids, np.searchsorted(at, bounds)


class Encoder:
    """Encodes texts; remembers words for a while. One per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _spaces(self, n: int) -> list[int]:
        """Runs of spaces merge after everything else: by score, the leftmost pair first."""
        size, after, before = [1] * n, [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(-self.v.runs[2][0], i) + (1, 1) for i in range(n - 1)] if 2 in self.v.runs else []
        while queue:
            _, i, one, two = heapq.heappop(queue)
            j = after[i] if size[i] == one else -1
            if j < 0 or size[j] != two:
                continue
            size[i], size[j], after[i] = one + two, 0, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and size[k] + size[after[k]] in self.v.runs:
                    heapq.heappush(queue, (-self.v.runs[size[k] + size[after[k]]][0], k, size[k], size[after[k]]))
        return [self.v.runs[x][1] for x in size if x]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.forget()
        split = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
        new = list(dict.fromkeys(w for words in split for w in words if w and w not in self.known))
        if new:
            ids, offsets = encode_words(self.v, [SPACE + w for w in new])
            self.known.update(zip(new, range(len(self.offsets) - 1, len(self.offsets) - 1 + len(new))))
            self.ids = np.concatenate((self.ids, ids))
            self.offsets = np.concatenate((self.offsets, self.offsets[-1] + offsets[1:]))
        return [self._joined(words) for words in split]

    def _joined(self, words: list[str]) -> np.ndarray:
        if "" not in words:
            return self._gather(words)
        out, empty, run = [], 0, []
        for w in words:  # a run of spaces takes the word's own space too, if the word leaves it alone
            if w == "":
                out.append(self._gather(run))
                run, empty = [], empty + 1
                continue
            if empty:
                ids = self._gather([w])
                alone = ids[0] == self.v.runs[1][1]
                out += [np.array(self._spaces(empty + alone), np.int64), ids[int(alone):]]
                empty = 0
            else:
                run.append(w)
        out += [self._gather(run), np.array(self._spaces(empty), np.int64)]
        return np.concatenate(out)

    def _gather(self, words: list[str]) -> np.ndarray:
        spot = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        first, n = self.offsets[spot], self.offsets[spot + 1] - self.offsets[spot]
        return self.ids[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of a sequence of ids, without the leading space that encoding adds."""
    table = _bytes_of(v)
    text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


_known_bytes: dict[int, list[bytes]] = {}


def _bytes_of(v: Vocabulary) -> list[bytes]:
    if id(v) not in _known_bytes:
        _known_bytes[id(v)] = [bytes([b]) if b >= 0 else t.replace(SPACE, " ").encode() for t, b in zip(v.text, v.single.tolist())]
    return _known_bytes[id(v)]


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


def encode_table(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_pieces, pieces, decoded_equal) of every whole text: the ids, and whether decoding them gives the text back.

    A null or empty text has no pieces. The space mark U+2581 inside a text counts as a space and comes back as one, as the
    format has it; decoded_equal allows for that alone. Repeated rows and null keys come back as they are; an empty table
    gives no rows; other columns are left out. Long words are cut only where no piece can cross.
    """
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            done = 0
            for part in _slices([t or "" for t in batch.column(1).to_pylist()]):
                found = encoder.encode(part)
                same = [decode(vocabulary, ids) == t.replace(SPACE, " ") for ids, t in zip(found, part)]
                n = np.array([len(ids) for ids in found], np.int64)
                flat = pa.array(np.concatenate(found).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.array(n), lists, pa.array(same)],
                                                 [batch.schema.names[0], "n_pieces", "pieces", "decoded_equal"])
                done += len(part)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_pieces long, pieces array<int>, decoded_equal boolean")
