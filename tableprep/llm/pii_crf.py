"""Personal data: exact base patterns, and a linear-chain conditional random field over word shapes that adds spans.

A token is a run of bytes without white space; its shape is a small number built from counts of digits, dots, signs and
letters. The field scores the shapes of a token and its two neighbours and the step from label to label (begin, inside of
each kind, or other). It is trained on the driver from a small labelled table and decoded by Viterbi in numpy, many
chains side by side, over whole texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm import shingles

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Where no backtracking can change a match, quantifiers are possessive, so that long
# runs of digits take linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")

#: Small labelled table: {kind:text} marks a span. Carriers are short on purpose; shapes and neighbours matter, not words.
LABELLED = (
    "write to {email:anna.k7@mail3.example.com} today", "mail {email:bob_smith@host.org}, please", "contact {email:x.y@a-b.net}.",
    "send it to {email:joe[at]mail.example.com} soon", "reach me at {email:kim(at)host.org} or call", "und {email:ute.m@post.de} schreiben",
    "his address is {email:f00.bar+z@sub.example.co} now", "({email:info@site.fr})", "from {email:sales@shop.example.com} with love",
    "server {ip:10.20.30.40} is down", "ping {ip:192.168.0.1}, then {ip:8.8.8.8}", "host {ip:66.194.181.124} said", "at {ip:172.16.254.3}.",
    "login from {ip:23.102.220.119} failed twice", "route {ip:1.2.3.4} to {ip:45.196.222.209} again",
    "card {card:4811329106135696} was used", "pay with {card:4111 1111 1111 1111} now", "number {card:5500-0000-0000-0004}, thanks",
    "his {card:378282246310005} and hers", "use {card:4493999682557847} for it", "charge {card:6011 0009 9013 9424} please",
    "call {phone:+1 (626) 555-5759} tonight", "phone {phone:+49 30 1234567} or mail", "dial {phone:(212) 555-0143} now",
    "ring {phone:+1 (543) 555-9258}, ask for her", "tel {phone:555-867-5309} after noon", "fax {phone:+33 1 23 45 67 89} only",
    "the office {phone:(030) 555 0199} is open", "text {phone:+44 20 7946 0958}.", "on {phone:+1 (434) 555-2368} at once",
    "nothing to see here at all", "the year 2024 was good", "version 1.2.3 of the tool", "costs 12.50 a piece", "about 3. point of it",
    "born 1999-12-31 in town", "page 17 of 240, see note 3", "a ratio of 16:9 or 4:3", "the key 0641917ea4e9feb9cda83477b57ac265 is old",
    "chapter 2.4 and section 3.1", "between 10 and 15 of them", "he won 3-2 in 1987", "room 404 (second floor) is free", "buy 2, get 1",
    "that is 100% sure - or not", "a well-known (and loved) song", "e.g. the one. And the other", "on 01/15/2024 we left", "50,000 people came",
    "id = 83477", "@home with you", "the #1 song of 12 weeks", "x = \"AKIA0641\" in code", "einein öü und die ver", "Èonai aiaiai, retion en",
)
_DIGIT_STEPS = np.searchsorted(np.array([1, 2, 3, 4, 5, 8, 12]), np.arange(64), "right").astype(np.int64)
#: Parts of a shape: (name, number of values). Counts are cut off inside the shape only.
PARTS = (("digits", 8), ("at", 2), ("dots", 4), ("hyphens", 2), ("plus", 2), ("brackets", 2), ("letters", 2))
SHAPES = int(np.prod([n for _, n in PARTS]))
LABELS = 1 + 2 * len(KINDS)  # 0 other, then begin and inside of each kind
IMPOSSIBLE = -1e6


def _class(*chars: int) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = 1
    return table


_IS = {"digits": _class(*range(48, 58)), "at": _class(64), "dots": _class(46), "hyphens": _class(45), "plus": _class(43),
       "brackets": _class(40, 41, 91, 93), "letters": _class(*range(65, 91), *range(97, 123), *range(128, 256))}


def shapes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Shape of each token that begins at `start`; white space counts for nothing."""
    code = np.zeros(len(start), np.int64)
    if not len(start):
        return code
    for name, values in PARTS:
        count = np.add.reduceat(_IS[name][data], start, dtype=np.int64)
        part = _DIGIT_STEPS[np.minimum(count, 63)] if name == "digits" else np.minimum(count, values - 1)
        code = code * values + part
    return code


def _parts_of(code: np.ndarray) -> list[np.ndarray]:
    parts = []
    for _, values in reversed(PARTS):
        parts.append(code % values)
        code = code // values
    return parts


def _allowed() -> np.ndarray:
    """0 where a step between labels may be, IMPOSSIBLE where inside does not follow its own kind."""
    steps = np.zeros((LABELS, LABELS))
    for kind in range(len(KINDS)):
        steps[:, 2 + 2 * kind] = IMPOSSIBLE
        steps[[1 + 2 * kind, 2 + 2 * kind], 2 + 2 * kind] = 0
    return steps


def parse_labelled(rows: Sequence[str]) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans in bytes) of rows in which {kind:text} marks a span."""
    out = []
    for row in rows:
        text, spans, last = "", [], 0
        for m in re.finditer(r"\{(\w+):([^}]*)\}", row):
            text += row[last:m.start()]
            spans.append((len(text.encode()), len((text + m[2]).encode()), m[1]))
            text, last = text + m[2], m.end()
        out.append((text + row[last:], spans))
    return out


class Field:
    """The trained field: shape scores of the token before, itself and the one after, and label steps."""

    def __init__(self, here: np.ndarray, before: np.ndarray, after: np.ndarray, steps: np.ndarray):
        self.here, self.before, self.after, self.steps = here, before, after, steps
        # The most that steps can speak, per token, for a marked stretch against 'other': the step into it, one inside
        # it, and the one out of it, where an inside that follows would become a begin.
        label = np.arange(LABELS)
        turned = np.where((label > 0) & (label % 2 == 0), label - 1, label)
        ok = steps > IMPOSSIBLE / 2
        into = np.where(ok, steps - steps[:, :1], -np.inf)[:, 1:].max()
        within = np.where(ok[1:, 1:], steps[1:, 1:] - steps[0, 0], -np.inf).max()
        out = max(float(np.where(ok[b], steps[k, b] - steps[0, turned[b]] + steps[b] - steps[turned[b]], -np.inf).max())
                  for k in range(1, LABELS) for b in np.flatnonzero(ok[k]))
        self.most = max(0.0, float(into)) + max(0.0, float(within)) + max(0.0, out)

    def scores(self, code: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = self.here[code]
        same = row[1:] == row[:-1]
        out[1:][same] += self.before[code[:-1][same]]
        out[:-1][same] += self.after[code[1:][same]]
        return out

    def decode(self, code: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The best label of every token, by Viterbi over the chain of each row. Tokens that are 'other' on every best
        path, because neither steps nor neighbours could outweigh their shape, cut a chain into short ones, run side by side."""
        labels = np.zeros(len(code), np.int8)
        if not len(code):
            return labels
        scores = self.scores(code, row)
        surplus = scores[:, 0] - scores[:, 1:].max(axis=1) - self.most
        weak = surplus <= 0
        # Left of a weak token, a marked stretch may pay off until its surplus outweighs what an inside there gains.
        spot = np.flatnonzero(weak)
        need = np.maximum(0, (scores[spot, 2::2] - scores[spot, 1::2]).max(axis=1)) if len(spot) else np.zeros(0)
        kept, line = weak.copy(), row[spot]
        while len(spot):
            spot = spot - 1
            on = (spot >= 0) & (need >= 0)
            on[on] = ~weak[spot[on]] & (row[spot[on]] == line[on])
            spot, need, line = spot[on], need[on], line[on]
            kept[spot] = True
            need = need - surplus[spot]
        cut = ~kept
        live = np.flatnonzero(~cut)
        if not len(live):
            return labels
        new = np.ones(len(live), bool)
        new[1:] = (np.diff(live) > 1) | (row[live[1:]] != row[live[:-1]])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(live)))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        # a chain starts after 'other' or the row's start, and ends before 'other' or its end
        path = np.zeros((len(live), LABELS), np.int8)
        at_start = (live[first] == 0) | (row[live[first] - 1] != row[live[first]])
        best = scores[live[first]] + np.where(at_start[:, None], np.where(self.steps[0] > IMPOSSIBLE / 2, 0.0, IMPOSSIBLE), self.steps[0])
        ends = np.zeros((len(first), LABELS))
        for t in range(1, int(length[0]) + 1):
            active = int(np.searchsorted(-length, -t, "right")) if t <= length[0] else 0
            going = int(np.searchsorted(-length, -(t + 1), "right"))
            ends[going:active] = best[going:active]
            if not going:
                break
            total = best[:going, :, None] + self.steps
            path[first[:going] + t] = total.argmax(axis=1)
            best = total.max(axis=1) + scores[live[first[:going] + t]]
        last = first + length - 1
        after = live[last] + 1
        inner = (after < len(code)) & (row[np.minimum(after, len(code) - 1)] == row[live[last]])
        label = (ends + np.where(inner[:, None], self.steps[:, 0], 0.0)).argmax(axis=1)
        for t in range(int(length[0])):
            on = length > t
            spot = last[on] - t
            labels[live[spot]] = label[on]
            label = label.copy()
            label[on] = path[spot, label[on]]
        return labels


def _encoded(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shape, label, present), each rows x tokens, padded."""
    codes, golds = [], []
    for text, spans in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        _, start, end = shingles.words(data, np.array([0, len(data)]))
        gold = np.zeros(len(start), np.int64)
        for a, b, kind in spans:
            inside = np.flatnonzero((start < b) & (end > a))
            gold[inside] = 2 + 2 * KINDS.index(kind)
            gold[inside[:1]] -= 1
        codes.append(shapes(data, start))
        golds.append(gold)
    width = max(map(len, codes), default=1)
    pad = lambda xs: np.array([np.pad(x, (0, width - len(x))) for x in xs])
    return pad(codes), pad(golds), pad([np.ones(len(c), np.int64) for c in codes]).astype(bool)


def train(labelled: Sequence[str] = LABELLED, rounds: int = 300, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Fits the field by gradient ascent on the conditional likelihood (forward-backward), on the driver: the labelled
    table is small by contract. Deterministic. An empty table gives a field that marks nothing."""
    fixed = _allowed()
    widths = [n for _, n in reversed(PARTS)]
    weights = [[np.zeros((n, LABELS)) for n in widths] + [np.zeros((SHAPES, LABELS))] for _ in range(3)]
    steps = np.zeros((LABELS, LABELS))
    everything = _parts_of(np.arange(SHAPES)) + [np.arange(SHAPES)]
    table = lambda w: sum(x[p] for x, p in zip(w, everything))
    if not len(labelled):
        quiet = np.zeros((SHAPES, LABELS))
        quiet[:, 0] = 1.0
        return Field(quiet, np.zeros((SHAPES, LABELS)), np.zeros((SHAPES, LABELS)), fixed)
    code, gold, there = _encoded(parse_labelled(labelled))
    n, width = code.shape
    one = np.eye(LABELS)[gold] * there[:, :, None]
    squares = [[np.full_like(x, 1e-6) for x in w] for w in weights] + [np.full_like(steps, 1e-6)]
    start_ok = np.where(fixed[0] > IMPOSSIBLE / 2, 0.0, IMPOSSIBLE)
    for _ in range(rounds):
        tables = [table(w) for w in weights]
        emit = tables[0][code]
        emit[:, 1:] += tables[1][code[:, :-1]] * there[:, 1:, None]
        emit[:, :-1] += tables[2][code[:, 1:]] * there[:, 1:, None]
        move = steps + fixed
        front, back = np.zeros((n, width, LABELS)), np.zeros((n, width, LABELS))
        front[:, 0] = emit[:, 0] + start_ok
        for t in range(1, width):
            go = np.logaddexp.reduce(front[:, t - 1, :, None] + move, axis=1) + emit[:, t]
            front[:, t] = np.where(there[:, t, None], go, front[:, t - 1])
        total = np.logaddexp.reduce(front[:, -1], axis=1)
        pair = np.zeros((LABELS, LABELS))
        for t in range(width - 2, -1, -1):
            come = np.logaddexp.reduce(move + (emit[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(there[:, t + 1, None], come, 0.0)
            joint = front[:, t, :, None] + move + (emit[:, t + 1] + back[:, t + 1])[:, None, :] - total[:, None, None]
            pair += (np.exp(joint) * there[:, t + 1, None, None]).sum(axis=0)
            gold_pair = (gold[:, t][there[:, t + 1]], gold[:, t + 1][there[:, t + 1]])
            np.subtract.at(pair, gold_pair, 1.0)
        chance = np.exp(front + back - total[:, None, None]) * there[:, :, None]
        rest = one - chance
        shifted = (rest, rest[:, 1:], rest[:, :-1])
        codes = (code, code[:, :-1], code[:, 1:])
        masks = (there, there[:, 1:], there[:, 1:])
        for k in range(3):
            flat, slope = codes[k][masks[k]], shifted[k][masks[k]]
            for j, part in enumerate(everything):
                grad = np.zeros_like(weights[k][j])
                np.add.at(grad, part[flat], slope)
                grad -= decay * weights[k][j]
                squares[k][j] += grad ** 2
                weights[k][j] += rate * grad / np.sqrt(squares[k][j])
        grad = np.where(fixed < 0, 0.0, -pair) - decay * steps
        squares[3] += grad ** 2
        steps += rate * grad / np.sqrt(squares[3])
    return Field(table(weights[0]), table(weights[1]), table(weights[2]), steps + fixed)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: its left run of allowed characters, then the right side."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in EMAIL_LEFT:
            start -= 1
        m = EMAIL_RIGHT.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if len(m[0]) < 40 else ""
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _added(data: np.ndarray, start: np.ndarray, end: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(token, kind's number, first byte, end byte) of the marked runs, without the punctuation around them."""
    for i in np.flatnonzero(labels % 2 == 1):
        kind, j = (int(labels[i]) - 1) // 2, i
        while j + 1 < len(labels) and labels[j + 1] == labels[i] + 1:
            j += 1
        a, b = int(start[i]), int(end[j])
        raw = data[a:b].tobytes()
        a += len(raw) - len(raw.lstrip(b"\"'<[" if kind == 3 else b"\"'<[("))
        b -= len(raw) - len(raw.rstrip(b".,;:!?\"'>])"))
        if a < b:
            yield int(i), kind, a, b


def _batch(column: pa.Array, field: Field) -> Iterator[tuple[list, list]]:
    """(base spans, added spans) of every row, in code points."""
    for first, data, offsets in shingles.slices(column):
        row, start, end = shingles.words(data, offsets)
        code = shapes(data, start)
        added: dict[int, list] = {}
        for token, kind, a, b in _added(data, start, end, _guard(field.decode(code, row), row)):
            added.setdefault(int(row[token]), []).append((a, kind, b))
        digit_or_at = np.zeros(len(data) + 1, np.int64)
        np.cumsum((_IS["digits"] | _IS["at"])[data], out=digit_or_at[1:])
        worth = digit_or_at[offsets[1:]] > digit_or_at[offsets[:-1]]
        for i in range(len(offsets) - 1):
            base, extra = [], []
            if worth[i] or i in added:
                raw = data[offsets[i]:offsets[i + 1]].tobytes()
                base = base_spans(raw.decode())
                for a, kind, b in added.get(i, ()):
                    lead = len(raw[:a - offsets[i]].decode())
                    spot = (lead, kind, lead + len(raw[a - offsets[i]:b - offsets[i]].decode()))
                    if _plausible(kind, raw[a - offsets[i]:b - offsets[i]]) and all(spot[2] <= x or z <= spot[0] for x, _, z in base):
                        extra.append(spot)
            yield base, extra


def _plausible(kind: int, raw: bytes) -> bool:
    """An added card must pass Luhn too, an address stay below 256; shapes alone can't know that."""
    groups = re.findall(rb"[0-9]+", raw)
    digits = b"".join(groups).decode()
    if KINDS[kind] == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    if KINDS[kind] == "ip":
        return len(groups) == 4 and all(len(g.lstrip(b"0")) <= 3 and int(g.lstrip(b"0") or 0) <= 255 for g in groups)
    return KINDS[kind] != "phone" or 7 <= len(digits) <= 15


def _guard(labels: np.ndarray, row: np.ndarray) -> np.ndarray:
    """An inside at the start of a row never continues the row before."""
    head = np.ones(len(row), bool)
    head[1:] = row[1:] != row[:-1]
    return np.where(head & (labels > 0) & (labels % 2 == 0), 0, labels)


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(df: DataFrame, field: Field | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of personal data in every whole text of `df`.

    Returns key, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (digest of the base spans' list), spans (base
    and added spans as kind:start:end, by start, then kind; code points). A span that the field adds never overlaps a
    base span. A null text counts as ''; null keys and repeated rows come back as they are; an empty table gives no
    rows; other columns are left out. Long texts are decoded whole, as one chain.
    """
    model = field or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, told = [], [], []
            for base, extra in _batch(batch.column(1), model):
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))])
                digests.append(hashlib.sha256(_told(base).encode()).hexdigest())
                told.append(_told(base + extra))
            numbers = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(numbers[:, i]) for i in range(len(KINDS))), pa.array(digests, pa.string()),
                 pa.array(told, pa.string())], [batch.schema.names[0], *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
