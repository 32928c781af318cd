"""Plain versions of the operators, for comparison on small tables."""

import collections
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def similar(sets, share):
    """All pairs (i, j), j < i, with |A n B| / |A u B| >= share."""
    spots = collections.defaultdict(list)
    for i, one in enumerate(sets):
        for j, k in collections.Counter(j for g in one for j in spots[g]).items():
            if k >= share * (len(one) + len(sets[j]) - k):
                yield i, j
        for g in one:
            spots[g].append(i)


def word_sets(texts):
    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    return out


def classes(rows):
    rows = sorted(rows)
    sets, joined = word_sets(t for _, t in rows), Sets()
    for i, j in similar(sets, 0.8):
        joined.join(rows[i][0], rows[j][0])
    return sorted((d, len(s), joined.find(d)) for (d, _), s in zip(rows, sets))


def dedup_lines(rows, shingle=5):
    spots = sorted((d, p, x) for d, t in rows for p, x in enumerate((t or "").split("\n")) if x.strip(" "))
    lines = sorted({x for _, _, x in spots})
    number, joined, first = {x: i for i, x in enumerate(lines)}, Sets(), {}
    sets = [{x[i:i + shingle] for i in range(len(x) - shingle + 1)} if len(x) >= shingle else {x} for x in lines]
    for i, j in similar(sets, 0.8):
        joined.join(i, j)
    for d, p, x in spots:
        first.setdefault(joined.find(number[x]), (d, p))
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n"))
                                               if not x.strip(" ") or first[joined.find(number[x])] == (d, p)) for d, t in rows}


def plain_words(text):
    return " ".join(re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate(LOWER)))


def leaks(rows, items):
    items = {i: f" {plain_words(t)} " for i, t in items}
    return {(d, i) for d, t in rows for i, x in items.items() if x.strip() and x in f" {plain_words(t)} "}


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def spelling(rows):
    """{word: (form, root, n, n_near, form_n)} by comparing each word with all words it could be near to."""
    n = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    return variants(n)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(n):
    found = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        found[w] = (best if best is not None and n[best] >= 2 * n[w] else None, len(others))
    out = {}
    for w, (form, many) in found.items():
        root = w
        while found[root][0] is not None:
            root = found[root][0]
        out[w] = (form, root, n[w], many, n.get(form))
    return out
