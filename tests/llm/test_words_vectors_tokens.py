"""Spelling variants, whitening and token counts against plain versions and the library."""

import math
import random
from fractions import Fraction

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from tableprep.llm import queries, spelling, token_counts, whitening

ODD = "doc_id long, text string, word string, n long, whole boolean, n_tokens int, component string"


def spelled(df):
    return {r["word"]: tuple(r)[1:] for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_variants_of_texts(spark):
    rng = random.Random(5)
    base = ["straße", "colour", "wörter", "aabbaa", "hello", "aaaaa", "ÿÀabc", "Éclair", "abcde"]
    texts = []
    for d in range(300):
        words = []
        for _ in range(30):
            w = rng.choice(base)
            if rng.random() < 0.4:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + "a" + w[i:], w[:i] + "é" + w[i + 1:], w[:i] + w[i] + w[i:]])
            words.append(w if rng.random() < 0.8 else w.upper())
        texts.append((d, rng.choice([" ", "-", "\n", "1"]).join(words)))
    texts += [(None, "hello hello hello"), (7, None), (8, ""), (9, "a $ b 1 中"), texts[0], texts[0]]
    want = plain.spelling(texts)
    rows = [(d, t, "x", 1, True, 1, "y") for d, t in texts]
    got = spelled(spelling.spelling_table(spark.createDataFrame(rows, ODD)))
    assert len(got) > 100 and got == want
    assert spelled(spelling.spelling_table(spark.createDataFrame([], ODD))) == {}
    assert spelled(spelling.spelling_table(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string"))) == {}


def test_counting_hands_on_and_runs_lose_letters(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    rows = [(d, f"slipping words {'letter' * 3000} number" + chr(97 + d % 26) * 5) for d in range(400)]
    assert spelled(spelling.spelling_table(spark.createDataFrame(rows, "doc_id long, text string"))) == plain.spelling(rows)


def test_chains_ties_and_hot_words(spark):
    chain = {"a" * (5 + i): 3 * 2 ** i for i in range(12)}  # each word's form is the next one
    ties = {"bcdef": 3, "bcdeg": 9, "bcdeh": 9, "bcdei": 5, "bbcdef": 9}
    hub = {"hubhub": 10 ** 6} | {"hubhub"[:i] + c + "hubhub"[i:]: 4 for i in range(7) for c in "abcdefghijklm"}
    n = chain | ties | hub
    words = spark.createDataFrame([*n.items(), (None, 5)], "word string, n long")
    got = spelled(spelling.variants(words))
    assert got == plain.variants(n)
    assert got["aaaaa"][1] == "a" * 16 and got["bcdef"][0] == "bbcdef" and got["bcdei"][0] is None


def test_groups_of_rotations_are_short(spark):
    n = {a + "mile" + b: 3 for a in "abcdefghijklmnopqrstuvwxyzàé" for b in "abcdefghijklmnopqrstuvwxyzàé"}
    rotated = spelling.rotations(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert rotated.groupBy("prefix").count().agg(F.max("count")).first()[0] <= 28 + 1


def vectors(spark, rows, schema="vec_id long, embedding array<float>, n int, component string"):
    return spark.createDataFrame(rows, schema)


def exact(rows, k=32):
    """(n, deviations, covariance, sums) in fractions."""
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in rows]
    n, dims = len(x), len(x[0])
    s = [sum(v[j] for v in x) for j in range(dims)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(v, s)) for v in x]
    cov = [[sum((Fraction(v[a]) - Fraction(s[a], n)) * (Fraction(v[b]) - Fraction(s[b], n)) for v in x) / n for b in range(dims)] for a in range(dims)]
    return x, n, s, dev, cov


def test_whitening_matches_fractions(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) * 3 + 900
    good = [[float(np.float32(c)) for c in v] for v in base] + [[float(np.float32(c)) for c in base[0]]] * 2
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [1.0, 2.0, float("inf"), 0.0, 0.0], [1.0, 2.0, 3.0]]
    rows = [(i, v, 0, "c") for i, v in enumerate(good)] + [(1000 + i, v, 0, "c") for i, v in enumerate(bad)]
    random.Random(1).shuffle(rows)
    out = whitening.whiten_table(vectors(spark, rows)).toPandas()
    x, n, s, dev, cov = exact(good)
    assert len(out) == 62 * 5 and set(out.n) == {62} and set(out.vec_id) == set(range(62))
    assert out[out.component == 1].set_index("vec_id").deviation.loc[list(range(62))].tolist() == dev
    v = np.array([[float(c) for c in row] for row in cov])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    centred = np.array([[float(Fraction(a) - Fraction(b, n)) for a, b in zip(row, s)] for row in x])
    want = centred @ axes / np.sqrt(values)
    got = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign((got * want).sum(axis=0))
    np.testing.assert_allclose(got * signs, want, atol=1e-8)
    np.testing.assert_allclose(out[out.vec_id == 0].sort_values("component").explained, values / np.trace(v), rtol=1e-9)
    assert set(out.identity_error.map(lambda e: e < 1e-9)) == {True} and out.identity_error.nunique() == 1


def test_covariance_is_exact_far_from_zero(spark):
    big = 2.0 ** 36
    good = [[big + i, big - i * i, 3.0 * (i % 7)] for i in range(50)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(good)], "vec_id long, embedding array<double>")
    found = whitening.fit(df)
    x = [[math.floor(64 * c) + 1000000 for c in v] for v in good]
    s = [sum(c) for c in zip(*x)]
    assert found.sums == s and found.n == 50
    v = np.cov(np.array([[float(Fraction(a) - Fraction(b, 50)) for a, b in zip(row, s)] for row in x]).T, bias=True)
    np.testing.assert_allclose(found.values, np.linalg.eigvalsh(v)[::-1], rtol=1e-9)
    dev = whitening.whiten_table(df).where("component = 1").orderBy("vec_id").select("deviation").toPandas().deviation.tolist()
    assert dev == [sum((50 * a - b) ** 2 for a, b in zip(row, s)) for row in x]


def test_whitening_corner_cases(spark):
    assert whitening.whiten_table(vectors(spark, [])).collect() == []
    assert whitening.whiten_table(vectors(spark, [(1, None, 0, "c"), (2, [], 0, "c")])).collect() == []
    equal = whitening.whiten_table(vectors(spark, [(None, [1.0, 2.0], 0, "c")] * 3)).collect()
    assert len(equal) == 6 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] is None for r in equal)
    flat = whitening.whiten_table(vectors(spark, [(i, [float(i), 2.0 * i, 7.0], 0, "c") for i in range(9)])).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True), (3, True)}
    assert max(r["identity_error"] for r in flat) < 1e-9
    huge = whitening.whiten_table(spark.createDataFrame([(i, [1e300 * (i - 1), float(i)]) for i in range(3)], "vec_id int, embedding array<double>")).collect()
    assert len(huge) == 6 and None in {r["deviation"] for r in huge}


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


@pytest.fixture(scope="module")
def ranks():
    return token_counts.load(queries.PIECES)


def test_tokens_match_the_library(spark, library, ranks):
    rng = random.Random(2)
    parts = ["a", "b", "e", "=", "-", "▁", " ", "  ", "\n", "é", "ß", "中", "国", "😀", "\0", "the", "ing", "in", "er", "oked", "quality",
             "</s>", "<0x41>", "<unk>", "ов", " " * 33, "\t", "A", "0", "́", "Ü"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(100, 600))) for _ in range(200)]
    texts += [None, "", " ", "  ", "word " * 4096, "word " * 4095, "a" * 3000, "=" * 3001, " " * 777, " " * 778 + "a", "的" * 999, "qualityoked" * 300]
    rows = [(i if i % 50 else None, t, "w", 1, True, 3, "c") for i, t in enumerate(texts)]
    out = token_counts.count_table(spark.createDataFrame(rows, ODD), ranks)
    assert out.schema.names == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted(((d is None, d or 0, len((t or "").encode()), len(library.encode(t or ""))) for d, t, *_ in rows))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in out.collect())
    assert got == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in out.collect())
    assert token_counts.count_table(spark.createDataFrame([], ODD), ranks).collect() == []


def test_pieces_that_merge_at_once_hold_others_back():
    """A piece of lower rank may come to be in the middle of a run: merging one by one is what counts."""
    text = {"a": 0, "b": 1, "aa": 2, "aab": 3, "aaa": 4}
    size, rank = 5, {"aaa": 0, "aa": 1, "aab": 2}
    pairs = sorted((text[p[:k]] * size + text[p[k:]], r, text[p]) for p, r in rank.items() for k in range(1, len(p)) if p[:k] in text and p[k:] in text)
    columns = np.array(pairs).T
    chars = np.array([ord("a"), ord("b")])
    grams = np.array(sorted({ord(x) << 32 | ord(y) for x, y in ("aa", "ab")}))
    made = token_counts.Ranks(chars, np.array([0, 1]), size, *columns, np.array([False, True, False]), grams, 3, -2, [], 1)

    def plainly(word):
        parts = list(word)
        while True:
            found = [(rank[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in rank]
            if not found:
                return len(parts)
            _, i = min(found)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(4)
    words = ["".join(rng.choice("aaaab") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    assert token_counts.count_tokens(made, words)[0].tolist() == [plainly(w) for w in words]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(queries.PIECES, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        token_counts.load(str(tmp_path / "m.model"))
