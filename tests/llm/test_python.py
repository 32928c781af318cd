"""Operators with numpy inside their tasks: personal data, leaks, fingerprints, pieces, n-gram join, toxicity."""

import hashlib
import re
import tempfile

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tableprep.llm import decontam, fingerprints, ngram_join, pieces, pii_crf, queries, shingles, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def field():
    return pii_crf.train()


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(queries.PIECES)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def slow_base(text):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                           r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (12 <= len(digits) <= 19 and sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_the_plain_patterns():
    rng = np.random.default_rng(3)
    letters = list("0123456789..@@+- (a-Z%_\né")
    for _ in range(4000):
        text = "".join(rng.choice(letters, rng.integers(0, 40)))
        assert pii_crf.base_spans(text) == slow_base(text)
    assert pii_crf.base_spans("1" * 200_000 + "a" * 200_000 + "+" * 100_000) == []


def test_viterbi_with_cuts_is_plain_viterbi(field):
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        row, code = np.sort(rng.integers(0, 3, n)), np.where(rng.random(n) < 0.5, rng.integers(0, pii_crf.SHAPES, n), 1)
        scores, want = field.scores(code, row), np.zeros(n, int)
        for r in np.unique(row):
            spot = np.flatnonzero(row == r)
            best, path = scores[spot[0]] + np.where(field.steps[0] > pii_crf.IMPOSSIBLE / 2, 0, pii_crf.IMPOSSIBLE), []
            for i in spot[1:]:
                total = best[:, None] + field.steps
                path.append(total.argmax(axis=0))
                best = total.max(axis=0) + scores[i]
            labels = [int(best.argmax())]
            for step in path[::-1]:
                labels.append(int(step[labels[-1]]))
            want[spot] = labels[::-1]
        assert (field.decode(code, row) == want).all()


def test_field_finds_held_out_spans():
    kept = [r for i, r in enumerate(pii_crf.LABELLED) if i % 5]
    field, good, rows = pii_crf.train(kept), 0, pii_crf.parse_labelled(pii_crf.LABELLED[::5])
    for text, spans in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        row, start, end = shingles.words(data, np.array([0, len(data)]))
        labels = field.decode(pii_crf.shapes(data, start), row)
        found = [(a, b, pii_crf.KINDS[k]) for _, k, a, b in pii_crf._added(data, start, end, labels)]
        good += found == spans
    assert good >= 0.8 * len(rows)


def test_personal_data(spark, field):
    rows = [(1, None), (2, ""), (3, "é +1 (626) 555-5759, a.b@c.de and 10.0.0.1; 4111 1111 1111 1111"), (3, "dial (212) 555-0143 now"),
            (None, "x@y.zz"), (4, "word " * 60_000 + "me@host.org"), (5, "mail joe[at]mail.example.com soon")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_email long")
    got = pii_crf.find(df, field).collect()
    assert len(got) == len(rows)
    for (d, t), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r["doc_id"], next(t for d, t in rows if d == r["doc_id"]))))):
        assert r["doc_id"] == d
    by = {(r["doc_id"], r["n_phone"]): r for r in got}
    base = slow_base(rows[2][1])
    told = ",".join(f"{pii_crf.KINDS[k]}:{a}:{b}" for a, k, b in base)
    assert by[3, 1]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest() and by[3, 1]["spans"] == told
    assert by[3, 0]["spans"] == "phone:5:19" and by[5, 0]["spans"] == "email:5:28"
    assert by[1, 0]["spans"] == "" and by[4, 0]["n_email"] == 1 and by[None, 0]["n_email"] == 1
    assert pii_crf.find(df.limit(0), field).count() == 0
    assert pii_crf.train(()).decode(np.array([1, 5]), np.array([0, 0])).sum() == 0


def items_of(rows):
    return [(i, t[:len(t) // 2], t[len(t) // 2:]) for i, t in rows]


def test_leaks_are_all_found(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in queries.op3_benchmark_passages(spark, SF).collect()}
    assert got == plain.leaks(rows, bench) and got


def test_block_max_retrieval_is_exhaustive_bm25():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, rng.integers(1, 40)) % 90) for _ in range(120)]
    index = decontam.build(pa.table({"id": range(120), "question": texts, "answer": [""] * 120}))
    window = np.repeat(np.arange(60), 25)
    pair = np.unique(window * len(index.terms) + rng.integers(0, len(index.terms), len(window)))
    window, term = pair // len(index.terms), pair % len(index.terms)
    dense = np.zeros((len(index.terms), 120))
    owner = np.repeat(np.arange(len(index.terms)), index.start[index.first[1:]] - index.start[index.first[:-1]])
    dense[owner, index.item] = index.score
    want = {(w, i) for w in range(60) for i, s in enumerate(dense[term[window == w]].sum(axis=0)) if s >= index.threshold[i] * (1 - 1e-9)}
    w, i, _ = decontam.retrieve(index, window, term)
    assert set(zip(w.tolist(), i.tolist())) == want and want


def test_leaks_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa. The answer is lambda mu nu xi omicron pi."
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, item, 0), (3, item, 0), (None, f"x {item.upper()} y", 0), (4, item[:60], 0),
                                  (5, "word " * 50_000 + item, 0)], "doc_id long, text string, score int")
    items = spark.createDataFrame([(7, item[:58], item[58:]), (8, None, None), (9, item[:58], item[58:]), (10, "", "...")],
                                  "item_id long, question string, answer string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontam.hits(docs, items).collect()), key=str)
    assert got == sorted([(d, i) for d in (3, 3, None, 5) for i in (7, 9)], key=str)
    kept = decontam.keep_clean(docs, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4] and kept.columns == docs.columns
    assert decontam.hits(docs.limit(0), items).count() == 0 and decontam.hits(docs, items.limit(0)).count() == 0
    assert decontam.keep_clean(docs, items.limit(0)).count() == 7
    q, a = decontam.last_sentence(F.col("t"))
    parts = spark.createDataFrame([("One two. Three four?",), ("only one.",), ("",)], "t string").select(q, a).collect()
    assert [tuple(r) for r in parts] == [("One two. ", "Three four?"), ("only one.", ""), ("", "")]


def test_near_copies_of_items_without_an_answer_are_found(spark):
    words = [f"word{k}" for k in range(40)]
    question = " ".join(words) + "."
    bench = spark.createDataFrame([(1, f"{question} It is blue today."), (2, f"Second {question} Yes.")], "item_id long, text string")
    path = tempfile.mkdtemp(prefix="bench-")
    bench.write.parquet(f"{path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"some text {question} It is red today. and more"), (2, f"a {question} b"),
                                  (3, f"x Second {question} y"), (4, " ".join(words[:20]))], "doc_id long, text string")
    items = queries.benchmark_items(spark, path)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.hits(docs, items).collect()}
    assert {(1, 1), (2, 1), (3, 2)} <= got and not any(d == 4 for d, _ in got)
    assert [r["doc_id"] for r in decontam.keep_clean(docs, items).collect()] == [4]
    assert not decontam.hits(docs.where("doc_id = 1"), items.where("item_id = 1").drop("whole")).count()


def test_prefix_hashes():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x, y = ("".join(rng.choice(list("ab"), rng.integers(0, 60))) for _ in range(2))
        a, b = fingerprints.PrefixHash(x), fingerprints.PrefixHash(y)
        i, j = int(rng.integers(0, len(x) + 1)), int(rng.integers(0, len(y) + 1))
        n = int(rng.integers(0, min(len(x) - i, len(y) - j) + 1))
        assert a.same(i, b, j, n) == (x[i:i + n] == y[j:j + n])
        k = 0
        while i + k < len(x) and j + k < len(y) and x[i + k] == y[j + k]:
            k += 1
        assert a.extension(i, b, j) == k
        k = 0
        while i - k > 0 and j - k > 0 and x[i - k - 1] == y[j - k - 1]:
            k += 1
        assert a.extension(i, b, j, backwards=True) == k


def test_fingerprints(spark):
    rows = [(i * 10, "é日" * i + "z" * (i % 3)) for i in range(40)] + [(400, None), (410, "same text here, long enough"), (420, "same text here, long enough"),
                                                                    (1 << 60, "big" * 40_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(None, "abcd", 1)], "doc_id long, text string, block int")
    for per_block in (1_000, 7, 1):
        got = {r["doc_id"]: r for r in fingerprints.fingerprint_table(df, rows_per_block=per_block).collect()}
        assert len(got) == len(rows) + 1 and got[None]["edited_sha256"] == hashlib.sha256(b"ab").hexdigest()
        order = sorted(rows, reverse=True)
        for (d, t), (_, u) in zip(order, order[1:] + order[:1]):
            t, u = t or "", u or ""
            changed = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
            assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
            assert got[d]["fingerprint"] == fingerprints.PrefixHash(t).fingerprint()
            assert got[d]["edited_fingerprint"] == fingerprints.PrefixHash(changed).fingerprint()
            assert 0 <= got[d]["near_edited"] <= 1 and (got[d]["near_next"] == 1) == (t == u)
        assert got[410]["fingerprint"] == got[420]["fingerprint"] and got[1 << 60]["near_edited"] > 0.4
    again = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "cc")], "doc_id long, text string")
    assert fingerprints.fingerprint_table(again, rows_per_block=1).count() == 4
    assert fingerprints.fingerprint_table(df.limit(0)).count() == 0
    alone = fingerprints.fingerprint_table(again.where("doc_id = 2")).first()
    assert alone["near_next"] == 1 and alone["edited_sha256"] == hashlib.sha256(b"cc").hexdigest()


def test_pieces_are_the_library_s(spark, vocabulary):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    rng, letters = np.random.default_rng(4), list("abcdefghijklmnopqrst  \n.,éñßü日本語▁😀\t0123THE\x00")
    texts = ["", " ", "  Hello   world ", "▁a b", " " * 45 + "x   日", "x" * 3000, "word " * 20_000]
    texts += ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(600)] + [r["text"] for r in documents(spark).collect()]
    encoder = pieces.Encoder(vocabulary)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == library.encode(text)
        assert pieces.decode(vocabulary, ids) == text.replace("▁", " ")


def test_piece_table(spark, vocabulary):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "the house", 0), (3, "a  b", 0), (3, "a  b", 0)], "doc_id long, text string, pieces int")
    got = pieces.encode_table(df, vocabulary).collect()
    assert len(got) == 5 and all(r["decoded_equal"] and r["n_pieces"] == len(r["pieces"]) for r in got)
    assert sorted(r["n_pieces"] for r in got)[:2] == [0, 0]
    assert pieces.encode_table(df.limit(0), vocabulary).count() == 0


def test_classes(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    rows += [(5000 + k, " ".join(base[:k * 2] + [f"x{k}"] + base[k * 2 + 1:])) for k in range(30)]
    rows += [(-5, " ".join(base)), (6000, None), (6001, " \t\n"), (6002, "three little words"), (6003, "Three  LITTLE words"), (6004, "É a"),
             (6005, "é a"), (6006, "one"), (6007, "long " * 3), (6008, " ".join(f"v{i}" for i in range(60_000)))]
    df = spark.createDataFrame([(d, t, 1, 2, "k") for d, t in rows], "doc_id long, text string, a int, size int, component_id string")
    got = ngram_join.classes(df)
    assert sorted(map(tuple, got.collect())) == plain.classes(rows)
    clash = ngram_join.keep_one(df.withColumn("_gone", F.lit(1)))
    assert clash.columns == [*df.columns, "_gone"] and clash.count() == len({c for _, _, c in plain.classes(rows)})
    kept = ngram_join.keep_one(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, c in plain.classes(rows) if d == c) and kept.columns == df.columns
    more = df.unionByName(df.where("doc_id < 0")).unionByName(df.where("doc_id = 6002").withColumn("doc_id", F.lit(None).cast("long")))
    again = ngram_join.classes(more).collect()
    assert len(again) == len(rows) + 2 and [r["component_id"] for r in again if r["doc_id"] is None] == [None]
    assert ngram_join.classes(df.limit(0)).count() == 0


def alone(links):
    """The links function without what shared minima find, so that tiles have to find every link."""
    calls = []

    def run(pairs, *rest):
        calls.append(1)
        return links(pairs.limit(0) if len(calls) % 2 else pairs, *rest)
    return run


def test_tiles_find_every_linked_pair(monkeypatch, spark):
    base = [f"w{i}" for i in range(120)]
    rng = np.random.default_rng(8)
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).limit(80).collect()]
    for k in range(60):  # many texts around the threshold of similarity, of sizes on both sides of a power of two
        words = list(base[:int(rng.integers(60, 120))])
        for i in rng.integers(0, len(words), int(rng.integers(0, 4))):
            words[i] = f"x{k}"
        rows.append((10_000 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain.classes(rows)
    for small, block in ((12, 2_000), (1, 2_000), (1, 5)):
        monkeypatch.setattr(ngram_join, "SMALL_TILE", small)
        monkeypatch.setattr(ngram_join, "TILE_ROWS", block)
        monkeypatch.setattr(ngram_join, "_links", alone(ngram_join._links) if small == 1 else ngram_join._links)
        assert sorted(map(tuple, ngram_join.classes(df).collect())) == want


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(6)
    for _ in range(300):
        pool = rng.integers(0, 2**64, 300, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 250))) for _ in range(2))
        differ = ngram_join._differ(ngram_join._bitmap(a, len(a)), ngram_join._bitmap(b, len(b)))
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) / 2


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9 and held.score[held.toxic == 1].mean() > held.score[held.toxic == 0].mean() + 0.3
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same = toxicity.train(docs, flipped.withColumn("score", F.lit(1)))
    # sums over shuffled rows may differ in their last bits from run to run
    assert (same.features == model.features).all() and np.allclose(same.weights, model.weights, rtol=0, atol=1e-9)
    odd = spark.createDataFrame([(1, None, 0.1), (1, "", 0.1), (None, "you idiot " * 30_000, 0.1)], "doc_id long, text string, score double")
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 3 and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.keep_clean(odd, model).columns == odd.columns and toxicity.keep_clean(odd.where("doc_id = 1"), model).count() == 2
    assert toxicity.score(odd.limit(0), model).count() == 0
    blank = toxicity.train(docs.limit(0), labels.limit(0))
    assert toxicity.score(odd, blank).count() == 3
    assert toxicity.score(odd, toxicity.train(odd, labels.withColumn("toxic", F.lit(None).cast("int")))).count() == 3
