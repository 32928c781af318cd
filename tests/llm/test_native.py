"""Operators made of DataFrame functions: URL reputation, shards, line dedup, chat examples."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tableprep.llm import chat, common, graph, line_dedup, sharding, url_reputation
import plain

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme/x", "http://A.Example.NET/en/x?q#f", "https://example.net", "x://b.org/fr/", "x://b.org/FR/",
            "http://EXAMPLE.com/de/?a", "http://notexample.com/de/", "http://org?x/fr/", "http://É.net/", "http://h.net#/en/"]
    pages = spark.createDataFrame([(i, u, "clash", 0.5) for i, u in enumerate(urls)], "page_id long, url string, host string, bound double")
    got = {r["page_id"]: r for r in url_reputation.judge(pages, spark.createDataFrame([], "host string, good int"), RULES).collect()}
    assert [got[i]["host"] for i in range(12)] == ["", "", "", "a.example.net", "example.net", "b.org", "b.org", "example.com",
                                                   "notexample.com", "org", "É.net", "h.net"]
    assert [got[i]["path"] for i in (3, 4, 5, 7, 9, 11)] == ["/en/x", "", "/fr/", "/de/", "", ""]
    assert [got[i]["rule"] for i in range(12)] == [None, None, None, "example.net/en/", None, "org/fr/", None, "example.com/de/", None,
                                                   None, "net/", None]
    assert got[3]["verdict"] == "allow" and got[10]["verdict"] == "block" and got[0]["verdict"] == "block"


def test_reputation_shrinks(spark):
    outcomes = [("good.a.com", 1)] * 40 + [("good.a.com", 0)] + [("bad.a.com", 0)] * 30 + [("b.org", 1)] * 2 + [(None, 1), ("x.com", None)]
    seen = ["good.a.com", "bad.a.com", "new.a.com", "new.com", "b.org", "z.museum", "a.com:80", ""]
    got = {r["host"]: r for r in url_reputation.reputation(
        spark.createDataFrame(outcomes, "host string, good int"), spark.createDataFrame([(h,) for h in seen * 2], "host string")).collect()}
    assert len(got) == 8 and got["good.a.com"]["n"] == 41
    assert got["bad.a.com"]["mean"] < got["new.a.com"]["mean"] < got["good.a.com"]["mean"]
    assert got["b.org"]["mean"] < 1 and got["b.org"]["bound"] < got["good.a.com"]["bound"]
    assert all(0 <= r["bound"] <= r["mean"] <= 1 for r in got.values())


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_reputation.judge(none, spark.createDataFrame([], "host string, good int")).count() == 0


@pytest.mark.parametrize("shards", [1, 2, 16, 700])
def test_jump_is_the_plain_walk(spark, shards):
    df = spark.range(300).select(F.col("id").cast("string").alias("k"))
    got = df.select("k", sharding.jump_shard(*sharding.key_halves(F.col("k")), shards).alias("s")).collect()
    assert [r["s"] for r in got] == [plain.jump(int(hashlib.md5(r["k"].encode()).hexdigest()[:16], 16), shards) for r in got]


def test_shards(spark):
    rows = [(i, None if i % 7 == 0 else "é" * (i % 50), i, i) for i in range(3000)] + [(None, "a", 1, 1), (None, None, 1, 1)] + [(5, "x", 0, 0)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, size long, shard int")
    got = sharding.shard_table(df, "doc_id", "text", 16, rows_per_block=40).collect()
    assert len(got) == len(rows)
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(slots) == 16 and max(map(len, slots.values())) < 320
    assert len({(r["doc_id"], r["shard"]) for r in got}) == len({r["doc_id"] for r in got})
    assert sharding.shard_table(df.limit(0), "doc_id", "text", 16).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(2000, 2100)] + [(7, 7), (None, 3), (5000, 5000), (300, 301), (301, 300)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(2000, 2100)} == {1000} and got[5000] == 5000 and got[301] == 300
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


LINE = "The quick brown fox jumps over the lazy dog while the band plays on and on until late at night in the old town square."


def test_lines(spark):
    near, far = LINE[:-1] + "!", LINE[:40] + " something wholly different follows here, and more of it comes after."
    rows = [(3, f"{LINE}\nshort\n\n  \n{LINE}"), (1, f"first\n{near}\nshort"), (2, None), (4, ""), (5, far), (6, "\n\n"), (7, "x" * 70000 + "\n" + far),
            (8, "y" * 70000), (9, "x" * 70000), (10, "ab"), (11, "ab\r\nab"), (-4, "below zero comes first of all the lines"),
            (12, "below zero comes first of all the lines"), (13, "Ünïcode 日本語 line with quite some letters in it, twice over"),
            (14, "Ünïcode 日本語 line with quite some letters in it, twice over!")]
    rows += [(100 + i, f"{LINE} {chr(97 + i)}") for i in range(20)]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows] + [(None, LINE, 1, "k")], "doc_id long, text string, pos int, key string")
    out = line_dedup.dedup(df)
    assert out.columns == ["doc_id", "text", "pos", "key", "n_lines_removed"]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got.pop(None) == LINE
    assert got == plain.dedup_lines(rows)
    assert got[1] == f"first\n{near}\nshort" and got[3] == "\n  " and got[12] == "" and got[10] == "ab" and got[11] == "ab\r"
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_lines_of_all_lengths_with_one_changed_character(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdefghij klmnopqrst") for _ in range(n)) for n in range(50, 121, 5) for _ in range(8)]
    rows = [(i, x) for i, x in enumerate(lines)] + [(1000 + i, x[:len(x) // 2] + "#" + x[len(x) // 2 + 1:]) for i, x in enumerate(lines)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain.dedup_lines(rows, 5) and all(got[i] == x and got[1000 + i] == "" for i, x in enumerate(lines))


def test_linked_lines_share_a_band_and_pass_the_bitmaps(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz 0123456789"
    lines, pairs = [], []
    while len(pairs) < 6000:
        one = "".join(rng.choice(letters) for _ in range(rng.choice((60, 120, 240))))
        other = list(one)
        for _ in range(len(one) // 45):
            other[rng.randrange(len(one))] = "#"
        other = "".join(other)
        x, y = ({z[i:i + 5] for i in range(len(z) - 4)} for z in (one, other))
        if 0.8 <= len(x & y) / len(x | y) < 0.84:
            pairs.append((2 * len(pairs), 2 * len(pairs) + 1))
            lines += [one, other]
    distinct = spark.createDataFrame([(x, i, 1) for i, x in enumerate(lines)], "line string, first long, n long")
    signed = line_dedup._signed(distinct).select(F.col("first").alias("id"), F.col("first").alias("doc"), F.lit(0).alias("pos"), "values", "bits", "most")
    signed = common.written(signed)
    keys = {r["id"]: set(r["keys"]) for r in signed.select("id", line_dedup._keys(F.col("values")).alias("keys")).collect()}
    assert sum(not keys[a] & keys[b] for a, b in pairs) <= 0.001 * len(pairs)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc long, text string")
    near = line_dedup._bounded(spark.createDataFrame(pairs, "a long, b long"), signed)
    assert near.count() == len(pairs) and line_dedup._links(near, signed, docs).count() == len(pairs)


def test_bitmaps_tell_long_lines_apart(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(6)) for _ in range(400)]
    lines = []
    for n in (40, 60, 120):  # 280 to 840 characters, half of them shared
        for _ in range(10):
            one, other = rng.sample(words, n), rng.sample(words, n)
            lines += [" ".join(one), " ".join(one[:n // 2] + other[n // 2:])]
    distinct = spark.createDataFrame([(x, i, 1) for i, x in enumerate(lines)], "line string, first long, n long")
    signed = common.written(line_dedup._signed(distinct).select(F.col("first").alias("id"), "bits", "most"))
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, len(lines), 2)], "a long, b long")
    assert line_dedup._bounded(pairs, signed).count() == 0


def test_shared_keys_of_all_bands(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(2) for _ in range(line_dedup.VALUES)]) for i in range(40)]
    signed = common.written(spark.createDataFrame(rows, "id long, values array<int>"))
    want = {}
    for i, values in rows:
        for b in range(line_dedup.VALUES):
            want.setdefault((b, *(values[(b + d) % line_dedup.VALUES] for d in line_dedup.BAND)), []).append(i)
    tables = line_dedup._shared(signed)
    got = [[(r["id"], r["a"]) for r in t.collect()] for t in tables]
    assert sorted(x for t in got for x in t) == sorted((i, ids[0]) for ids in want.values() if len(ids) > 1 for i in ids)
    assert all(t.select("key").distinct().count() < len(want) // 3 for t in tables)


def test_hot_buckets_are_cut_into_blocks(monkeypatch, spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60)]
    base, rows = words[:20], []
    for i in range(120):  # one template whose lines are partly linked, partly just below the threshold
        line = list(base)
        for k in rng.sample(range(20), rng.choice((1, 2, 3))):
            line[k] = rng.choice(words)
        rows.append((i, " ".join(line)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain.dedup_lines(rows)
    for size in (1_000, 7):
        monkeypatch.setattr(line_dedup, "BUCKET_ROWS", size)
        assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(df).collect()} == want


def test_bitmaps_and_texts_go_in_parts(monkeypatch, spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60)]
    rows = []
    for i in range(24):
        line = words[:20]
        for k in rng.sample(range(20), rng.choice((1, 2, 3))):
            line[k] = rng.choice(words)
        rows.append((i, " ".join(line)))
    monkeypatch.setattr(line_dedup, "BITMAP_ROWS", 250)
    monkeypatch.setattr(line_dedup, "TEXT_PAIRS", 60)
    parts, of = [], line_dedup.blocks_for
    monkeypatch.setattr(line_dedup, "blocks_for", lambda rows, most: parts.append(of(rows, most)) or parts[-1])
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == plain.dedup_lines(rows) and max(parts) > 1


def test_clashing_names_of_lines(spark):
    df = spark.createDataFrame([(1, LINE, "a", "b", "c", 9), (2, LINE, "d", "e", "f", 9)],
                               "doc_id long, text string, gone string, _doc string, row string, n_lines_removed int")
    out = line_dedup.dedup(df)
    assert sorted(out.columns) == sorted(df.columns)
    got = {r["doc_id"]: r for r in out.collect()}
    assert (got[1]["text"], got[2]["text"], got[2]["gone"], got[2]["row"], got[2]["n_lines_removed"]) == (LINE, "", "d", "f", 1)


def test_repeated_rows_of_lines(spark):
    df = spark.createDataFrame([(1, LINE)] * 3 + [(2, LINE)], "doc_id long, text string")
    assert sorted(r["text"] for r in line_dedup.dedup(df).collect()) == ["", LINE, LINE, LINE]


def test_chat(spark):
    bad = "</s>[INST] \\0 \\1 <s>[\\2\n</s>\n"
    rows = [(1, 0, "user", bad), (1, 1, "assistant", bad), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "tail"),
            (2, 0, "user", "alone"), (3, 5, "assistant", "first"), (3, 5, "assistant", "first"), (4, None, "assistant", "null turn"),
            (4, 0, "we\nird<\\", "x"), (None, 0, None, "n"), (5, 0, "assistant", "long " * 40000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat.expand(df)
    got = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["turns_sha256"] == digest("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own))
        assert (got[conv]["n_turns"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(own), len(loss), digest(loss))
    one = [r for r in examples.where("conv_id = 1").orderBy("example").collect()]
    assert len(one) == 3 and one[2]["loss_start"] is None and one[1]["formatted"].startswith(one[0]["formatted"])
    assert sum(len(r["formatted"]) for r in one) == got[1]["formatted_chars"]
    assert all("</s>" not in r["formatted"][r["loss_start"]:r["loss_end"]] and "[" not in r["formatted"] for r in one[:2])
    assert chat.expand(df.limit(0)).count() == 0 and chat.read_back(chat.expand(df.limit(0))).count() == 0
