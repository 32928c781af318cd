"""Groups of spelling variants by permuterm rotations.

A word marked with an end sign has one rotation more than letters. The rotation that ends with a letter, without that letter,
is a prefix that skips the letter: two words that differ by a replacement share it, and a word with one letter more has
the whole rotation of the shorter word as such a prefix. Rotations sorted by prefix therefore hold all near words of a
word side by side, and one scan of every group gives each word the number of its neighbours and the most frequent one. No
pairs are formed. A group holds at most one word per letter of the alphabet, whatever the size of the table.
"""

from __future__ import annotations

import collections
import re
import string
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableprep.llm.common import written

END = "$"
#: Shortest word, least number of occurrences, and how much more frequent a word's form has to be.
LETTERS, OCCURRENCES, FACTOR = 5, 3, 2
#: One of so many (document, word) couples loses a letter before counting.
SLIPS = 97
#: A task hands on its counts when it holds so many distinct words.
HELD = 300_000

_FOLD = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def _slip(run: str, doc_prefix: int) -> str:
    number = zlib.crc32(run.encode(), doc_prefix)
    if number % SLIPS:
        return run
    spot = number % len(run)
    return run[:spot] + run[spot + 1:]


def count_words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of at least LETTERS code points and OCCURRENCES occurrences, counted over whole texts.

    Runs of letters are lower-cased (A-Z alone); where the checksum of `<key>:<run>` says so, a run loses one letter. Null
    texts have no words, a null key counts as an empty string; repeated rows count as often as they occur.
    """
    runs_of = re.compile(f"[a-zÀ-ÿ]{{{LETTERS},}}").findall  # a shorter run cannot give a word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: collections.Counter[str] = collections.Counter()

        def hand_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                               ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc, body in zip(batch.column(0), batch.column(1)):
                if not body.is_valid:
                    continue
                prefix = zlib.crc32(f"{doc.as_py() if doc.is_valid else ''}:".encode())
                runs = runs_of(body.as_py().encode().translate(_FOLD).decode())
                for one, n in collections.Counter(runs).items():
                    held[_slip(one, prefix)] += n
                if len(held) >= HELD:
                    yield hand_on()
        if held:
            yield hand_on()

    counts = df.select(key, text).mapInArrow(run, "word string, n long")
    return counts.where(F.length("word") >= LETTERS).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, word, n, whole, leads) of (word, n): every rotation of the marked word (`whole`), and every rotation that
    ends with a letter without that letter. leads: the skipped letter is the first of its run of equal letters; leaving out
    any letter of a run gives the same word, which must count once."""
    around = lambda first, last: F.concat(F.expr(f"substring(word, {first})"), F.lit(END),
                                          F.expr(f"substring(word, 1, {last})"))
    letter = lambda i: F.expr(f"substring(word, {i}, 1)")
    spots = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("i"))
    both = F.array(
        F.struct(around("i", "i - 1").alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("leads")),
        F.struct(around("i + 1", "i - 1").alias("prefix"), F.lit(False).alias("whole"),
                 ((F.col("i") == 1) | (letter("i") != letter("i - 1"))).alias("leads")))
    on_letter = F.col("i") <= F.length("word")
    return spots.select("word", "n", F.explode(F.when(on_letter, both).otherwise(F.slice(both, 1, 1))).alias("r")).select(
        "r.prefix", "word", "n", "r.whole", "r.leads")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best) of (word, n): the number of words that are one replaced, inserted or deleted code point away,
    and the most frequent of them as (less: its n with a minus sign, word), null without any. Words must be distinct."""
    group = Window.partitionBy("prefix")
    ranked = group.orderBy(F.desc("n"), "word")
    everyone = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct((-F.col("n")).alias("less"), "word")
    seen = rotations(words).select(
        "word", "n", "whole", "leads",
        F.row_number().over(ranked).alias("place"),
        F.first(entry).over(everyone).alias("top"), F.nth_value(entry, 2).over(everyone).alias("next"),
        F.count_if(~F.col("whole")).over(group).alias("members"), F.bool_or("whole").over(group).alias("shorter"),
        F.count_if("leads").over(group).alias("longer"))
    near = F.when(F.col("whole"), F.col("longer")).otherwise(
        F.col("members") - 1 + (F.col("leads") & F.col("shorter")).cast("long"))
    best = F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top"))
    found = seen.where(F.col("next").isNotNull()).select("word", "n", near.alias("n_near"), best.alias("best"))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(found.schema["best"].dataType).alias("best"))
    return found.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last. A form is at least FACTOR times as frequent as its word, so
    chains are short and without rings; every round doubles the way covered, and words at their end are set aside."""
    step = moving = links.select("word", F.col("form").alias("up"))
    done = None
    while True:
        jump = written(moving.join(step.select(F.col("word").alias("up"), F.col("up").alias("then")), "up", "left"))
        ended = jump.where(F.col("then").isNull()).select("word", F.col("up").alias("root"))
        done = ended if done is None else done.unionByName(ended)
        moving = jump.where(F.col("then").isNotNull()).select("word", F.col("then").alias("up"))
        if moving.isEmpty():
            return done
        step = moving.unionByName(done.withColumnRenamed("root", "up"))


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n) with distinct words.

    form: the near word of largest n (ties: the smallest in code-point order), if that n is at least FACTOR times the word's
    own; form_n is its n. root: the last word on the way from form to form; a word without a form is its own. Rows without a
    word are left out. An empty table gives no rows.
    """
    found = neighbours(words.where(F.col("word").isNotNull()))
    good = -F.col("best.less") >= FACTOR * F.col("n")
    table = written(found.select("word", "n", "n_near", F.when(good, F.col("best.word")).alias("form"),
                                 F.when(good, -F.col("best.less")).alias("form_n")))
    ends = roots(table.where(F.col("form").isNotNull()).select("word", "form"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`variants` of the words of all texts. Columns other than key and text are not looked at, whatever their names."""
    return variants(written(count_words(df, key, text)))
