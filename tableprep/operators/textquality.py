"""Scores of a text column, 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableprep.functions.columns import col

TIMESTAMP = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"  # fixed value
BLOCK_SECONDS = 86_400


def _share(df: DataFrame, bad: Column) -> float | None:
    n, k = df.agg(F.count("*"), F.count_if(bad)).first()
    return 1 - k / n if n else None


def _off_length(x: Column, shortest: int, longest: int) -> Column:
    return (F.char_length(x) < shortest) | (F.char_length(x) > longest)


def length_score(df: DataFrame, name: str, shortest: int = 10, longest: int = 500) -> float | None:
    """1 minus the share of texts that are too short or too long."""
    return _share(df, _off_length(col(name), shortest, longest))


def reading_ease(x: Column) -> Column:
    """Flesch reading ease. A syllable is a group of vowels, and a word has at least one."""
    words = F.regexp_count(x, F.lit(r"\p{L}+"))
    sentences = F.greatest(F.regexp_count(x, F.lit(r"[.!?]+")), F.lit(1))
    syllables = F.greatest(F.regexp_count(x, F.lit(r"[aeiouyAEIOUY]+")), words)
    per_word = F.when(words > 0, syllables / words).otherwise(0.0)
    return F.lit(206.835) - F.lit(1.015) * (words / sentences) - F.lit(84.6) * per_word


def readability_score(df: DataFrame, name: str, lowest: float = 30.0) -> float | None:
    """1 minus the share of texts that are hard to read."""
    return _share(df, reading_ease(col(name)) < lowest)


def gap_rate(df: DataFrame, name: str, seconds: int = 600) -> float:
    """Share of gaps below `seconds` between the first timestamps of the texts, put in order; 0 for fewer than two.

    Equal timestamps are counted first. The rest is cut into days; a gap that small can only reach the day before (or
    the block before, if longer gaps are asked for), so no step needs a total order.
    """
    block = max(BLOCK_SECONDS, seconds)
    ts = F.try_to_timestamp(F.nullif(F.regexp_extract(col(name), TIMESTAMP, 1), F.lit("")))
    times = (df.select(F.unix_seconds(ts).alias("t")).dropna().groupBy("t").agg(F.count("*").alias("n"))
             .withColumn("b", F.floor(F.col("t") / block)))
    inside = times.withColumn("p", F.lag("t").over(Window.partitionBy("b").orderBy("t")))
    last = times.groupBy((F.col("b") + 1).alias("b")).agg(F.max("t").alias("carry"))
    gaps = inside.join(last, "b", "left").withColumn("gap", F.col("t") - F.coalesce("p", "carry"))
    n, repeats, close = gaps.agg(F.sum("n"), F.sum(F.col("n") - 1), F.count_if(F.col("gap") < seconds)).first()
    return ((repeats if seconds > 0 else 0) + close) / (n - 1) if n and n > 1 else 0.0


def text_score(df: DataFrame, name: str, shortest: int = 10, longest: int = 500, lowest: float = 30.0,
               seconds: int = 600) -> float | None:
    """Mean of the length, readability and gap scores."""
    n, off, hard = df.agg(F.count("*"), F.count_if(_off_length(col(name), shortest, longest)),
                          F.count_if(reading_ease(col(name)) < lowest)).first()
    return (1 - off / n + 1 - hard / n + gap_rate(df, name, seconds)) / 3 if n else None
