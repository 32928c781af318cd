"""Shards by jump consistent hashing, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep.llm.common import blocks_for, written

# Multiplier of the 64-bit generator inside jump consistent hashing, and its 32-bit halves.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
MASK = 0xFFFFFFFF


def key_halves(key: Column) -> tuple[Column, Column]:
    """64 bits of the key's md5 as two longs of 32 bits, so that any type serves as a stable key. Null counts as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    half = lambda start: F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
    return half(1), half(9)


def _next(state: Column) -> Column:
    """One step: key = key * MULTIPLIER + 1 modulo 2^64, in 16 and 32-bit parts that never overflow a long."""
    hi, lo = state["hi"], state["lo"]
    low0 = lo.bitwiseAND(0xFFFF) * F.lit(LOW)
    low1 = F.shiftright(lo, 16) * F.lit(LOW)
    total = low0 + F.shiftleft(low1.bitwiseAND(0xFFFF), 16) + F.lit(1)
    carry = F.shiftright(total, 32) + F.shiftright(low1, 16)
    high = hi.bitwiseAND(0xFFFF) * F.lit(LOW) + F.shiftleft((F.shiftright(hi, 16) * F.lit(LOW)).bitwiseAND(0xFFFF), 16)
    new_hi = (carry + lo * F.lit(HIGH) + high).bitwiseAND(F.lit(MASK))
    jump = F.floor((state["j"] + F.lit(1)) * (F.lit(2147483648.0) / (F.shiftright(new_hi, 1) + F.lit(1))))
    return F.struct(state["j"].alias("b"), jump.cast("long").alias("j"), new_hi.alias("hi"),
                    total.bitwiseAND(F.lit(MASK)).alias("lo"))


def jump_shard(hi: Column, lo: Column, shards: int) -> Column:
    """The shard of a key, 0 to `shards` - 1. A jump always moves on, so `shards` steps end every walk; most need
    about ln(shards), and the steps beyond a first stretch run only for keys whose walk is still under way."""
    def walk(start: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start,
                           lambda s, _: F.when(s["j"] < shards, _next(s)).otherwise(s))

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), hi.alias("hi"), lo.alias("lo"))
    first = min(shards, 16 + 4 * shards.bit_length())
    state = walk(start, first)
    if first < shards:
        state = F.transform(F.array(state), lambda s: F.when(s["j"] < shards, walk(s, shards - first)).otherwise(s))[0]
    return state["b"].cast("int")


def shard_table(df: DataFrame, key: str, text: str, shards: int, rows_per_block: int = 50_000) -> DataFrame:
    """Places every row of `df` and numbers the rows of each shard without gaps.

    Returns `key`, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32 (null text: that of ''), shard,
    slot, grown_shard (the shard if there were one more). Other columns of `df` are left out, so their names can't clash.

    The text is read once, into a table without texts. A shard is cut into blocks by a hash of key and text; blocks are
    counted, their starts summed up, and rows numbered inside their block, so no task ever holds a whole shard, and
    repeated keys with different texts spread too. Ties are rows equal in key, size and checksum: their slots are
    interchangeable. Repeated rows each get a slot. An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    hi, lo = key_halves(F.col(key))
    thin = df.select(F.col(key), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    thin = thin.select("*", jump_shard(hi, lo, shards).alias("shard"), jump_shard(hi, lo, shards + 1).alias("grown_shard"))
    thin = written(thin)
    blocks = blocks_for(thin.count(), shards * rows_per_block)
    thin = thin.withColumn("_block", F.pmod(F.xxhash64(F.col(key), F.col("text_crc32")), F.lit(blocks)))
    counts = thin.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_block").orderBy(key, "text_crc32", "size")
    numbered = thin.withColumn("_place", F.row_number().over(inside) - 1).join(starts, ["shard", "_block"])
    return numbered.select(key, "size", "text_crc32", "shard", (F.col("_start") + F.col("_place")).alias("slot"), "grown_shard")
