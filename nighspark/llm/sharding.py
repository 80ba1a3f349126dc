"""Sharding by jump consistent hashing, in DataFrame functions only.

A key's shard follows from the key and the number of shards alone: a generator seeded by the key jumps forward over
shard numbers until it would leave the range. Appending a shard therefore moves rows only into that shard, and no ring
or table is kept. The 64-bit generator is computed on two 32-bit halves, so nothing overflows under ANSI arithmetic.

Defined cases: a null key hashes as 0; a null text has no bytes (crc32 0); rows equal in key and text get neighbouring
slots; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MULTIPLIER = 2862933555777941757
LOW32 = 0xFFFFFFFF
#: Jumps taken before rows that have arrived stop being looked at; further ones are taken only by the rest.
FIRST_STEPS = 16
SIZE_OVERHEAD = 16


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _product(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) of (hi, lo) * MULTIPLIER + 1 modulo 2^64, every intermediate below 2^63."""
    c0, c1 = MULTIPLIER & LOW32, MULTIPLIER >> 32
    low = lo * _long(c0 & 0xFFFF)
    mid = lo * _long(c0 >> 16)
    t = low + F.shiftleft(mid.bitwiseAND(_long(0xFFFF)), 16) + _long(1)
    carry = F.shiftright(t, 32) + F.shiftright(mid, 16)
    cross = (lo * _long(c1)).bitwiseAND(_long(LOW32))
    high = hi.bitwiseAND(_long(0xFFFF)) * _long(c0) + F.shiftleft((F.shiftright(hi, 16) * _long(c0)).bitwiseAND(_long(0xFFFF)), 16)
    return (carry + cross + high.bitwiseAND(_long(LOW32))).bitwiseAND(_long(LOW32)), t.bitwiseAND(_long(LOW32))


def _halves(key: Column) -> tuple[Column, Column]:
    k = F.coalesce(key.cast("long"), _long(0))
    return F.shiftrightunsigned(k, 32), k.bitwiseAND(_long(LOW32))


def jump_state(key: Column, shards: int) -> Column:
    """struct(b, j, hi, lo): b is the shard of key among `shards`, j the next shard the key would jump to."""

    def step(s: Column, _: Column) -> Column:
        hi, lo = _product(s["hi"], s["lo"])
        j = ((s["j"] + _long(1)).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + _long(1)).cast("double"))).cast("long")
        return F.when(s["j"] >= _long(shards), s).otherwise(F.struct(s["j"].alias("b"), j.alias("j"), hi.alias("hi"), lo.alias("lo")))

    hi, lo = _halves(key)
    start = F.struct(_long(-1).alias("b"), _long(0).alias("j"), hi.alias("hi"), lo.alias("lo"))
    steps = F.sequence(F.lit(1), F.lit(min(FIRST_STEPS, shards)))
    first = F.aggregate(steps, start, step)
    if shards <= FIRST_STEPS:
        return first
    return F.aggregate(
        F.array(first),
        start,
        lambda _, s: F.aggregate(F.when(s["j"] >= _long(shards), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.lit(shards))), s, step),
    )


def jump_shard(df: DataFrame, key: str, shards: int, shard_col: str = "shard", grown_col: str | None = None) -> DataFrame:
    """df with the shard (int) of each row's key; with grown_col also its shard if one more were appended. No shuffle."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = "__ns_jump"
    out = df.withColumn(state, jump_state(F.col(key), shards)).withColumn(shard_col, F.col(state)["b"].cast("int"))
    if grown_col:
        out = out.withColumn(grown_col, F.when(F.col(state)["j"] == shards, F.lit(shards)).otherwise(F.col(state)["b"]).cast("int"))
    return out.drop(state)


def shard_layout(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 200_000) -> DataFrame:
    """One row per row of df: key, size, text_crc32, law, shard, slot, grown_shard.

    Slots number each shard from 0 without gaps, ordered by 16 bits of the generator's low half and the text's digest, then
    key and digest. They are counted per (shard, range of those bits), so no task ranks a whole shard or all texts of a hot
    key; equal rows are counted before the shuffle and spread out again after it, so they are one row on the way.
    """
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    digest = df.select(F.col(key).alias("key"), (F.octet_length(raw) + SIZE_OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("crc"))
    each = digest.groupBy("key", "size", "crc").agg(F.count("*").alias("c"))
    each = jump_shard(each, "key", shards, "shard", "grown_shard")
    # the digest keeps different texts of one hot key out of one task
    mix = F.pmod(F.shiftright(_product(*_halves(F.col("key")))[1], 16) + F.col("crc"), _long(65536))
    buckets = max(1, min(65536, 1 << max(0, (df.count() // rows_per_bucket).bit_length())))
    each = each.withColumn("mix", mix).withColumn("bucket", F.floor(F.col("mix") * buckets / 65536).cast("int"))
    totals = each.groupBy("shard", "bucket").agg(F.sum("c").alias("t"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("shard").alias("s"), F.col("bucket").alias("k"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "bucket").orderBy("mix", "key", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("ahead", F.coalesce(F.sum("c").over(order), F.lit(0)))
    # at most shards * buckets rows of 24 bytes, however long the table
    held = F.broadcast(totals) if shards * buckets <= 400_000 else totals
    placed = placed.join(held, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("k")))
    copies = F.explode(F.sequence(_long(0), F.col("c") - 1))
    return placed.select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", "grown_shard", "base", "ahead", copies.alias("n")
    ).select(key, "size", "text_crc32", "law", "shard", (F.col("base") + F.col("ahead") + F.col("n")).alias("slot"), "grown_shard")
