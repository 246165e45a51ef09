"""Sharding by jump consistent hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import number_within, salts_for

#: Fixed values of the published algorithm: the multiplier of its generator, and 2 to the 64.
MULTIPLIER = 2862933555777941757
WORD = "18446744073709551616"


def jump(key: Column, shards: int) -> Column:
    """struct(b, j): the shard b of the key among `shards`, and the place j to which its next jump leads.

    The generator is a 64-bit product with wrap-around; it is carried in decimal(38,0), which holds it exactly, so
    that ANSI overflow checks don't matter. A null key counts as 0, a negative one as its unsigned 64-bit value. Each
    step moves j up by one at least, so `shards` steps are enough.
    """
    number = F.coalesce(key.cast("long"), F.lit(0)).cast("decimal(20,0)")
    unsigned = F.when(number < 0, (number + F.lit(WORD).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(number)
    start = F.struct(unsigned.alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        k = (s["k"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) % F.lit(WORD).cast("decimal(20,0)")
        k = k.cast("decimal(20,0)")
        high = F.floor(k / F.lit(1 << 33).cast("decimal(10,0)")).cast("double")
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (high + 1.0))).cast("long")
        moved = F.struct(k.alias("k"), s["j"].alias("b"), j.alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: F.struct(s["b"].alias("b"), s["j"].alias("j")))


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Place each row in a shard by its doc_id alone.

    Returns doc_id, size (UTF-8 bytes of the text plus 8; null text: 8), text_crc32 (null text: that of no bytes, 0),
    law ('key'), shard, slot (gapless from 0 in a shard) and grown_shard (its shard if one more were appended).
    Repeated rows share a shard and get slots of their own; texts of any length are measured whole; other columns, of any name,
    aren't read; an empty table gives no rows.

    The slots need the number of rows in each part of a shard; those counts come from a scan of doc_id alone.
    """
    salts = salts_for(docs.count())
    at = jump(F.col("doc_id"), shards)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("_salt")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        at.alias("_at"),
        salt,
    ).withColumn("shard", F.col("_at.b").cast("int"))
    counts = docs.select(at["b"].cast("int").alias("shard"), salt).groupBy("shard", "_salt").agg(F.count("*").alias("n"))
    numbered = number_within(rows, counts, "shard", "_salt", ["doc_id", "text_crc32"], "slot")
    grown = F.when(F.col("_at.j") == shards, F.lit(shards)).otherwise(F.col("shard")).cast("int")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))
