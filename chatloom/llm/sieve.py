"""A sieve of fixed size for keys that are looked for among many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one of Spark's bitmaps, and of the whole sieve, as powers of 2: 16 MB.
BLOCK_BITS, SIEVE_BITS = 15, 27


def bit(bits: Column, at: Column) -> Column:
    """Whether bit ``at`` of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1


def seen_before(rows: DataFrame, key: list[str], keys: DataFrame) -> DataFrame:
    """rows but for most of those whose ``key`` isn't among keys: by one bit for each of 2^SIEVE_BITS hashes, a broadcast of a fixed size."""
    low, h = F.lit((1 << BLOCK_BITS) - 1), F.xxhash64(*key)
    part, at = F.pmod(F.shiftright(h, BLOCK_BITS), F.lit(1 << SIEVE_BITS - BLOCK_BITS)), h.bitwiseAND(low)
    sieve = keys.select(part.alias("part"), at.alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("_bits"))
    return rows.withColumn("part", part).join(F.broadcast(sieve), "part").where(bit(F.col("_bits"), at.cast("int"))).select(*rows.columns)
