"""The stable hash that places keys on shards: FNV-1a with 64 bits, modulo the number of shards.

Spark has no unsigned 64-bit type and checks for overflow, so the hash is kept as two halves of 32 bits. The prime is
2**40 + 435: the product's low half needs the low half alone, and no step exceeds 2**42.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the hash: offset basis in halves, and the prime without its 2**40.
BASIS_HIGH, BASIS_LOW, PRIME_REST = 0xCBF29CE4, 0x84222325, 435
_LOW = 0xFFFFFFFF


def fnv1a64(key: Column) -> Column:
    """struct(hi, lo) of the hash of the key's UTF-8 bytes; null for a null key."""
    digits = F.hex(F.encode(key, "UTF-8"))
    length = F.length(digits)
    # pairs of hex digits; sequence() would count down for an empty string
    at = F.when(length > 0, F.sequence(F.lit(1), length - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(BASIS_HIGH).cast("long").alias("hi"), F.lit(BASIS_LOW).cast("long").alias("lo"))

    def step(acc: Column, i: Column) -> Column:
        byte = F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long")
        x = acc["lo"].bitwiseXOR(byte)
        product = x * PRIME_REST
        carry = F.shiftright(product, 32)
        high = acc["hi"] * PRIME_REST + carry + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(high.bitwiseAND(F.lit(_LOW)).alias("hi"), product.bitwiseAND(F.lit(_LOW)).alias("lo"))

    return F.when(key.isNotNull(), F.aggregate(at, start, step))


def place(h: Column, shards: Column | int) -> Column:
    """Unsigned hash (hi, lo) modulo shards; -1 where shards is not positive."""
    n = (F.lit(shards) if isinstance(shards, int) else shards).cast("long")
    rest = F.pmod(F.pmod(h["hi"], n) * F.pmod(F.lit(1 << 32).cast("long"), n) + F.pmod(h["lo"], n), n)
    return F.when(n <= 0, F.lit(-1)).otherwise(rest).cast("int")


def shard_index(key: Column, shards: Column | int) -> Column:
    """The shard of a key. Where one key meets many tables, hash it once and place the hash."""
    return place(fnv1a64(key), shards)


def crc(data: Column) -> Column:
    """CRC-32 as a long."""
    return F.crc32(data.cast("binary"))
