"""FNV-1a as a Spark expression, and the hash bucket of a value.

The 64-bit product is built of 32-bit halves, since ANSI arithmetic refuses overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The FNV-1a offset basis (signed), the low word of the prime 2^40 + 435, and the number of buckets.
OFFSET_BASIS = -3750763034362895579
PRIME_LOW = 435
BUCKETS = 100

_LOW = 0xFFFFFFFF


def _step(h: Column, byte: Column) -> Column:
    x = h.bitwiseXOR(byte)
    low, high = x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32)
    product = low * F.lit(PRIME_LOW)
    top = high * F.lit(PRIME_LOW) + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)
    return F.shiftleft(top.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(product.bitwiseAND(F.lit(_LOW)))


def fnv1a64_hex(digits: Column) -> Column:
    """FNV-1a of the bytes that ``digits`` spells in hexadecimal, as a signed bigint."""
    pairs = F.filter(F.split(digits, "(?<=\\G..)"), lambda p: p != "")
    as_byte = lambda p: F.conv(p, 16, 10).cast("bigint")
    return F.aggregate(pairs, F.lit(OFFSET_BASIS).cast("bigint"), lambda h, p: _step(h, as_byte(p)))


def fnv1a64_text(value: Column) -> Column:
    """Of the UTF-8 bytes of a string; null for null."""
    return fnv1a64_hex(F.hex(value.cast("binary")))


def fnv1a64_int(value: Column) -> Column:
    """Of the low 32 bits of an integer, most significant byte first; null for null."""
    return fnv1a64_hex(F.right(F.lpad(F.hex(value.cast("bigint")), F.lit(16), F.lit("0")), F.lit(8)))


def bucket_of(hashed: Column) -> Column:
    """The hash, read as unsigned, modulo BUCKETS."""
    return F.pmod(F.pmod(hashed, F.lit(BUCKETS)) + F.when(hashed < 0, F.lit(2**64 % BUCKETS)).otherwise(F.lit(0)), F.lit(BUCKETS)).cast("int")


def value_bucket(value: Column, is_text: bool) -> Column:
    """The bucket of a field's value; null values have bucket -1."""
    return F.coalesce(bucket_of(fnv1a64_text(value) if is_text else fnv1a64_int(value)), F.lit(-1))


def bucket_of_value(value: int | str) -> int:
    """The same bucket, computed here for one known value."""
    h, prime = OFFSET_BASIS % 2**64, 2**40 + PRIME_LOW
    for byte in value.encode() if isinstance(value, str) else (value % 2**32).to_bytes(4, "big"):
        h = (h ^ byte) * prime % 2**64
    return h % BUCKETS
