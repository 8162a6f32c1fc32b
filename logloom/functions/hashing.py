"""FNV-1a over UTF-8 bytes and unsigned modulo, as column expressions.

The 64-bit hash is kept as two 32-bit halves, so no product leaves the range of a long and ANSI mode never raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset basis 0xcbf29ce484222325 in halves; the prime is 2 ** 40 + 435.
BASIS_HI, BASIS_LO = 0xCBF29CE4, 0x84222325
PRIME_LOW = 435
LOW32 = 0xFFFFFFFF
_DIGITS = "0123456789ABCDEF"


def utf8_bytes(text: Column) -> Column:
    """Byte values; empty for an empty text. The hex digits are bound once, not built anew for each byte."""
    n = F.octet_length(text)

    def values(digits: Column) -> Column:
        digit = lambda at: F.instr(F.lit(_DIGITS), F.substring(digits, at, F.lit(1))) - 1
        return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (digit(i * 2 - 1) * 16 + digit(i * 2)).cast("long"))

    return F.when(n > 0, F.transform(F.array(F.hex(F.encode(text, "UTF-8"))), values)[0]).otherwise(F.array().cast("array<bigint>"))


def _fold(text: Column, finish) -> Column:
    """One pass over the bytes; finish(hi, lo) makes the result, so that both halves come from the same pass."""
    start = F.struct(F.lit(BASIS_HI).cast("long").alias("hi"), F.lit(BASIS_LO).cast("long").alias("lo"))

    def step(h: Column, byte: Column) -> Column:
        x = h["lo"].bitwiseXOR(byte)
        low = x * PRIME_LOW
        high = h["hi"] * PRIME_LOW + F.shiftright(low, 32) + x.bitwiseAND(F.lit(0xFFFFFF)) * 256
        return F.struct(high.bitwiseAND(F.lit(LOW32)).alias("hi"), low.bitwiseAND(F.lit(LOW32)).alias("lo"))

    return F.when(text.isNotNull(), F.aggregate(utf8_bytes(text), start, step, lambda h: finish(h["hi"], h["lo"])))


def fnv1a_hex(text: Column) -> Column:
    """16 lower-case hex digits; null for null."""
    return _fold(text, lambda hi, lo: F.lower(F.concat(F.lpad(F.hex(hi), 8, "0"), F.lpad(F.hex(lo), 8, "0"))))


def fnv1a_mod(text: Column, n: int) -> Column:
    """The unsigned hash modulo n; null for null."""
    return _fold(text, lambda hi, lo: (((hi % n) * (2**32 % n) + lo % n) % n).cast("int"))
