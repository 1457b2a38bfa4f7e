"""Hashes that other systems must agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193


def fnv1a(token: str) -> int:
    """31 bits of FNV-1a over the token's UTF-8."""
    h = FNV_OFFSET
    for b in token.encode():
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFF
    return h & 0x7FFFFFFF


def string_hash(s: str) -> int:
    """The signed 32-bit polynomial hash in powers of 31 over UTF-16 units."""
    h = 0
    units = s.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(units), 2):
        h = (31 * h + (units[i] << 8 | units[i + 1])) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def text_hash(text: Column | str) -> Column:
    """string_hash of a text as lower-case hex digits, over its UTF-16 code units; a null text is empty."""
    letters = F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), ""), lambda c: c != "")
    add = lambda h, unit: F.pmod(h * 31 + unit, F.lit(1 << 32))

    def step(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        above = code - 0x10000
        return F.when(code < 0x10000, add(h, code)).otherwise(add(add(h, 0xD800 + F.shiftright(above, 10)), 0xDC00 + F.pmod(above, F.lit(1024))))

    return F.lower(F.hex(F.aggregate(letters, F.lit(0).cast("long"), step)))
