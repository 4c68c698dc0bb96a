"""Bytes, bits and big-endian integers as column expressions. All but adler32 stay in the JVM."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def hex_pairs(data: Column) -> Column:
    """Two hex digits for each byte. One regular expression over the whole string: indexing it with substring rescans it for each byte."""
    return F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))


def byte_values(data: Column) -> Column:
    """array<int> of 0..255."""
    return F.transform(hex_pairs(data), lambda p: F.conv(p, 16, 10).cast("int"))


def hex_to_long(digits: Column) -> Column:
    """Up to 15 hex digits as a long."""
    return F.conv(digits, 16, 10).cast("long")


def be_uint(data: Column, position: int | Column, size: int) -> Column:
    """Big-endian unsigned integer of size bytes at a 1-based position; null if there are too few bytes."""
    at = position if isinstance(position, Column) else F.lit(position)
    return F.when(F.octet_length(data) >= at + size - 1, hex_to_long(F.hex(F.substring(data, at, F.lit(size)))))


def be_bytes(value: Column, size: int) -> Column:
    """The low size bytes of a non-negative long, big-endian."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def le_bytes(value: Column, size: int) -> Column:
    """As be_bytes, least byte first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)]))


def bytes_of_dword(value: Column) -> Column:
    """The four bytes of an unsigned 32-bit integer, least first."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.call_function("shiftright", value.cast("long"), i * 8).bitwiseAND(F.lit(255)).cast("int"))


def byteswap32(value: Column) -> Column:
    v = value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    part = lambda shift: F.shiftright(v, shift).bitwiseAND(F.lit(255))
    return F.shiftleft(part(0), 24) + F.shiftleft(part(8), 16) + F.shiftleft(part(16), 8) + part(24)


def byteswap16(value: Column) -> Column:
    v = value.cast("long").bitwiseAND(F.lit(0xFFFF))
    return F.shiftleft(v.bitwiseAND(F.lit(255)), 8) + F.shiftright(v, 8)


def bit_reverse(value: Column, bits: Column | int) -> Column:
    """The low bits of value in reverse order."""
    n = bits if isinstance(bits, Column) else F.lit(bits)
    digits = F.right(F.lpad(F.bin(value.cast("long")), 64, "0"), n)
    return F.coalesce(F.conv(F.reverse(digits), 2, 10).cast("long"), F.lit(0))


def align_up(value: Column, step: int) -> Column:
    """The next multiple of step, a power of two."""
    return (value.cast("long") + (step - 1)).bitwiseAND(F.lit(~(step - 1)))


def power_of_two(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def log2_bracket(n: Column) -> Column:
    """The powers of two at or below and at or above n (n of 1 or more)."""
    low = F.length(F.bin(n.cast("long"))) - 1
    exact = power_of_two(low) == n
    return F.struct(power_of_two(low).alias("below"), F.when(exact, power_of_two(low)).otherwise(power_of_two(low + 1)).alias("above"))


def c_string(data: Column) -> Column:
    """The bytes before the first NUL, as text; all of them if there is none."""
    end = F.instr(F.hex(data), "00")  # a first guess; an odd place is not a byte boundary
    pairs = hex_pairs(data)
    nul = F.array_position(pairs, "00")
    return F.when(end == 0, F.decode(data, "UTF-8")).otherwise(F.decode(F.when(nul > 0, F.substring(data, F.lit(1), (nul - 1).cast("int"))).otherwise(data), "UTF-8"))


def after_nul(data: Column) -> Column:
    """The bytes after the first NUL; null if there is none."""
    nul = F.array_position(hex_pairs(data), "00").cast("int")
    return F.when(nul > 0, F.substring(data, nul + 1, F.octet_length(data)))


def paeth(a: Column, b: Column, c: Column) -> Column:
    """Whichever of left, up and up-left is nearest to a + b - c; ties in that order."""
    da, db, dc = F.abs(b - c), F.abs(a - c), F.abs(a + b - 2 * c)
    return F.when((da <= db) & (da <= dc), a).when(db <= dc, b).otherwise(c)


def crc32(tag: Column, data: Column) -> Column:
    """CRC-32 of a chunk's tag and payload, unsigned."""
    return F.crc32(F.concat(F.encode(tag, "US-ASCII"), data))


def _adler32_batch(data: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else zlib.adler32(b) for b in data], dtype="object")


def adler32(data: Column) -> Column:
    """Adler-32 of binary values, in Arrow batches: the closed form below takes a lambda call for each byte, this a C call for each value."""
    return F.pandas_udf(_adler32_batch, LongType())(data)


def adler32_closed(data: Column) -> Column:
    """Adler-32 in closed form, in the JVM: A = 1 + sum b, B = n + sum (n - i) b_i, both mod 65521."""
    values = byte_values(data)
    n = F.octet_length(data).cast("long")
    sums = F.aggregate(
        values,
        F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("i")),
        lambda acc, b: F.struct((acc.s + b).alias("s"), (acc.w + acc.i * b).alias("w"), (acc.i + 1).alias("i")),
    )
    low, high = (sums.s + 1) % 65521, (n + n * sums.s - sums.w) % 65521
    return high * 65536 + low


def hex_dump(data: Column) -> Column:
    """Bytes as hex pairs with spaces between."""
    return F.array_join(hex_pairs(data), " ")


def bit_string(value: Column, bits: Column | int) -> Column:
    """The low bits of a non-negative integer as 0 and 1, the highest first."""
    n = bits if isinstance(bits, Column) else F.lit(bits)
    return F.right(F.lpad(F.bin(value.cast("long")), 64, "0"), n)


def assert_equal(a: Column, b: Column, message: str) -> Column:
    """a, or an error where a and b differ."""
    return F.when(a.eqNullSafe(b), a).otherwise(F.raise_error(F.lit(message)))
