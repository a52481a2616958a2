"""Column expressions of the codecs: bits, wrapping arithmetic, encoded sizes.  All stay in the JVM but for the float views."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.codec import codes, schema

WHOLE = "decimal(38,0)"


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _wrapped(exact: Column, width: int) -> Column:
    """A decimal brought into the range of a signed integer of width bits."""
    half, full = (F.lit(str(1 << (width - k))).cast(WHOLE) for k in (1, 0))
    return (F.pmod(exact + half, full) - half).cast("bigint" if width == 64 else "int")


def wrap_subtract(a: str | Column, b: str | Column, width: int = 64) -> Column:
    """a - b modulo 2**width.  Plain subtraction, and exact decimals only where that overflows."""
    a, b = _column(a), _column(b)
    return F.coalesce(F.try_subtract(a, b), _wrapped(a.cast(WHOLE) - b.cast(WHOLE), width))


def wrap_add(a: str | Column, b: str | Column, width: int = 64) -> Column:
    a, b = _column(a), _column(b)
    return F.coalesce(F.try_add(a, b), _wrapped(a.cast(WHOLE) + b.cast(WHOLE), width))


def wrap_sum(total: str | Column, width: int = 64) -> Column:
    """A decimal sum of integers modulo 2**width."""
    return _wrapped(_column(total), width)


def zigzag(v: str | Column, width: int = 64) -> Column:
    """Signed to unsigned order, in the bits of a signed column of the same width."""
    v = _column(v)
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, width - 1))


def unzigzag(z: str | Column) -> Column:
    z = _column(z)
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1))))


def bit_length(z: str | Column) -> Column:
    """Bits of the unsigned reading of a bigint, 1 for 0."""
    return F.length(F.bin(_column(z)))


def varint_size(z: str | Column) -> Column:
    """Bytes of the base-128 form of an unsigned value."""
    return F.ceil(bit_length(z) / 7).cast("int")


def leading_zeros(bits: str | Column) -> Column:
    """Of 64 bits; 64 for 0."""
    bits = _column(bits)
    return F.when(bits == 0, 64).otherwise(64 - bit_length(bits))


def trailing_zeros(bits: str | Column) -> Column:
    """Of 64 bits; 64 for 0."""
    bits = _column(bits)
    text = F.bin(bits)
    return F.when(bits == 0, 64).otherwise(F.length(text) - F.length(F.rtrim(text, F.lit("0"))))


def byte_lane(bits: str | Column, lane: int) -> Column:
    """Byte lane of an integer, 0 the lowest, as 0 to 255."""
    return F.shiftright(_column(bits), 8 * lane).bitwiseAND(F.lit(255)).cast("int")


@F.pandas_udf(T.LongType())
def _double_bits(v: pd.Series) -> pd.Series:
    return pd.Series(v.to_numpy("float64").view("int64"))


@F.pandas_udf(T.IntegerType())
def _float_bits(v: pd.Series) -> pd.Series:
    return pd.Series(v.to_numpy("float32").view("int32"))


@F.pandas_udf(T.DoubleType())
def _bits_double(v: pd.Series) -> pd.Series:
    return pd.Series(v.to_numpy("int64").view("float64"))


def float_bits(v: str | Column, width: int = 64) -> Column:
    """The bits of a double or float, NaN payloads and signs of zero included; null stays null."""
    v = _column(v)
    zero = F.lit(0.0).cast("double" if width == 64 else "float")
    return F.when(v.isNotNull(), (_double_bits if width == 64 else _float_bits)(F.coalesce(v, zero)))


def bits_float(v: str | Column) -> Column:
    v = _column(v)
    return F.when(v.isNotNull(), _bits_double(F.coalesce(v, F.lit(0).cast("bigint"))))


def unix_micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    ts = _column(ts)
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return day * 86_400_000_000 + F.hour(ts).cast("bigint") * 3_600_000_000 + F.minute(ts).cast("bigint") * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def fixed_point(v: str | Column, scale: int = 10_000_000) -> Column:
    """A decimal quantity as an integer number of 1/scale."""
    return F.round(_column(v) * scale).cast("bigint")


def _band(v: Column, base: list[int]) -> Column:
    """Place of the last bound that isn't over v, of a fixed ascending list."""
    return F.size(F.filter(F.array(*map(F.lit, base)), lambda x: x <= v)) - 1


def length_code(n: str | Column) -> Column:
    return _band(_column(n), codes.LENGTH_BASE)


def offset_code(o: str | Column) -> Column:
    return _band(_column(o), codes.OFFSET_BASE) + codes.REPEATS


def guessed_stride(size: str | Column, name: str | Column) -> Column:
    """The record width that schema.guess_stride takes an untyped file of that size and name to have."""
    size, name = _column(size), _column(name)
    fits = F.filter(F.array(*map(F.lit, schema.STRIDES)), lambda s: (size % s == 0) & (F.floor(size / s) >= 10))
    text = F.lit(False)
    for ending in schema.TEXT_ENDINGS:
        text = text | F.lower(name).endswith(ending)
    return F.when(text | (size < 1024), 0).otherwise(F.coalesce(F.get(fits, 0), F.lit(0))).cast("int")


def entropy(counts: str | Column, total: str | Column) -> Column:
    """Aggregate: order-0 bits of symbols, from a row for each symbol with its count and the total."""
    p = _column(counts) / _column(total)
    return F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0))


def estimated_ratio(size: str | Column, bits: str | Column) -> Column:
    """Size over order-0 size."""
    size, bits = _column(size), _column(bits)
    return F.when(size == 0, 1.0).when(bits < 0.001, size.cast("double")).otherwise(8.0 / bits)
