"""Integer and sample arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def long(x) -> Column:
    return _c(x).cast("long")


def div(a, b) -> Column:
    """Quotient, truncated toward zero."""
    return F.call_function("div", long(a), long(b))


def ceil_div(a, b) -> Column:
    return div(long(a) + long(b) - 1, b)


def shift_left(a, n) -> Column:
    return F.call_function("shiftleft", long(a), _c(n).cast("int"))


def shift_right(a, n) -> Column:
    return F.call_function("shiftright", long(a), _c(n).cast("int"))


def ceil_shift(a, n) -> Column:
    return shift_right(long(a) + shift_left(F.lit(1), n) - 1, n)


def clamp(a, lo, hi) -> Column:
    return F.greatest(_c(lo).cast("long"), F.least(_c(hi).cast("long"), long(a)))


def floor_log2(a) -> Column:
    a = long(a)
    return F.when(a <= 1, F.lit(0)).otherwise(F.length(F.bin(a)) - 1).cast("long")


def saturating_add(a, b) -> Column:
    return F.least(long(a) + long(b), F.lit(4294967295))


def saturating_sub(a, b) -> Column:
    return F.greatest(long(a) - long(b), F.lit(0).cast("long"))


def wrap32(a) -> Column:
    """The low 32 bits of a number as a signed one."""
    return F.pmod(long(a) + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)


def fix_mul(a, b, bits: int = 13) -> Column:
    """Product of numbers with 13 fractional bits, rounded and shifted by `bits`."""
    return wrap32(shift_right(long(a) * long(b) + 4096, bits))


def truncate(x: Column) -> Column:
    """A double without its fraction."""
    return x.cast("long")


def f32(x) -> Column:
    return F.lit(x).cast("float") if isinstance(x, (int, float)) else _c(x).cast("float")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column whose value later columns refer to and do not work out again: a large expression that is used
    many times would else be copied into each use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def bound(value: Column, body) -> Column:
    """body(value), whose value is worked out once: what a lambda refers to would else be worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
