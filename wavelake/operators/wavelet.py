"""The reversible 5/3 and irreversible 9/7 wavelets on planes held as arrays of rows.

A plane (a tile's component) is one value, so a transform moves no data between tasks: rows are lifted by higher-order
functions, columns are the rows of the transposed plane. Lows come before highs, as in a band layout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import shift_right


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _each(n: Column, of: Callable[[Column], Column], kind: str) -> Column:
    """An array of of(i) for i below n."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), of)).otherwise(F.array().cast(f"array<{kind}>"))


def _at(a: Column, i: Column, n: Column) -> Column:
    """a[i] with i moved to the bounds."""
    return F.get(a, F.greatest(F.lit(0), F.least(i, n - 1)))


def _half(n: Column) -> Column:
    return F.call_function("shiftright", n, F.lit(1))


def fold(plane: Column) -> Column:
    """8 x 8 values as rows."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice(plane, y * 8 + 1, F.lit(8)))


def transpose(rows: Column) -> Column:
    return let(rows, lambda a: F.transform(F.sequence(F.lit(0), F.size(a[0]) - 1), lambda x: F.transform(a, lambda r: F.get(r, x))))


def forward53(a: Column) -> Column:
    """Lows, then highs, of a row of even origin."""

    def of(n: Column) -> Column:
        lows, highs = _half(n + 1), _half(n)
        low = _each(lows, lambda i: F.get(a, i * 2), "bigint")

        def both(s: Column) -> Column:
            high = _each(highs, lambda i: F.get(a, i * 2 + 1) - shift_right(_at(s, i, lows) + _at(s, i + 1, lows), 1), "bigint")
            return let(high, lambda d: F.concat(_each(lows, lambda i: F.get(s, i) + shift_right(_at(d, i - 1, highs) + _at(d, i, highs) + 2, 2), "bigint"), d))

        return F.when(n < 2, a).otherwise(let(low, both))

    return let(F.size(a), of)


def inverse53(a: Column) -> Column:
    def of(n: Column) -> Column:
        lows, highs = _half(n + 1), _half(n)
        high = _each(highs, lambda i: F.get(a, lows + i), "bigint")

        def both(d: Column) -> Column:
            even = _each(lows, lambda i: F.get(a, i) - shift_right(_at(d, i - 1, highs) + _at(d, i, highs) + 2, 2), "bigint")
            return let(even, lambda e: _each(n, lambda i: F.when(i % 2 == 0, F.get(e, _half(i))).otherwise(F.get(d, _half(i)) + shift_right(_at(e, _half(i), lows) + _at(e, _half(i) + 1, lows), 1)), "bigint"))

        return F.when(n < 2, a).otherwise(let(high, both))

    return let(F.size(a), of)


#: Lifting steps and scale of the 9/7 wavelet (fixed values).
ALPHA, BETA, GAMMA, DELTA = -1.586134342, -0.052980118, 0.882911075, 0.443506852
K = 1.230174105


def forward97(a: Column) -> Column:
    """Lows, then highs, of a row of even origin, in single precision: four lifting steps, then the scale."""
    f = lambda x: F.lit(x).cast("float")

    def of(n: Column) -> Column:
        lows, highs = _half(n + 1), _half(n)
        even, odd = _each(lows, lambda i: F.get(a, i * 2), "float"), _each(highs, lambda i: F.get(a, i * 2 + 1), "float")

        def step_high(s: Column, d: Column, c: float) -> Column:
            return _each(highs, lambda i: F.get(d, i) + (_at(s, i, lows) + _at(s, i + 1, lows)) * f(c), "float")

        def step_low(s: Column, d: Column, c: float) -> Column:
            return _each(lows, lambda i: F.get(s, i) + (_at(d, i - 1, highs) + _at(d, i, highs)) * f(c), "float")

        return F.when(n < 2, a).otherwise(
            let(even, lambda s0: let(odd, lambda d0: let(step_high(s0, d0, ALPHA), lambda d1: let(step_low(s0, d1, BETA), lambda s1: let(step_high(s1, d1, GAMMA), lambda d2: let(step_low(s1, d2, DELTA), lambda s2: F.concat(F.transform(s2, lambda v: v * f(1 / K)), F.transform(d2, lambda v: v * f(K)))))))))
        )

    return let(F.size(a), of)


def forward2d(rows: Column, lift: Callable[[Column], Column] = forward53) -> Column:
    """Columns first, then rows."""
    return let(transpose(F.transform(transpose(rows), lift)), lambda r: F.transform(r, lift))


def inverse2d(rows: Column, lift: Callable[[Column], Column] = inverse53) -> Column:
    """Rows first, then columns."""
    return let(F.transform(rows, lift), lambda r: transpose(F.transform(transpose(r), lift)))


def _corner(rows: Column, n: int) -> Column:
    return F.transform(F.slice(rows, 1, n), lambda r: F.slice(r, 1, n))


def _put_corner(rows: Column, corner: Column, n: int) -> Column:
    return let(corner, lambda c: F.transform(rows, lambda r, y: F.when(y < n, F.concat(F.get(c, y), F.slice(r, n + 1, F.size(r)))).otherwise(r)))


def multilevel(planes: DataFrame, size: int, levels: int, rows: str = "rows") -> DataFrame:
    """`levels` transforms of size x size planes in column `rows`, each on the low corner of the last."""
    n = size
    for _ in range(levels):
        planes = planes.withColumn("_low", forward2d(_corner(F.col(rows), n))).withColumn(rows, _put_corner(F.col(rows), F.col("_low"), n)).drop("_low")
        n = (n + 1) // 2
    return planes


def inverse_multilevel(planes: DataFrame, size: int, levels: int, rows: str = "rows") -> DataFrame:
    sizes = [size]
    for _ in range(levels - 1):
        sizes.append((sizes[-1] + 1) // 2)
    for n in reversed(sizes):
        planes = planes.withColumn("_low", inverse2d(_corner(F.col(rows), n))).withColumn(rows, _put_corner(F.col(rows), F.col("_low"), n)).drop("_low")
    return planes
