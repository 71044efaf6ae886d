"""Component transforms, sample shifts, quantisation and colour conversion as expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clamp, div, f32, fix_mul, long, shift_left, shift_right, truncate

# --- component transforms -----------------------------------------------------------------------------------------


def rct(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Reversible transform."""
    return shift_right(r + 2 * g + b, 2), b - g, r - g


def rct_inverse(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    g = y - shift_right(u + v, 2)
    return v + g, g, u + g


def ict(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Irreversible transform in single precision; the grouping of the sums and the coefficients are part of the definition
    (fixed values)."""
    r, g, b = map(f32, (r, g, b))
    return (
        f32(0.299) * r + (f32(0.587) * g + f32(0.114) * b),
        f32(-0.16875) * r + (f32(-0.331260) * g + f32(0.5) * b),
        f32(0.5) * r + (f32(-0.41869) * g - f32(0.08131) * b),
    )


def ict_inverse(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """Back, by the inverse's published coefficients (fixed values)."""
    return y + f32(1.402) * v, y - (f32(0.34413) * u + f32(0.71414) * v), y + f32(1.772) * u


def matrix_transform(values: list[Column], matrix: list[list[float]]) -> list[Column]:
    """Custom transform in 13-bit fixed point; each product is rounded on its own."""
    fixed = [[int(m * 8192) for m in row] for row in matrix]
    out = []
    for row in fixed:
        total = F.lit(0).cast("long")
        for m, v in zip(row, values, strict=True):
            total = total + fix_mul(F.lit(m), v)
        out.append(total)
    return out


def matrix_product(values: Column, matrix: Column, fixed: bool) -> Column:
    """array of the product of a square matrix array<double>, row by row, with array values, both of each row of data.

    fixed: in 13-bit fixed point over whole values, each coefficient cut and each product rounded on its own; else in
    32-bit floating point. Sums run in the order of the components."""
    n = F.size(values)
    cell = lambda j, k: F.get(matrix, j * n + k)
    if fixed:
        each = lambda m, v: fix_mul((m.cast("float") * F.lit(8192).cast("float")).cast("long"), v)
        zero, plus = F.lit(0).cast("long"), lambda a, x: a + x
    else:
        each = lambda m, v: m.cast("float") * v.cast("float")
        zero, plus = F.lit(0).cast("float"), lambda a, x: (a + x).cast("float")
    row = lambda j: F.aggregate(F.transform(values, lambda v, k: each(cell(j, k), v)), zero, plus)
    return F.transform(F.sequence(F.lit(0), n - 1), row)


# --- samples ------------------------------------------------------------------------------------------------------


def to_unsigned(x: Column, prec: int = 8, signed: bool = False) -> Column:
    """Level shift of a decoded sample, clamped to its precision."""
    lo, hi = (-(1 << prec - 1), (1 << prec - 1) - 1) if signed else (0, (1 << prec) - 1)
    return clamp(x + (0 if signed else 1 << prec - 1), lo, hi)


def to_unsigned_float(x: Column, prec: int = 8) -> Column:
    """The same for a sample in floating point: ties go to the even number, and numbers beyond 32 bits to the bounds."""
    top = (1 << prec) - 1
    near = long(F.rint(x)) + (1 << prec - 1)
    return F.when(x > 2147483647, F.lit(top)).when(x < -2147483648, F.lit(0)).otherwise(clamp(near, 0, top)).cast("long")


def dequantise(x: Column) -> Column:
    """Reversible: half, toward zero."""
    return div(x, F.lit(2))


def dequantise_float(x: Column, step: float) -> Column:
    return f32(x) * (f32(0.5) * f32(step))


def quantise(x: Column) -> Column:
    return shift_left(x, 6)


def quantise_float(x: Column, step: float) -> Column:
    return long(F.rint(f32(x) * (f32(64) / f32(step)).cast("float")))


def roi_descale(v: Column, shift: Column) -> Column:
    """Magnitudes that the region's shift has raised are lowered again."""
    size = F.abs(v)
    low = F.when(shift >= 31, F.lit(0).cast("long")).otherwise(shift_right(size, F.least(shift, F.lit(31))))
    return F.when(size >= shift_left(F.lit(1), F.least(shift, F.lit(31))), F.signum(v.cast("double")).cast("long") * low).otherwise(v)


def step_size(expn: Column, mant: Column, prec: Column, gain: Column) -> Column:
    return (1 + mant / F.lit(2048.0)) * F.pow(F.lit(2.0), prec + gain - expn)


def sample8(v: Column, prec: Column, signed: bool) -> Column:
    v = v + (F.when(prec > 0, shift_left(F.lit(1), prec - 1)).otherwise(0) if signed else 0)
    return F.when(prec < 8, clamp(shift_left(v, F.greatest(8 - prec, F.lit(0))), 0, 255)).otherwise(clamp(shift_right(v, F.greatest(prec - 8, F.lit(0))), 0, 255))


def sample16(v: Column, prec: Column, signed: bool) -> Column:
    v = v + (F.when(prec > 0, shift_left(F.lit(1), prec - 1)).otherwise(0) if signed else 0)
    return F.when(prec < 16, clamp(shift_left(v, F.greatest(16 - prec, F.lit(0))), 0, 65535)).otherwise(clamp(shift_right(v, F.greatest(prec - 16, F.lit(0))), 0, 65535))


# --- colour spaces ------------------------------------------------------------------------------------------------


def sycc_rgb(y: Column, cb: Column, cr: Column, prec: int = 8) -> tuple[Column, Column, Column]:
    """cb, cr: unsigned; products are truncated toward zero. Coefficients of the sYCC definition (fixed values)."""
    top, off = (1 << prec) - 1, 1 << prec - 1
    b, r = (cb - off).cast("double"), (cr - off).cast("double")
    return tuple(clamp(long(y) + d, 0, top) for d in (truncate(F.lit(1.402) * r), -truncate(F.lit(0.344) * b + F.lit(0.714) * r), truncate(F.lit(1.772) * b)))


def cmyk_rgb(c: Column, m: Column, y: Column, k: Column, prec: int = 8) -> tuple[Column, Column, Column]:
    part = (f32(1.0) / f32(float((1 << prec) - 1))).cast("float")  # division is in double
    c, m, y, k = (f32(1.0) - f32(v) * part for v in (c, m, y, k))
    scale = f32(255.0) * k
    return tuple(long(v * scale) for v in (c, m, y))


def eycc_rgb(y: Column, cb: Column, cr: Column, prec: int = 8) -> tuple[Column, Column, Column]:
    """Coefficients of the e-sYCC definition (fixed values); samples are rounded half up."""
    top, off = (1 << prec) - 1, 1 << prec - 1
    y, cb, cr = f32(y), f32(cb - off), f32(cr - off)
    r = y - f32(0.0000368) * cb + f32(1.40199) * cr + f32(0.5)
    g = f32(1.0003) * y - f32(0.344125) * cb - f32(0.7141128) * cr + f32(0.5)
    b = f32(0.999823) * y + f32(1.77204) * cb - f32(0.000008) * cr + f32(0.5)
    return tuple(clamp(long(v), 0, top) for v in (r, g, b))


def upsample(luma: DataFrame, chroma: DataFrame, rows: int) -> DataFrame:
    """`luma` (image_id, y, x, ...) with the chroma (image_id, cy, cx, cb, cr) that covers each pixel: half as wide, and
    half as high if rows is 2. Pixels that no chroma sample covers get 0. An equality join on computed keys."""
    keyed = luma.withColumn("cx", div("x", F.lit(2))).withColumn("cy", div("y", F.lit(rows)))
    out = keyed.join(chroma, ["image_id", "cy", "cx"], "left")
    return out.withColumn("cb", F.coalesce("cb", F.lit(0).cast("long"))).withColumn("cr", F.coalesce("cr", F.lit(0).cast("long"))).drop("cx", "cy")


def palette_expand(indexed: DataFrame, palette: DataFrame, size: int, channels: list[int | None]) -> DataFrame:
    """(px, channel, value) of samples (px, idx) through a palette (idx, pcol, value); channels: the palette column of
    each channel, None for a plain copy. Indices are clamped to the palette."""
    rows = indexed.withColumn("c", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("channel"), F.lit(p).cast("long").alias("col")) for i, p in enumerate(channels)))))
    rows = rows.select("px", "idx", "c.channel", "c.col", clamp("idx", 0, size - 1).alias("at"))
    table = palette.select(F.col("idx").alias("at"), F.col("pcol").alias("col"), "value")
    return rows.join(table, ["at", "col"], "left").select("px", "channel", F.when(F.col("col").isNull(), F.col("idx")).otherwise(F.col("value")).alias("value"))


#: From XYZ under the 50 K daylight white to linear sRGB, and that white (fixed values).
XYZ_RGB = (
    (3.1341863642, -1.6172089590, -0.4906940640),
    (-0.9787485042, 1.9161300968, 0.0334333992),
    (0.0719639278, -0.2289938735, 1.4057537329),
)
WHITE = (0.9642, 1.0, 0.8249)


def lab_rgb(values: tuple[Column, Column, Column], prec: int = 8, ranges: tuple | None = None, offsets: tuple | None = None) -> tuple[Column, Column, Column]:
    """16-bit sRGB of L*a*b* samples; without ranges and offsets the defaults for the precision hold (fixed values: ranges
    100, 170 and 200, offsets 0, a half, and a quarter and an eighth of the sample range). The curve back from L*a*b* is
    that of CIE 15: cubes above 6/29, a line of the same slope below; sRGB's curve is that of IEC 61966-2-1."""
    ranges = ranges or (100.0, 170.0, 200.0)
    offsets = offsets or (0.0, 2.0 ** (prec - 1), 2.0 ** (prec - 2) + 2.0 ** (prec - 3))
    top = 2.0**prec - 1
    light, a, b = (F.lit(-(r * o) / top) + v.cast("double") * r / top for v, r, o in zip(values, ranges, offsets, strict=True))
    fy = (light + 16.0) / 116.0
    knee = 6.0 / 29.0

    def cube(t: Column, white: float) -> Column:
        return F.when(t > knee, t * t * t).otherwise((t - 16.0 / 116.0) * (3.0 * knee * knee)) * white

    xyz = [cube(t, w) for t, w in zip((fy + a / 500.0, fy, fy - b / 200.0), WHITE, strict=True)]
    out = []
    for row in XYZ_RGB:
        v = xyz[0] * row[0] + xyz[1] * row[1] + xyz[2] * row[2]
        curve = F.when(v <= 0, F.lit(0.0)).when(v >= 1, F.lit(1.0)).when(v <= 0.0031308, v * 12.92).otherwise(F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)
        out.append(clamp(F.floor(curve * 65535.0 + 0.5), 0, 65535))
    return tuple(out)


def upsample_from(luma: DataFrame, chroma: DataFrame, rows: int) -> DataFrame:
    """As upsample(), for images whose origin (x0, y0, columns of `luma`) may be odd. Chroma begins at the first even
    coordinate: what lies before it has none (0), but in the lower of two rows that share chroma the first column takes the
    row's first. So have columns beyond the chroma plane's end."""
    offx, offy = F.col("x0") % 2, (F.col("y0") % 2 if rows == 2 else F.lit(0))
    down = F.col("y") - offy
    lower = (down >= 0) & (down % 2 == 1) if rows == 2 else F.lit(False)
    cx = F.when(F.col("x") >= offx, div(F.col("x") - offx, F.lit(2))).when(lower, F.lit(0).cast("long"))
    cy = F.when(down >= 0, div(down, F.lit(rows)))
    keyed = luma.withColumn("cx", cx).withColumn("cy", cy)
    out = keyed.join(chroma, ["image_id", "cy", "cx"], "left")
    return out.withColumn("cb", F.coalesce("cb", F.lit(0).cast("long"))).withColumn("cr", F.coalesce("cr", F.lit(0).cast("long"))).drop("cx", "cy")
