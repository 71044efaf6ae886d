"""Coding parameters as rules over columns: validity, defaults and overrides, step sizes, norms, byte budgets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamp, floor_log2, long, shift_left, shift_right

#: Norms of the wavelets' basis functions by band (low, high in x, high in y, both) and level, and of the component
#: transforms' by component (fixed values).
NORMS_53 = (
    (1.000, 1.500, 2.750, 5.375, 10.68, 21.34, 42.67, 85.33, 170.7, 341.3),
    (1.038, 1.592, 2.919, 5.703, 11.33, 22.64, 45.25, 90.48, 180.9),
    (1.038, 1.592, 2.919, 5.703, 11.33, 22.64, 45.25, 90.48, 180.9),
    (0.7186, 0.9218, 1.586, 3.043, 6.019, 12.01, 24.00, 47.97, 95.93),
)
NORMS_97 = (
    (1.000, 1.965, 4.177, 8.403, 16.90, 33.84, 67.69, 135.3, 270.6, 540.9),
    (2.022, 3.989, 8.355, 17.04, 34.27, 68.63, 137.3, 274.6, 549.0),
    (2.022, 3.989, 8.355, 17.04, 34.27, 68.63, 137.3, 274.6, 549.0),
    (2.080, 3.865, 8.307, 17.18, 34.71, 69.59, 139.3, 278.6, 557.2),
)
RCT_NORMS, ICT_NORMS = (1.732, 0.8292, 0.8292), (1.732, 1.805, 1.573)
#: Progression orders by code, and enumerated colour spaces by code (fixed values of the format).
PROGRESSIONS = {0: "LRCP", 1: "RLCP", 2: "RPCL", 3: "PCRL", 4: "CPRL"}
COLOUR_SPACES = {16: "srgb", 17: "gray", 18: "sycc", 24: "eycc", 12: "cmyk"}


def named(code: Column, names: dict[int, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, name in names.items():
        out = F.when(code == k, F.lit(name)).otherwise(out)
    return out


def norm(level: Column, band: Column, reversible: bool) -> Column:
    """Norm of a band's basis functions; levels beyond the table take its last value."""
    rows = F.array(*(F.array(*map(F.lit, r)) for r in (NORMS_53 if reversible else NORMS_97)))
    row = F.element_at(rows, (band + 1).cast("int"))
    return F.element_at(row, F.least(level.cast("int"), F.size(row) - 1) + 1)


def gain(band: Column) -> Column:
    """Bits that a reversible band grows by."""
    return F.when(band == 0, 0).when(band == 3, 2).otherwise(1).cast("long")


def packed_step(step: Column, bits: Column) -> tuple[Column, Column]:
    """(exponent, mantissa of 11 bits) of a step size with 13 fractional bits."""
    top = floor_log2(step)
    mant = F.when(top > 11, shift_right(step, F.greatest(top - 11, F.lit(0)))).otherwise(shift_left(step, F.greatest(11 - top, F.lit(0))))
    return bits - (top - 13), mant.bitwiseAND(F.lit(0x7FF).cast("long"))


def weighted_error(error: Column, component: Column, level: Column, band: Column, plane: Column, step: Column, reversible: bool) -> Column:
    """What a coding pass takes off the weighted squared error, from the sum of its table's entries."""
    mct = F.element_at(F.array(*map(F.lit, RCT_NORMS if reversible else ICT_NORMS)), (component + 1).cast("int"))
    step = step if reversible else step / shift_left(F.lit(1), gain(band)).cast("double")
    w = mct * norm(level, band, reversible) * step * shift_left(F.lit(1), plane).cast("double")
    return w * (w * error.cast("double") / F.lit(8192.0))


def clamp_sample(v: Column, prec: Column, signed: Column) -> Column:
    """A sample in the bytes that its precision takes: one up to 8 bits, two up to 16; wider ones stay."""
    bits = F.when(prec <= 8, 8).otherwise(16)
    lo = F.when(signed, -shift_left(F.lit(1), bits - 1)).otherwise(F.lit(0))
    hi = F.when(signed, shift_left(F.lit(1), bits - 1) - 1).otherwise(shift_left(F.lit(1), bits) - 1)
    return F.when(prec > 16, long(v)).otherwise(clamp(v, lo, hi))


def abs32(v: Column) -> Column:
    """Magnitude in 32 bits: the least number has none and stays."""
    return F.when(long(v) == -(1 << 31), long(v)).otherwise(F.abs(long(v)))


def encode_rules(w: Column, h: Column, numres: Column, tdx: Column, tdy: Column) -> dict[str, Column]:
    """Checks of an encoder's settings; w, h: code-block size."""
    power = lambda v: (v > 0) & (v.bitwiseAND(v - 1) == 0)
    return {
        "resolutions": (numres >= 1) & (numres <= 33),
        "block_width": (w >= 4) & (w <= 1024) & power(w),
        "block_height": (h >= 4) & (h <= 1024) & power(h),
        "block_area": w * h <= 4096,
        "tile": (numres >= 1) & (numres <= 32) & (tdx >= shift_left(F.lit(1), F.greatest(numres - 1, F.lit(0)))) & (tdy >= shift_left(F.lit(1), F.greatest(numres - 1, F.lit(0)))),
    }


def profile_kind(rsiz: Column) -> dict[str, Column]:
    """What the capability field of a codestream claims."""
    return {"cinema": (rsiz >= 3) & (rsiz <= 6), "imf": (rsiz >= 0x400) & (rsiz <= (0x900 | 0x9B)), "part2": rsiz.bitwiseAND(F.lit(0x8000).cast("long")) != 0}


def uncovered(wanted: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `wanted` (keys, resno, compno, layno) that no progression change (keys, r0, r1, c0, c1, l1) reaches."""
    hit = wanted.join(changes, keys).where("resno >= r0 and resno < r1 and compno >= c0 and compno < c1 and layno < l1").select(*keys, "resno", "compno", "layno").distinct()
    return wanted.join(hit, [*keys, "resno", "compno", "layno"], "left_anti")


def colour_space(declared: Column, numcomps: Column, dx0: Column, dy0: Column, dx1: Column) -> Column:
    """The space that samples are read in: three components with narrow chroma are sYCC, one or two are gray."""
    return F.when((declared != "sycc") & (numcomps == 3) & (dx0 == dy0) & (dx1 != 1), "sycc").when(numcomps <= 2, "gray").otherwise(declared)


def colour_steps(space: Column, profile: Column) -> Column:
    """The conversions that follow, in order; profile: 'none', 'lab' or 'icc'."""
    first = F.when(space.isin("sycc", "cmyk", "eycc"), F.array(space)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(first, F.when(profile == "none", F.array().cast("array<string>")).otherwise(F.array(profile))), "+")


def invert(matrix: list[list[float]]) -> list[list[float]] | None:
    """The inverse in single precision by elimination with the largest pivot of each column; None if there is none."""
    a = np.array(matrix, np.float32)
    n = len(a)
    both = np.concatenate([a, np.eye(n, dtype=np.float32)], axis=1)
    for k in range(n):
        p = k + int(np.abs(both[k:, k]).argmax())
        if both[p, k] == 0:
            return None
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        for i in range(n):
            if i != k:
                both[i] -= both[i, k] * both[k]
    return both[:, n:].tolist()


#: Least bytes of a first layer; how far a layer lies above the one before, and what it gets if it does not; bytes of the
#: end marker, and of a further tile-part's header (fixed values).
FIRST, APART, ABOVE, END, PART = 30.0, 10.0, 20.0, 2.0, 14.0


def layer_budgets(tiles: DataFrame, layers: int, header: int) -> DataFrame:
    """(image_id, tileno, layno, bytes) of tiles (image_id, tileno, w, h, numcomps, prec, rates array<double>, and where they
    are: dx, dy, the first component's sub-sampling, and parts, the tile's tile-parts): what each layer may take. A rate of
    r asks for 1/r of the samples' bytes, less its share of the headers of the tile-parts after the first; the main header
    is shared out, and each budget lies ABOVE the one before if it is not APART from it. An ordered fold over the layers,
    as each depends on the one before."""
    share = F.lit(float(header)) / F.col("tiles")
    has = lambda name, default: F.col(name) if name in tiles.columns else F.lit(default)
    empty = 8.0 * has("dx", 1) * has("dy", 1)
    strides = (has("parts", 1) - 1) * PART / layers
    asked = F.transform("rates", lambda r: F.when(r > 0, F.col("numcomps") * F.col("prec") * F.col("w") * F.col("h") / (r * empty) - strides).otherwise(F.lit(0.0)))

    def step(acc: Column, x: Column) -> Column:
        k, v = F.size(acc), x["v"]
        last = F.when(k > 0, F.element_at(acc, -1)).otherwise(F.lit(0.0))
        less = v - share - F.when((k == layers - 1) & (k > 0), F.lit(END)).otherwise(F.lit(0.0))
        least = F.when(k == 0, F.greatest(less, F.lit(FIRST))).when(less < last + APART, last + ABOVE).otherwise(less)
        return F.concat(acc, F.array(F.when(v > 0, least).otherwise(v)))

    budgets = F.aggregate(F.transform(asked, lambda v: F.struct(v.alias("v"))), F.array().cast("array<double>"), step)
    return tiles.withColumn("tiles", F.count("*").over(Window.partitionBy("image_id"))).select("image_id", "tileno", F.posexplode(budgets).alias("layno", "bytes")).withColumn("layno", long("layno"))


def override(own: Column, default: Column) -> Column:
    """A component's own parameter where it has one, else the default."""
    return F.coalesce(own, default)


def fits_memory(w: Column, h: Column) -> Column:
    """Whether four bytes for each sample of a plane can be counted in 64 bits."""
    return (h == 0) | (w <= F.call_function("div", F.lit((1 << 62) - 1), F.greatest(h, F.lit(1).cast("long"))))


def overridden(levels: dict[str, Column]) -> tuple[Column, Column]:
    """The value of the first level that has one, and the name of this level; levels go from the narrowest to the widest."""
    names = [F.when(v.isNotNull(), F.lit(n)) for n, v in levels.items()]
    return F.coalesce(*levels.values()), F.coalesce(*names)
