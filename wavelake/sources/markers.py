"""Fields of marker segments and boxes as binary column expressions, and the segments written from columns.

Offsets are 0-based; a segment is the struct of headers.segments() or headers.boxes(). Component numbers take one byte, or as many as a reader is
told (checks.component_bytes()).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import long, shift_right
from .headers import bytes_of, joined, marker, number, raw

#: Marker codes (fixed values of the format).
COC, RGN, QCC, POC, TLM, PLM, PLT, CRG, COM, CAP, CPF = "FF53", "FF5E", "FF5D", "FF5F", "FF55", "FF57", "FF58", "FF63", "FF64", "FF50", "FF59"
SOD, EOC = "FF93", "FFD9"
#: Segments that a reader may pass over.
SKIPPED = (TLM, PLM, PLT, CRG, COM, CAP, CPF)


def of_code(segments: Column, code: str) -> Column:
    return F.filter(segments, lambda s: s["code"] == code)


def of_type(boxes: Column, kind: str) -> Column:
    """The first box of a type."""
    return F.get(F.filter(boxes, lambda b: b["type"] == kind), F.lit(0))


def _list(content: Column, at: Column, n: Column, size: int | Column, make) -> Column:
    """make(offset) of each of n records of `size` bytes."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: make(at + i * size))).otherwise(F.array())


# --- coding style and quantisation --------------------------------------------------------------------------------


def coding_style(content: Column, at: Column, custom: Column) -> dict[str, Column]:
    """Fields of the style that COD and COC share, at its first byte; custom: whether precinct sizes follow."""
    levels = number(content, at, 1)
    sizes = F.when(custom, F.transform(F.sequence(F.lit(0).cast("long"), levels), lambda r: number(content, at + 5 + r, 1))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), levels), lambda r: F.lit(0xFF).cast("long")))
    return {
        "numres": levels + 1,
        "cblkw": number(content, at + 1, 1) + 2,
        "cblkh": number(content, at + 2, 1) + 2,
        "style": number(content, at + 3, 1),
        "reversible": number(content, at + 4, 1) == 1,
        "precincts": F.array_join(F.transform(sizes, lambda b: F.concat((b % 16).cast("string"), F.lit("x"), shift_right(b, 4).cast("string"))), ","),
    }


def cod(content: Column, s: Column) -> dict[str, Column]:
    at = s["off"] + 4
    flags = number(content, at, 1)
    return {"progression": number(content, at + 1, 1), "layers": number(content, at + 2, 2), "mct": number(content, at + 4, 1), **coding_style(content, at + 5, flags % 2 == 1)}


def coc(content: Column, s: Column, wide: Column | int = 1) -> dict[str, Column]:
    """A component's style; wide: bytes of its number, here and below."""
    at = s["off"] + 4
    return {"compno": number(content, at, wide), **coding_style(content, at + wide + 1, number(content, at + wide, 1) % 2 == 1)}


def qcc(content: Column, s: Column, wide: Column | int = 1) -> dict[str, Column]:
    at = s["off"] + 4
    return {"compno": number(content, at, wide), **quantisation(content, at + wide, s["len"] - 2 - wide)}


def quantisation(content: Column, at: Column, size: Column) -> dict[str, Column]:
    """Style, guard bits and (exponent:mantissa) of each band; size: bytes from the style byte on. A derived style gives
    one step, the exponents of the others fall by one with each resolution."""
    flags = number(content, at, 1)
    style = flags % 32
    plain = lambda p: F.struct(shift_right(number(content, p, 1), 3).alias("e"), F.lit(0).cast("long").alias("m"))
    full = lambda p: F.struct(shift_right(number(content, p, 2), 11).alias("e"), (number(content, p, 2) % 2048).alias("m"))
    steps = F.when(style == 0, _list(content, at + 1, size - 1, 1, plain)).otherwise(_list(content, at + 1, long((size - 1 - (size - 1) % 2) / 2), 2, full))
    return {"style": style, "guard": shift_right(flags, 5), "steps": steps}


def derived(steps: Column, style: Column, bands: Column) -> Column:
    """Steps of all bands: as they are, or worked out from the first."""
    first = F.get(steps, F.lit(0))
    rest = F.transform(F.sequence(F.lit(0).cast("long"), bands - 1), lambda b: F.struct(F.when(b == 0, first["e"]).otherwise(F.greatest(F.lit(0).cast("long"), first["e"] - long((b - 1 - (b - 1) % 3) / 3))).alias("e"), first["m"].alias("m")))
    return F.when(style == 1, rest).otherwise(steps)


def shown(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s: F.concat(s["e"].cast("string"), F.lit(":"), s["m"].cast("string"))), ",")


def rgn(content: Column, s: Column, wide: Column | int = 1) -> Column:
    at = s["off"] + 4
    return F.struct(number(content, at, wide).alias("compno"), number(content, at + wide + 1, 1).alias("shift"))


def poc(content: Column, s: Column, wide: Column | int = 1) -> Column:
    """array of progression changes of a segment."""
    size = 5 + 2 * wide
    n = long((s["len"] - 2 - (s["len"] - 2) % size) / size)
    field = lambda p, k, bytes_: number(content, p + k, bytes_)
    return _list(content, s["off"] + 4, n, size, lambda p: F.struct(field(p, 0, 1).alias("r0"), field(p, 1, wide).alias("c0"), field(p, 1 + wide, 2).alias("l1"), field(p, 3 + wide, 1).alias("r1"), field(p, 4 + wide, wide).alias("c1"), field(p, 4 + 2 * wide, 1).alias("progression")))


# --- writing ------------------------------------------------------------------------------------------------------


def one(v: Column) -> Column:
    return bytes_of(v, 1)


def style_bytes(numres: Column, cblkw: Column, cblkh: Column, reversible: Column, pdx: Column, pdy: Column) -> Column:
    sizes = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), numres), lambda r: F.lpad(F.hex(long(pdx + 16 * pdy)), 2, "0")), ""))
    return joined(one(numres - 1), one(cblkw - 2), one(cblkh - 2), raw("00"), one(long(reversible)), sizes)


def tlm(parts: Column) -> Column:
    """Lengths of tile-parts array<struct<tileno, len>>: numbers of one byte, or of two where a tile has a higher one,
    lengths of four."""
    wide = F.exists(parts, lambda p: p["tileno"] > 255)
    rows = F.array_join(F.transform(parts, lambda p: F.concat(F.lpad(F.hex(p["tileno"]), F.when(wide, 4).otherwise(2), F.lit("0")), F.lpad(F.hex(p["len"]), 8, "0"))), "")
    return marker(TLM, raw("00"), F.when(wide, raw("60")).otherwise(raw("50")), F.unhex(rows))  # how wide (fixed values)


def varint(v: Column) -> Column:
    """Hexadecimal digits of a packet length: seven bits a byte, high ones first, the top bit set on all but the last."""
    part = lambda k: shift_right(v, 7 * k) % 128
    two = lambda x: F.lpad(F.hex(long(x)), 2, "0")
    return F.concat(*(F.when(v >= (1 << 7 * k), two(128 + part(k))).otherwise(F.lit("")) for k in (4, 3, 2, 1)), two(part(0)))


def tile_part(tileno: Column, part: Column, parts: Column, data: Column) -> Column:
    return joined(raw("FF90000A"), bytes_of(tileno, 2), bytes_of(F.octet_length(data) + 14, 4), one(part), one(parts), raw(SOD), data)


# --- boxes --------------------------------------------------------------------------------------------------------


def ihdr(content: Column, b: Column) -> dict[str, Column]:
    at = b["off"] + 8
    return {"h": number(content, at, 4), "w": number(content, at + 4, 4), "nc": number(content, at + 8, 2), "bpc": number(content, at + 10, 1), "c": number(content, at + 11, 1), "unk": number(content, at + 12, 1), "ipr": number(content, at + 13, 1)}


def bpcc(content: Column, b: Column) -> Column:
    """Bits of each component; signed ones below zero."""
    return _list(content, b["off"] + 8, b["len"] - 8, 1, lambda p: (number(content, p, 1) % 128 + 1) * F.when(number(content, p, 1) >= 128, -1).otherwise(1))


def colr(content: Column, b: Column) -> dict[str, Column]:
    at = b["off"] + 8
    return {"method": number(content, at, 1), "precedence": number(content, at + 1, 1), "approx": number(content, at + 2, 1), "enumcs": F.when(number(content, at, 1) == 1, number(content, at + 3, 4)), "profile": F.when(number(content, at, 1) == 2, b["len"] - 11)}


def pclr(content: Column, b: Column) -> Column:
    """array<struct<entry, col, value>> of a palette of entries of one byte or two in each column."""
    at = b["off"] + 8
    n, cols = number(content, at, 2), number(content, at + 2, 1)
    size = F.transform(F.sequence(F.lit(0).cast("long"), cols - 1), lambda c: F.when(number(content, at + 3 + c, 1) % 128 >= 8, F.lit(2)).otherwise(F.lit(1)).cast("long"))
    width = F.aggregate(size, F.lit(0).cast("long"), lambda a, x: a + x)
    before = lambda c: F.aggregate(F.slice(size, F.lit(1), c.cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)

    def cell(i: Column) -> Column:
        entry, c = long((i - i % cols) / cols), i % cols
        p = at + 3 + cols + entry * width + before(c)
        return F.struct(entry.alias("entry"), c.alias("col"), F.when(F.get(size, c.cast("int")) == 2, number(content, p, 2)).otherwise(number(content, p, 1)).alias("value"))

    return F.when(n * cols > 0, F.transform(F.sequence(F.lit(0).cast("long"), n * cols - 1), cell))


def cmap(content: Column, b: Column) -> Column:
    return _list(content, b["off"] + 8, long((b["len"] - 8) / 4), 4, lambda p: F.struct(number(content, p, 2).alias("cmp"), number(content, p + 2, 1).alias("mtyp"), number(content, p + 3, 1).alias("pcol")))


def cdef(content: Column, b: Column) -> Column:
    return _list(content, b["off"] + 10, number(content, b["off"] + 8, 2), 6, lambda p: F.struct(number(content, p, 2).alias("cn"), number(content, p + 2, 2).alias("typ"), number(content, p + 4, 2).alias("asoc")))


# --- transforms of several components -----------------------------------------------------------------------------

#: Marker codes of the extended transforms, and bytes of their elements by type (fixed values of the format).
MCT, MCC, MCO, CBD = "FF74", "FF75", "FF77", "FF78"
ELEMENTS = (2, 4, 4, 8)


def mct_bytes(index: Column, kind: int, values: Column) -> Column:
    """An array of whole numbers in four bytes; kind: 1 a matrix, 2 offsets."""
    digits = F.array_join(F.transform(values, lambda v: F.lpad(F.hex(F.pmod(long(v), F.lit(1 << 32))), 8, "0")), "")
    return marker(MCT, raw("0000"), bytes_of(index + 256 * kind + 1024, 2), raw("0000"), F.unhex(digits))


def mcc_bytes(index: Column, n: Column, matrix: Column, offsets: Column, reversible: Column) -> Column:
    """One collection of components 0..n-1 that go through the matrix and offsets of these indices."""
    names = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return marker(MCC, raw("0000"), one(index), raw("0000000101"), bytes_of(n, 2), names, bytes_of(n, 2), names, one(long(reversible)), one(offsets), one(matrix))


def mco_bytes(index: Column) -> Column:
    return marker(MCO, raw("01"), one(index))


def cbd_bytes(bits: Column, signed: Column, n: Column) -> Column:
    each = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda c: F.lpad(F.hex(long(bits + c - 1 + F.when(signed, 128).otherwise(0))), 2, "0")), "")
    return marker(CBD, bytes_of(n, 2), F.unhex(each))


def mcc(content: Column, s: Column) -> dict[str, Column]:
    at = s["off"] + 4
    n = number(content, at + 8, 2)
    tail = at + 10 + n + 2 + n
    return {"index": number(content, at + 2, 1), "collections": number(content, at + 5, 2), "n": n, "reversible": number(content, tail, 1) == 1, "offsets": number(content, tail + 1, 1), "matrix": number(content, tail + 2, 1)}


def cbd(content: Column, s: Column) -> Column:
    """Bits of each component; signed ones below zero."""
    at = s["off"] + 4
    return _list(content, at + 2, number(content, at, 2), 1, lambda p: (number(content, p, 1) % 128 + 1) * F.when(number(content, p, 1) >= 128, -1).otherwise(1))
