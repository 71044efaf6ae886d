"""Reading and writing the headers of codestreams and boxed files, and portable graymaps, as binary column expressions.

Numbers are big-endian. Nothing here looks at sample data but the graymap and raw readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import long, shift_right
from .walks import SIGNATURE, SOC, SOT, boxes, segments, tile_parts  # noqa: F401

#: Markers (fixed values of the format).
SIZ, COD, QCD = "FF51", "FF52", "FF5C"


# --- bytes --------------------------------------------------------------------------------------------------------


def number(content: Column, at: Column | int, size: int | Column) -> Column:
    """The unsigned number of `size` bytes at 0-based offset `at`."""
    return F.conv(F.hex(F.substring(content, F.lit(at) + 1 if isinstance(at, int) else (at + 1).cast("int"), F.lit(size))), 16, 10).cast("long")


def bytes_of(value: Column, size: int) -> Column:
    """The number as `size` bytes."""
    return F.unhex(F.lpad(F.hex(long(value)), 2 * size, "0"))


def raw(text: str) -> Column:
    return F.unhex(F.lit(text))


def joined(*parts: Column) -> Column:
    return F.concat(*parts)


def marker(code: str, *parts: Column) -> Column:
    """A marker segment: code, length of what follows with the length's own two bytes, parts."""
    body = joined(*parts)
    return joined(raw(code), bytes_of(F.octet_length(body) + 2, 2), body)


def box(kind: str, *parts: Column) -> Column:
    body = joined(*parts)
    return joined(bytes_of(F.octet_length(body) + 8, 4), F.lit(kind).cast("binary"), body)


# --- writing ------------------------------------------------------------------------------------------------------


def codestream_header(g: DataFrame) -> Column:
    """Main header of images as in the geometry relation: SOC, SIZ, COD and QCD up to the first SOT."""
    two = lambda v: F.lpad(F.hex(long(v)), 2, "0")
    comps = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("numcomps") - 1), lambda c: F.concat(two(F.col("prec") - 1), two(F.when(c == 0, F.lit(1)).otherwise(F.col("dx"))), two(F.when(c == 0, F.lit(1)).otherwise(F.col("dy"))))), ""))
    siz = marker(SIZ, bytes_of(F.lit(0), 2), *(bytes_of(F.col(c), 4) for c in ("x1", "y1", "x0", "y0", "tdx", "tdy", "tx0", "ty0")), bytes_of(F.col("numcomps"), 2), comps)
    cod = marker(COD, raw("00"), raw("02"), bytes_of(F.col("nlayers"), 2), raw("01"), bytes_of(F.col("numres") - 1, 1), bytes_of(F.col("cblkw") - 2, 1), bytes_of(F.col("cblkh") - 2, 1), raw("00"), raw("01"))
    qcd = marker(QCD, raw("40"), F.unhex(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), 3 * (F.col("numres") - 1)), lambda b: two((F.col("prec") + b % 3) * 8)), "")))
    return joined(raw(SOC), siz, cod, qcd, raw(SOT))


def boxed_header(stream: Column, g_prec: Column) -> Column:
    """Signature, file type, image header with one colour box, and the codestream."""
    ihdr = box("ihdr", bytes_of(F.col("y1") - F.col("y0"), 4), bytes_of(F.col("x1") - F.col("x0"), 4), bytes_of(F.col("numcomps"), 2), bytes_of(g_prec - 1, 1), raw("070000"))
    colr = box("colr", raw("010000"), bytes_of(F.when(F.col("numcomps") < 3, F.lit(17)).otherwise(F.lit(16)), 4))
    return joined(raw(SIGNATURE), box("ftyp", F.lit("jp2 ").cast("binary"), raw("00000000"), F.lit("jp2 ").cast("binary")), box("jp2h", ihdr, colr), box("jp2c", stream))


# --- reading ------------------------------------------------------------------------------------------------------


def sniff(content: Column) -> Column:
    """`jp2`, `j2k` or `unknown` by the first bytes."""
    h = F.hex(F.substring(content, 1, 12))
    return F.when((h == SIGNATURE) | (h.substr(9, 8) == "6A502020"), "jp2").when(h.startswith(SOC), "j2k").otherwise("unknown")


def siz_fields(content: Column, seg: Column) -> list[Column]:
    """Geometry fields of a SIZ segment."""
    at = seg["off"] + 6
    names = ("x1", "y1", "x0", "y0", "tdx", "tdy", "tx0", "ty0")
    return [number(content, at + 4 * i, 4).alias(n) for i, n in enumerate(names)] + [number(content, at + 32, 2).alias("numcomps"), (number(content, at + 34, 1) + 1).alias("prec")]


# --- graymaps and raw planes --------------------------------------------------------------------------------------


def graymap(rows: Column) -> Column:
    """An 8-bit binary graymap (P5) of a plane held as rows."""
    flat = F.flatten(rows)
    head = F.concat(F.lit("P5\n"), F.size(rows[0]).cast("string"), F.lit(" "), F.size(rows).cast("string"), F.lit("\n255\n"))
    return joined(head.cast("binary"), F.unhex(F.array_join(F.transform(flat, lambda v: F.lpad(F.hex(v), 2, "0")), "")))


def read_graymap(content: Column) -> Column:
    """array<struct<y, x, v>> of an 8- or 16-bit binary graymap; comments in the header are skipped."""
    text = F.decode(content, "ISO-8859-1")
    pattern = r"(?s)^P5(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s"
    head = F.length(F.regexp_extract(text, pattern, 0))
    w, h, top = (F.regexp_extract(text, pattern, i).try_cast("long") for i in (1, 2, 3))
    size = F.when(top > 255, F.lit(2)).otherwise(F.lit(1))
    value = lambda i: F.conv(F.hex(F.substring(content, (head + i * size + 1).cast("int"), size)), 16, 10).cast("long")
    held = (w > 0) & (h > 0) & (F.octet_length(content) >= head + w * h * size)  # else null
    return F.when(held, F.transform(F.sequence(F.lit(0).cast("long"), w * h - 1), lambda i: F.struct(((i - i % w) / w).cast("long").alias("y"), (i % w).alias("x"), value(i).alias("v"))))


def raw_plane(rows: Column, prec: int) -> Column:
    """Samples one after the other, two bytes each, the low one first, in the low `prec` bits."""
    masked = lambda v: v.bitwiseAND(F.lit((1 << prec) - 1).cast("long"))
    two = lambda v: F.concat(F.lpad(F.hex(masked(v) % 256), 2, "0"), F.lpad(F.hex(shift_right(masked(v), 8)), 2, "0"))
    return F.unhex(F.array_join(F.transform(F.flatten(rows), two), ""))


def read_raw(content: Column, w: int, prec: int, signed: bool) -> Column:
    """array<struct<y, x, v>> of raw_plane()."""
    n = F.octet_length(content) / 2

    def value(i: Column) -> Column:
        v = number(content, i * 2, 1) + 256 * number(content, i * 2 + 1, 1)
        return F.when(v >= 1 << prec - 1, v - (1 << prec)).otherwise(v) if signed else v

    return F.when(n >= 1, F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.struct(((i - i % w) / w).cast("long").alias("y"), (i % w).alias("x"), value(i).alias("v"))))
