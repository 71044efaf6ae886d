"""Portable maps, PGX and raw planes as binary columns, written and read by column expressions.

A reader gives array<struct<c, y, x, v>> of all samples: component, row, column, value; null for content that is cut, has no
samples or is of another kind. These are for small images as columns; raster_source reads files line by line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import bound, long, shift_left
from ..operators.settings import clamp_sample
from .headers import number

_SPACE = r"(?:\s|#[^\n]*\n)+"


def _digits(v: Column, size: Column) -> Column:
    """Hexadecimal digits of a number in `size` bytes; negative ones in two's complement."""
    masked = F.pmod(long(v), shift_left(F.lit(1), size * 8))
    return F.lpad(F.hex(masked), (size * 2).cast("int"), F.lit("0"))


def _placed(n: Column, w: Column, comps: Column, value) -> Column:
    """Samples of interleaved values: value(i) of the i-th; null without any."""
    pixel = lambda i: long((i - i % comps) / comps)
    return F.when((n > 0) & (w > 0), F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct((i % comps).alias("c"), long((pixel(i) - pixel(i) % w) / w).alias("y"), (pixel(i) % w).alias("x"), value(i).alias("v"))))


def pixmap(samples: Column, w: Column, h: Column, top: Column, comps: int, plain: bool) -> Column:
    """A P6 or P5 file (P3 or P2 if plain) of interleaved samples array<long>; two bytes each if top is over 255."""
    head = F.concat(F.lit({(3, False): "P6", (1, False): "P5", (3, True): "P3", (1, True): "P2"}[comps, plain] + "\n"), w.cast("string"), F.lit(" "), h.cast("string"), F.lit("\n"), top.cast("string"), F.lit("\n"))
    if plain:
        return F.concat(head, F.array_join(samples.cast("array<string>"), " "), F.lit("\n")).cast("binary")
    size = F.when(top > 255, F.lit(2)).otherwise(F.lit(1))
    return F.concat(head.cast("binary"), F.unhex(F.array_join(F.transform(samples, lambda v: _digits(v, size)), "")))


def read_pixmap(content: Column) -> Column:
    """Samples of a P2, P3, P5 or P6 file; comments in the header are skipped, null for other content."""
    text = F.decode(content, "ISO-8859-1")
    pattern = rf"(?s)\AP([2356]){_SPACE}(\d+){_SPACE}(\d+){_SPACE}(\d+)\s"
    head = F.length(F.regexp_extract(text, pattern, 0))
    kind = F.regexp_extract(text, pattern, 1)
    w, h, top = (F.regexp_extract(text, pattern, i).try_cast("long") for i in (2, 3, 4))
    comps = F.when(kind.isin("3", "6"), F.lit(3)).otherwise(F.lit(1)).cast("long")
    size = F.when(top > 255, F.lit(2)).otherwise(F.lit(1)).cast("long")
    plain = kind.isin("2", "3")
    words = F.when(plain, F.regexp_extract_all(F.substring(text, head + 1, F.length(text)), F.lit(r"(\d+)"), F.lit(1)))
    n = w * h * comps

    def samples(f: Column) -> Column:
        binary = lambda i: F.conv(F.hex(F.substring(content, (f["head"] + i * f["size"] + 1).cast("int"), f["size"].cast("int"))), 16, 10).cast("long")
        held = F.when(f["plain"], F.size(f["words"]) >= f["n"]).otherwise(F.octet_length(content) >= f["head"] + f["n"] * f["size"])
        return F.when(f["plain"] & held, _placed(f["n"], f["w"], f["comps"], lambda i: F.get(f["words"], i.cast("int")).cast("long"))).when((f["kind"] != "") & held, _placed(f["n"], f["w"], f["comps"], binary))

    fields = {"head": head, "kind": kind, "w": w, "n": n, "comps": comps, "size": size, "plain": plain, "words": words}
    return bound(F.struct(*(v.alias(k) for k, v in fields.items())), samples)


def pgx(samples: Column, w: Column, h: Column, prec: Column, signed: Column) -> Column:
    """One component, high bytes first; samples are held to the bytes that the precision takes."""
    head = F.concat(F.lit("PG ML "), F.when(signed, "-").otherwise("+"), F.lit(" "), prec.cast("string"), F.lit(" "), w.cast("string"), F.lit(" "), h.cast("string"), F.lit("\n"))
    size = F.when(prec <= 8, F.lit(1)).when(prec <= 16, F.lit(2)).otherwise(F.lit(4))
    return F.concat(head.cast("binary"), F.unhex(F.array_join(F.transform(samples, lambda v: _digits(clamp_sample(v, prec, signed), size)), "")))


def read_pgx(content: Column) -> Column:
    """Samples of a PGX file in either byte order, with or without a space after the sign; null for other content."""
    text = F.decode(content, "ISO-8859-1")
    pattern = r"(?s)\APG\s+(ML|LM)\s+([+-]?)\s*(\d+)\s+(\d+)\s+(\d+)\s*?\n"
    head = F.length(F.regexp_extract(text, pattern, 0))
    low_first, signed = F.regexp_extract(text, pattern, 1) == "LM", F.regexp_extract(text, pattern, 2) == "-"
    prec, w, h = (F.regexp_extract(text, pattern, i).try_cast("long") for i in (3, 4, 5))
    size = F.when(prec <= 8, F.lit(1)).when(prec <= 16, F.lit(2)).otherwise(F.lit(4)).cast("long")

    def samples(f: Column) -> Column:
        size = f["size"]

        def value(i: Column) -> Column:
            digits = F.hex(F.substring(content, (f["head"] + i * size + 1).cast("int"), size.cast("int")))
            turned = F.concat(*(F.substring(digits, k, 2) for k in (7, 5, 3, 1)))
            v = F.conv(F.when(f["low_first"], turned).otherwise(digits), 16, 10).cast("long")
            return F.when(f["signed"] & (v >= shift_left(F.lit(1), size * 8 - 1)), v - shift_left(F.lit(1), size * 8)).otherwise(v)

        return F.when((f["head"] > 0) & (F.octet_length(content) >= f["head"] + f["n"] * size), _placed(f["n"], f["w"], F.lit(1).cast("long"), value))

    fields = {"head": head, "low_first": low_first, "signed": signed, "w": w, "n": w * h, "size": size}
    return bound(F.struct(*(v.alias(k) for k, v in fields.items())), samples)


def raw_samples(samples: Column, prec: Column, low_first: bool) -> Column:
    """Samples without a header: one byte each up to 8 bits, else two in either order."""
    size = F.when(prec <= 8, F.lit(1)).otherwise(F.lit(2))
    turned = lambda d: F.concat(F.substring(d, 3, 2), F.substring(d, 1, 2)) if low_first else d
    return F.unhex(F.array_join(F.transform(samples, lambda v: turned(_digits(v.bitwiseAND(shift_left(F.lit(1), prec) - 1), size))), ""))


def read_raw_samples(content: Column, w: Column, prec: Column, signed: Column, low_first: bool) -> Column:
    size = F.when(prec <= 8, F.lit(1)).otherwise(F.lit(2)).cast("long")

    def value(i: Column) -> Column:
        first, second = number(content, i * size, 1), number(content, i * size + 1, 1)
        v = F.when(size == 1, first).otherwise(first + 256 * second if low_first else 256 * first + second)
        return F.when(signed & (v >= shift_left(F.lit(1), prec - 1)), v - shift_left(F.lit(1), prec)).otherwise(v)

    return _placed(long(F.octet_length(content) / size), w, F.lit(1).cast("long"), value)


def needed_bits(samples: Column) -> Column:
    """Bits that the largest sample takes: the precision that a reader of PGX settles on."""
    top = F.greatest(F.array_max(F.transform(samples, lambda s: s["v"])), F.lit(0))
    return F.when(top <= 1, F.lit(1)).otherwise(F.length(F.bin(top))).cast("long")


def matrix_of(text: Column) -> Column:
    """struct<n, matrix, offsets> of a file of n * n + n numbers between white space or commas, null if they are not so
    many."""
    cells = F.transform(F.filter(F.split(text, r"[\s,]+"), lambda s: s != ""), lambda s: s.cast("double"))
    n = F.floor((F.sqrt(4.0 * F.size(cells) + 1.0) - 1.0) / 2.0).cast("long")
    whole = F.struct(n.alias("n"), F.slice(cells, F.lit(1), (n * n).cast("int")).alias("matrix"), F.slice(cells, (n * n + 1).cast("int"), n.cast("int")).alias("offsets"))
    return F.when((n > 0) & (n * n + n == F.size(cells)), whole)
