"""What a reader checks of a main header before it trusts it: all fields of the size segment, their limits, and which
segments must be there and where."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import ceil_div, shift_right
from .headers import COD, QCD, SIZ, SOC, SOT, number

#: Limits of the format and of readers (fixed values).
COMPONENTS, TILES, BITS, TOP = 16384, 65535, 31, 0xFFFFFFFF


def components(content: Column, s: Column) -> Column:
    """array<struct<compno, prec, signed, dx, dy>> of all components that a size segment has parameters for."""
    n = ((s["len"] - 38 - (s["len"] - 38) % 3) / 3).cast("int")
    at = lambda i: s["off"] + 40 + 3 * i.cast("long")
    # the three bytes of a component are read once; those that are cut off are null
    held = lambda i: F.hex(F.substring(content, (at(i) + 1).cast("int"), 3))
    read = lambda i: F.struct(i.alias("i"), F.conv(F.rpad(held(i), 6, "0"), 16, 10).cast("long").alias("v"), (F.octet_length(content) - at(i)).alias("left"))
    byte = lambda r, k: F.when(r["left"] > k, shift_right(r["v"], 16 - 8 * k) % 256)
    field = lambda r: F.struct(r["i"].cast("long").alias("compno"), (byte(r, 0) % 128 + 1).alias("prec"), (byte(r, 0) >= 128).alias("signed"), byte(r, 1).alias("dx"), byte(r, 2).alias("dy"))
    return F.transform(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), read), field)


def component_bytes(content: Column, siz: Column) -> Column:
    """Bytes that a component's number takes in other segments: two where there are over 256 components."""
    return F.when(number(content, siz["off"] + 38, 2) > 256, F.lit(2)).otherwise(F.lit(1))


def size_error(content: Column, s: Column, ihdr: tuple[Column, Column] | None = None) -> Column:
    """What is first wrong with a size segment, null if nothing is; ihdr: width and height that a box has told."""
    names = ("x1", "y1", "x0", "y0", "tdx", "tdy", "tx0", "ty0")
    v = {n: number(content, s["off"] + 6 + 4 * i, 4) for i, n in enumerate(names)}
    told, comps = number(content, s["off"] + 38, 2), components(content, s)
    ends = lambda a: F.least(v[f"t{a}0"] + v[f"td{a}"], F.lit(TOP).cast("long"))
    outside = (v["tx0"] > v["x0"]) | (v["ty0"] > v["y0"]) | (ends("x") <= v["x0"]) | (ends("y") <= v["y0"])
    many = lambda a: ceil_div(v[f"{a}1"] - v[f"t{a}0"], F.greatest(v[f"td{a}"], F.lit(1).cast("long")))
    checks = [
        ((s["len"] < 38) | ((s["len"] - 38) % 3 != 0), "length"),
        (told > COMPONENTS, "number of components"),
        (told != F.size(comps), "components and parameters"),
        ((v["x0"] >= v["x1"]) | (v["y0"] >= v["y1"]), "image size"),
        ((v["tdx"] == 0) | (v["tdy"] == 0), "tile size"),
        (outside, "tile offset"),
    ]
    if ihdr is not None:
        checks.append(((ihdr[0] > 0) & (ihdr[1] > 0) & ((ihdr[0] != v["x1"] - v["x0"]) | (ihdr[1] != v["y1"] - v["y0"])), "header box"))
    # components are checked in their order, sub-sampling first
    wrong = F.get(F.filter(F.transform(comps, lambda c: F.when((c["dx"] == 0) | (c["dy"] == 0), "sub-sampling").when(c["prec"] > BITS, "precision")), lambda t: t.isNotNull()), F.lit(0))
    out = None
    for bad, text in checks:
        out = F.when(bad, text) if out is None else out.when(bad, text)
    return out.when(wrong.isNotNull(), wrong).when(many("x") * many("y") > TILES, "number of tiles")


def header_error(content: Column, found: Column) -> Column:
    """What is first wrong with a main header of segments `found`, null if nothing is: how it begins and ends, where its
    size segment lies, what is missing, and the size segment's fields."""
    last = F.element_at(found, F.size(found))
    end = F.when(F.size(found) > 0, last["off"] + last["len"] + 2).otherwise(F.lit(2).cast("long"))
    at_end = F.hex(F.substring(content, (end + 1).cast("int"), F.lit(2)))
    first = F.get(found, F.lit(0))
    has = lambda code: F.exists(found, lambda s: s["code"] == code)
    sizes = F.size(F.filter(found, lambda s: s["code"] == SIZ))
    return (
        F.when(content.isNull() | ~F.coalesce(F.hex(F.substring(content, 1, 2)) == SOC, F.lit(False)), "no start")
        .when((F.size(found) > 0) & ((first["code"] != SIZ) | (sizes > 1)), "position")
        .when((F.size(found) > 0) & size_error(content, first).isNotNull(), F.concat(F.lit("SIZ: "), size_error(content, first)))
        .when(F.length(at_end) < 4, "too short")
        .when(~at_end.startswith("FF"), "no marker")
        .when(at_end != SOT, "length of a segment")
        .when(~has(SIZ), "SIZ is missing")
        .when(~has(COD), "COD is missing")
        .when(~has(QCD), "QCD is missing")
    )
