"""Option strings of the command-line style as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pairs(text: Column) -> Column:
    """array<struct<w, h>> of `[w,h],[w,h],...`, the form of precinct lists and tile sizes."""
    found = F.regexp_extract_all(text, F.lit(r"\[\s*(\d+)\s*,\s*\d+\s*\]"), F.lit(1))
    other = F.regexp_extract_all(text, F.lit(r"\[\s*\d+\s*,\s*(\d+)\s*\]"), F.lit(1))
    return F.transform(F.arrays_zip(found.alias("w"), other.alias("h")), lambda p: F.struct(p["w"].cast("long").alias("w"), p["h"].cast("long").alias("h")))


def numbers(text: Column) -> Column:
    """array<double> of numbers between commas, the form of rates and qualities."""
    return F.transform(F.filter(F.split(text, r"\s*,\s*"), lambda s: s != ""), lambda s: s.cast("double"))


def raw_geometry(text: Column) -> list[Column]:
    """width, height, components, depth, signed and sampling of `w,h,n,depth,{s or u}[@dx x dy:...]`."""
    head = F.split(F.split(text, "@")[0], ",")
    steps = F.when(F.instr(text, "@") > 0, F.split(F.regexp_extract(text, "@(.*)", 1), ":")).otherwise(F.array().cast("array<string>"))
    sampling = F.transform(steps, lambda s: F.struct(F.split(s, "x")[0].cast("long").alias("dx"), F.split(s, "x")[1].cast("long").alias("dy")))
    whole = [F.get(head, F.lit(i)).cast("long").alias(n) for i, n in enumerate(("w", "h", "n", "depth"))]
    return [*whole, (F.get(head, F.lit(4)) == "s").alias("signed"), sampling.alias("sampling")]
