"""Packed packet headers: fragments of one or of all tile-parts' headers, kept in marker segments that are ordered by a number.

A fragment's number has one byte and its length two, so a header has 256 fragments and 16 MB at most: they are gathered in
a row. The runs of the main header's fragments, a length and as many bytes, go on over the ends of fragments; a length
itself does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .headers import marker
from .markers import one

#: Marker codes of fragments in the main header and in a tile-part's (fixed values of the format).
PPM, PPT = "FF60", "FF61"

RUNS = StructType([StructField("error", StringType()), StructField("runs", ArrayType(StructType([StructField("off", LongType()), StructField("data", BinaryType())])))])


def fragment(code: str, number: Column, data: Column) -> Column:
    return marker(code, one(number), data)


def fragments(found: DataFrame, keys: list[str], code: str) -> DataFrame:
    """(keys, error, parts): the fragments of `found` (keys, content, segment s) in the order of their numbers; parts is
    null where a number comes twice."""
    s = F.col("s")
    mine = found.where(F.col("s.code") == code).select(*keys, F.conv(F.hex(F.substring("content", (s["off"] + 5).cast("int"), F.lit(1))), 16, 10).cast("long").alias("z"), F.substring("content", (s["off"] + 6).cast("int"), (s["len"] - 3).cast("int")).alias("data"))
    per = mine.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("z", "data"))).alias("f"), F.count_distinct("z").alias("n"))
    twice = F.col("n") < F.size("f")
    return per.select(*keys, F.when(twice, "number twice").alias("error"), F.when(~twice, F.transform("f", lambda f: f["data"])).alias("parts"))


def _spliced(parts):
    if parts is None:
        return None
    out, left, at = [], 0, 0
    for raw in parts:
        pos = 0
        while pos < len(raw):
            if not left:
                if len(raw) - pos < 4:
                    return "length cut", None
                left = int.from_bytes(raw[pos : pos + 4], "big")
                pos += 4
                out.append((at + pos, []))
                if not left:
                    continue
            take = raw[pos : pos + left]
            out[-1][1].append(take)
            left -= len(take)
            pos += len(take)
        at += len(raw)
    return ("bytes missing", None) if left else (None, [(off, b"".join(data)) for off, data in out])


_runs = F.udf(_spliced, RUNS, useArrow=True)


def runs(parts: Column) -> Column:
    """struct<error, runs array<struct<off, data>>> of the main header's fragments: one run for each tile-part in the
    codestream's order; off: of its bytes in all fragments laid together."""
    return _runs(parts)


def whole(parts: Column) -> Column:
    """A tile's fragments laid together."""
    return F.aggregate(parts, F.unhex(F.lit("")), lambda a, p: F.concat(a, p))
