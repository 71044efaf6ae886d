"""Walks over marker segments, boxes and tile-parts, each step of which says where the next begins.

A walk reads the few bytes of each step, so it costs the number of its elements and not the length of the content. It comes
as a column function that gives an array, for headers, and as a table function for lateral joins, for content of many
parts: `files.lateralJoin(TilePartRows(F.col("content").outer()))` gives a row for each part without an array of them all.
Null content has no elements; content that is cut or damaged ends its walk.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

#: Signature of boxed files and markers that a walk looks for (fixed values of the formats).
SIGNATURE = "0000000C6A5020200D0A870A"
SOC, SOT, SOD = "FF4F", "FF90", "FF93"

_LONGS = lambda *names: [StructField(n, LongType()) for n in names]
SEGMENT = StructType([*_LONGS("off"), StructField("code", StringType()), *_LONGS("len")])
BOX = StructType([*_LONGS("off", "len"), StructField("type", StringType())])
PART = StructType(_LONGS("off", "tileno", "part", "parts", "len"))
PART_DATA = StructType([*PART.fields, StructField("data", BinaryType())])


def _number(buf: memoryview, at: int, size: int) -> int | None:
    """The unsigned number of what is left of `size` bytes, None of nothing."""
    part = bytes(buf[at : at + size])
    return int.from_bytes(part, "big") if part else None


def walk_segments(content: bytes | None) -> Iterator[tuple[int, str, int]]:
    """(off, code, len) of the marker segments of a main header, up to the first SOT."""
    buf, at = memoryview(content or b""), 2
    while at + 2 < len(buf):
        code, size = bytes(buf[at : at + 2]).hex().upper(), _number(buf, at + 2, 2)
        if not code.startswith("FF") or code == SOT or size < 2:
            return
        yield at, code, size
        at += 2 + size


def walk_boxes(content: bytes | None, at: int | None, end: int | None) -> Iterator[tuple[int, int, str]]:
    """(off, len, type) of the boxes between two offsets; length 0 reaches to the end, 1 has 64 bits. A box that does not
    fit ends the walk."""
    if content is None or at is None or end is None:
        return
    buf = memoryview(content)
    while at + 8 <= min(end, len(buf)):
        size, kind = struct.unpack_from(">I4s", buf, at)
        if size == 1:
            size = _number(buf, at + 8, 8) or 0
        size = size or end - at
        if size < 8 or at + size > end:
            return
        yield at, size, kind.decode("latin-1")
        at += size


def walk_tile_parts(content: bytes | None) -> Iterator[tuple[int, int, int | None, int | None, int]]:
    """(off, tileno, part, parts, len) of the tile-parts of a codestream, from the first SOT to its end. A part of length 0
    reaches to the end of the codestream; numbers that are cut off are null."""
    buf, at = memoryview(content or b""), 2
    for off, _, size in walk_segments(content):
        at = off + size + 2
    while bytes(buf[at : at + 2]).hex().upper() == SOT:
        size = _number(buf, at + 6, 4)
        if size is None or size != 0 and size < 14:
            return
        size = size or len(buf) - at
        if size < 14:
            return
        yield at, _number(buf, at + 4, 2), _number(buf, at + 10, 1), _number(buf, at + 11, 1), size
        at += size


@F.udf(returnType=ArrayType(SEGMENT), useArrow=True)
def segments(content):
    """array<struct<off, code, len>> of walk_segments()."""
    return list(walk_segments(content))


@F.udf(returnType=ArrayType(BOX), useArrow=True)
def _boxes(content, at, end):
    return list(walk_boxes(content, at, end))


def boxes(content, at, end):
    """array<struct<off, len, type>> of walk_boxes()."""
    return _boxes(content, at.cast("bigint"), end.cast("bigint"))


@F.udf(returnType=ArrayType(PART), useArrow=True)
def tile_parts(content):
    """array<struct<off, tileno, part, parts, len>> of walk_tile_parts()."""
    return list(walk_tile_parts(content))


@F.udtf(returnType=SEGMENT, useArrow=True)
class SegmentRows:
    """A row for each marker segment."""

    def eval(self, content):
        yield from walk_segments(content)


@F.udtf(returnType=BOX, useArrow=True)
class BoxRows:
    """A row for each box between two offsets."""

    def eval(self, content, at, end):
        yield from walk_boxes(content, at, end)


@F.udtf(returnType=PART, useArrow=True)
class TilePartRows:
    """A row for each tile-part."""

    def eval(self, content):
        yield from walk_tile_parts(content)


@F.udtf(returnType=PART_DATA, useArrow=True)
class TilePartData:
    """A row for each tile-part with what follows its header's SOD."""

    def eval(self, content):
        for off, tileno, part, parts, size in walk_tile_parts(content):
            yield off, tileno, part, parts, size, content[off + 14 : off + size]
