"""Records of transforms over several components: arrays of any element type, and collections that say which components
go through which arrays."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from .headers import bytes_of, marker, raw
from .markers import MCC, MCT, one
from .walks import walk_segments

#: Stored numbers by element type: whole ones of 16 and 32 bits, floating ones of 32 and 64 (fixed values of the format).
ELEMENT_TYPES = (">i2", ">i4", ">f4", ">f8")
MATRIX, OFFSETS = 1, 2

_LONGS = lambda *names: [StructField(n, LongType()) for n in names]
RECORD = StructType([*_LONGS("index", "kind", "element"), StructField("values", ArrayType(DoubleType()))])
COLLECTION = StructType([StructField("inputs", ArrayType(LongType())), StructField("outputs", ArrayType(LongType())), *_LONGS("matrix", "offsets"), StructField("reversible", BooleanType())])


def _packed(values, element):
    if values is None or element is None:
        return None
    v = np.array(values, np.float64)
    return (v if element > 1 else np.trunc(v)).astype(ELEMENT_TYPES[element]).tobytes()


packed = F.udf(_packed, BinaryType(), useArrow=True)


def record(index: Column, kind: int, element: Column, values: Column) -> Column:
    """An array record; values array<double>, stored as numbers of the element type."""
    return marker(MCT, raw("0000"), bytes_of(index + 256 * kind + 1024 * element, 2), raw("0000"), packed(values, element))


def _read_record(content, off, size):
    body = bytes(content[off + 4 : off + 2 + size]) if content is not None and off is not None else b""
    if len(body) < size - 2 or len(body) < 6:
        return None
    first, about, last = struct.unpack_from(">HHH", body)
    if first or last:  # data over several records
        return None
    element = about >> 10 & 3
    dtype = np.dtype(ELEMENT_TYPES[element])
    values = np.frombuffer(body, dtype, (len(body) - 6) // dtype.itemsize, 6)
    return about & 255, about >> 8 & 3, element, values.astype(np.float64).tolist()


_record_of = F.udf(_read_record, RECORD, useArrow=True)


def record_of(content: Column, s: Column) -> Column:
    """struct<index, kind, element, values> of a segment; null where it is cut or goes on in other records."""
    return _record_of(content, s["off"], s["len"])


def _pack_collections(rows):
    out = [struct.pack(">H", len(rows))]
    for r in rows:
        out.append(b"\1")
        for names in (r["inputs"], r["outputs"]):
            wide = max(names, default=0) > 255
            out.append(struct.pack(f">H{len(names)}{'H' if wide else 'B'}", len(names) | wide << 15, *names))
        out.append(bytes([r["reversible"], r["offsets"], r["matrix"]]))
    return b"".join(out)


packed_collections = F.udf(_pack_collections, BinaryType(), useArrow=True)


def collections(index: Column, rows: Column) -> Column:
    """A record of collections array<struct<inputs, outputs, matrix, offsets, reversible>>; component numbers over 255 take
    two bytes."""
    return marker(MCC, raw("0000"), one(index), raw("0000"), packed_collections(rows))


def _read_collections(content, off, size):
    body = bytes(content[off + 4 : off + 2 + size]) if content is not None and off is not None else b""
    if len(body) < size - 2 or len(body) < 7 or body[:2] != b"\0\0" or body[3:5] != b"\0\0":
        return None
    n, at, out = int.from_bytes(body[5:7], "big"), 7, []
    try:
        for _ in range(n):
            if body[at] != 1:  # another kind than array decorrelation
                return None
            at += 1
            names = []
            for _ in range(2):
                (many,) = struct.unpack_from(">H", body, at)
                wide, many = many >> 15, many & 0x7FFF
                names.append(list(struct.unpack_from(f">{many}{'H' if wide else 'B'}", body, at + 2)))
                at += 2 + many * (1 + wide)
            reversible, offsets, matrix = body[at : at + 3]
            at += 3
            out.append((*names, matrix, offsets, bool(reversible & 1)))
    except (struct.error, IndexError, ValueError):
        return None
    return out


_collections_of = F.udf(_read_collections, ArrayType(COLLECTION), useArrow=True)


def collections_of(content: Column, s: Column) -> Column:
    """The collections of a segment; null where it is cut, of another kind, or goes on in other records."""
    return _collections_of(content, s["off"], s["len"])


def _read_header(content):
    found = list(walk_segments(content))
    groups = next((_read_collections(content, off, size) for off, code, size in found if code == MCC), None)
    return [_read_record(content, off, size) for off, code, size in found if code == MCT], groups


_header_of = F.udf(_read_header, StructType([StructField("records", ArrayType(RECORD)), StructField("groups", ArrayType(COLLECTION))]), useArrow=True)


def header_of(content: Column) -> Column:
    """struct<records, groups> of a main header: all array records, and the collections of its first segment of such, as
    record_of() and collections_of() give them. A header is sent to Python once, and not once for each kind of segment."""
    return _header_of(content)
