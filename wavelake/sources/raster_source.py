"""Raster files as a Spark data source: `spark.read.format("pgx" | "pnm" | "rawplane").load(folder)` and the same to write.

A row is one line of one component: (file, comp, w, h, prec, signed, y, samples, error). Large binary files are read in
stripes of lines by several tasks, each of which reads the header and its own bytes; small files are packed together. What
is not a whole file of its kind is a row with `error` set and, as far as they are known, the fields of its header.

Formats: `pgx` has one component, high or low bytes first; `pnm` are P2, P3, P5, P6 and P7 files (P7 with any number of
components, alpha among them); `rawplane` has no header, and its options say what it holds: width, height, precision,
signed, components (one plane after the other), order (`high` or `low` byte first). Other options: `stripe`, the bytes of a
task. Written files are named after `file`; pgx files one for each component. save_rasters() deals and sorts the lines.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, comp int, w int, h int, prec int, signed boolean, y int, samples array<bigint>, error string"
_ARROW = pa.schema([("file", pa.string()), ("comp", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("prec", pa.int32()), ("signed", pa.bool_()), ("y", pa.int32()), ("samples", pa.list_(pa.int64())), ("error", pa.string())])
HEADER = 4096  # bytes in which a header must end
LINES = 1 << 20  # samples of a batch
STRIPE = 16 << 20


@dataclass
class Layout:
    """What a header tells. start: of the samples; size: bytes of one; dtype: of the stored numbers; comps: of a pixel if
    `mixed`, else planes one after the other."""

    w: int
    h: int
    comps: int
    prec: int
    signed: bool
    start: int
    dtype: str
    mixed: bool = False
    plain: bool = False

    @property
    def size(self) -> int:
        return np.dtype(self.dtype).itemsize

    @property
    def bytes(self) -> int:
        return self.w * self.h * self.comps * self.size


def _width(prec: int, signed: bool, low: bool) -> str:
    size = 1 if prec <= 8 else 2 if prec <= 16 else 4
    return f"{'<' if low else '>'}{'i' if signed else 'u'}{size}"


_GAP = rb"(?:\s|#[^\n]*\n)+"


def pgx_layout(head: bytes) -> Layout:
    m = re.match(rb"PG\s+(ML|LM)\s+([+-]?)\s*(\d{1,9})\s+(\d{1,9})\s+(\d{1,9})[^\S\n]*\n", head)
    if not m:
        raise ValueError("no PGX header")
    prec, w, h = map(int, m.group(3, 4, 5))
    if not 1 <= prec <= 32:
        raise ValueError(f"precision {prec}")
    signed = m[2] == b"-"
    return Layout(w, h, 1, prec, signed, m.end(), _width(prec, signed, m[1] == b"LM"))


def pnm_layout(head: bytes) -> Layout:
    if m := re.match(rb"P([2356])" + (_GAP + rb"(\d{1,9})") * 3 + rb"\s", head):
        kind, w, h, top = map(int, m.groups())
        comps = 3 if kind in (3, 6) else 1
    elif m := re.match(rb"P7\n(.*?)ENDHDR\n", head, re.S):
        fields = dict(re.findall(rb"(?m)^(WIDTH|HEIGHT|DEPTH|MAXVAL)\s+(\d{1,9})\s*$", m[1]))
        if len(fields) < 4:
            raise ValueError("P7 header lacks a field")
        kind, (w, h, comps, top) = 7, (int(fields[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
    else:
        raise ValueError("no portable map header")
    if not 1 <= top <= 65535 or not comps:
        raise ValueError(f"largest value {top}, {comps} components")
    return Layout(w, h, comps, top.bit_length(), False, m.end(), ">u1" if top < 256 else ">u2", True, kind < 4)


def raw_layout(options: dict[str, str]) -> Layout:
    w, h, prec, comps = (int(options.get(k, d)) for k, d in (("width", 0), ("height", 0), ("precision", 8), ("components", 1)))
    if w < 1 or h < 1 or comps < 1 or not 1 <= prec <= 32:
        raise ValueError("rawplane needs the options width, height, and a precision of 1 to 32")
    signed = options.get("signed", "false").lower() == "true"
    return Layout(w, h, comps, prec, signed, 0, _width(prec, signed, options.get("order", "high") == "low"))


@dataclass
class Piece(InputPartition):
    """Stripes (path, number, of how many) of files."""

    stripes: list[tuple[str, int, int]]


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]+:/", path) else (fs.LocalFileSystem(), os.path.abspath(path))


def _list(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """Files below a folder, or one file; names that begin with `_` or `.` are not listed."""
    system, root = _filesystem(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    shown = lambda p: not any(part[:1] in "_." for part in p[len(root) :].split("/") if part)
    return system, sorted((i for i in found if i.type == fs.FileType.File and shown(i.path)), key=lambda i: i.path)


class RasterReader(DataSourceReader):
    def __init__(self, kind: str, options: dict[str, str]):
        self.kind, self.options = kind, dict(options)
        self.path = options["path"]
        if kind == "rawplane":
            raw_layout(self.options)

    def partitions(self) -> list[Piece]:
        most = max(1, int(self.options.get("stripe", STRIPE)))
        out, held, size = [], [], 0
        for info in _list(self.path)[1]:
            n = max(1, -(-info.size // most))
            if n > 1:
                out += [Piece([(info.path, k, n)]) for k in range(n)]
                continue
            if size + info.size > most and held:
                out, held, size = [*out, Piece(held)], [], 0
            held.append((info.path, 0, 1))
            size += info.size
        return [*out, Piece(held)] if held or not out else out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(self.path)
        for path, k, n in piece.stripes:
            name = path[len(root) :].lstrip("/") or os.path.basename(path)
            layout = None
            try:
                with system.open_input_file(path) as f:
                    layout = self._layout(f.read_at(min(HEADER, f.size()), 0))
                    if layout.w < 1 or layout.h < 1:
                        raise ValueError(f"an image of {layout.w} x {layout.h}")
                    if not layout.plain and f.size() < layout.start + layout.bytes:
                        raise ValueError(f"{f.size() - layout.start} of {layout.bytes} bytes of samples")
                    yield from self._plain(name, layout, f) if layout.plain and k == 0 else () if layout.plain else self._lines(name, layout, f, layout.h * k // n, layout.h * (k + 1) // n)
            except (ValueError, OSError) as e:
                if k == 0:
                    plain = (layout.w, layout.h, layout.prec, layout.signed) if layout else (None,) * 4
                    yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, (name, None, *plain, None, None, str(e)), strict=True))], schema=_ARROW)

    def _layout(self, head: bytes) -> Layout:
        return raw_layout(self.options) if self.kind == "rawplane" else pgx_layout(head) if self.kind == "pgx" else pnm_layout(head)

    def _lines(self, name: str, layout: Layout, f, first: int, last: int) -> Iterator[pa.RecordBatch]:
        comps = layout.comps if layout.mixed else 1
        step = max(1, LINES // (layout.w * comps))
        for plane in range(1 if layout.mixed else layout.comps):
            for y in range(first, last, step):
                m = min(step, last - y)
                at = layout.start + ((plane * layout.h + y) * layout.w * comps) * layout.size
                v = np.frombuffer(f.read_at(m * layout.w * comps * layout.size, at), layout.dtype).astype(np.int64)
                yield from _batches(name, layout, v.reshape(m, layout.w, comps), y, plane)

    def _plain(self, name: str, layout: Layout, f) -> Iterator[pa.RecordBatch]:
        words = f.read_at(f.size() - layout.start, layout.start).split()
        n = layout.w * layout.h * layout.comps
        if len(words) < n:
            raise ValueError(f"{len(words)} of {n} samples")
        v = np.array([int(w) for w in words[:n]], np.int64).reshape(layout.h, layout.w, layout.comps)
        step = max(1, LINES // (layout.w * layout.comps))
        for y in range(0, layout.h, step):
            yield from _batches(name, layout, v[y : y + step], y, 0)


def _batches(name: str, layout: Layout, v: np.ndarray, y: int, plane: int) -> Iterator[pa.RecordBatch]:
    """Lines (lines, w, comps) from line `y` on."""
    m, w, comps = v.shape
    for c in range(comps):
        samples = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * w), pa.array(np.ascontiguousarray(v[:, :, c]).ravel()))
        same = lambda x, t: pa.repeat(pa.scalar(x, t), m)
        yield pa.RecordBatch.from_arrays([same(name, pa.string()), same(plane + c, pa.int32()), same(w, pa.int32()), same(layout.h, pa.int32()), same(layout.prec, pa.int32()), same(layout.signed, pa.bool_()), pa.array(np.arange(y, y + m, dtype=np.int32)), samples, pa.nulls(m, pa.string())], schema=_ARROW)


# --- writing ------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class RasterWriter(DataSourceWriter):
    """Lines come file by file, in the order of save_rasters(). Files lie in a hidden folder until all tasks are done, so a
    lost task leaves nothing that a reader sees."""

    def __init__(self, kind: str, options: dict[str, str]):
        self.kind, self.options, self.path = kind, dict(options), options["path"]
        self.hidden = f"_{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        system, root = _filesystem(self.path)
        folder = f"{root}/{self.hidden}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        names, key, out, left = [], None, None, 0
        for r in rows:
            now = (r.file, r.comp) if self.kind == "pgx" else (r.file,)
            if now != key:
                if left:
                    raise ValueError(f"lines of {key} are missing")
                if out:
                    out.close()
                key, line, held = now, 0, []
                comps = int(self.options.get("components", 1)) if self.kind != "pgx" else 1
                name = f"{r.file}_{r.comp}.pgx" if self.kind == "pgx" else f"{r.file}.{'raw' if self.kind == 'rawplane' else 'pnm'}"
                if "/" in name or name[0] in "_.":
                    raise ValueError(f"file name {name}")
                names.append(f"{folder.rpartition('/')[2]}/{name}")
                out, left = system.open_output_stream(f"{folder}/{name}"), r.h * comps
                out.write(self._head(r, comps))
            want = (line // comps, line % comps) if self.kind == "pnm" else (line % r.h, line // r.h)
            if (r.y, r.comp if self.kind != "pgx" else 0) != want or len(r.samples) != r.w or left < 1:
                raise ValueError(f"line {r.y} of component {r.comp} of {r.file} is out of order or of another width")
            line, left = line + 1, left - 1
            v = np.asarray(r.samples, np.int64)
            low, high = (-(1 << r.prec - 1), (1 << r.prec - 1) - 1) if r.signed else (0, (1 << r.prec) - 1)
            held.append(np.clip(v, low, high))
            if self.kind != "pnm" or len(held) == comps:
                dtype = (">u1" if r.prec <= 8 else ">u2") if self.kind == "pnm" else _width(r.prec, r.signed, self.options.get("order", "high") == "low")
                out.write(np.stack(held, 1).astype(dtype).tobytes())
                held = []
        if left:
            raise ValueError(f"lines of {key} are missing")
        if out:
            out.close()
        return Written(names)

    def _head(self, r, comps: int) -> bytes:
        if self.kind == "rawplane":
            return b""
        if self.kind == "pgx":
            order = "LM" if self.options.get("order", "high") == "low" else "ML"
            return f"PG {order} {'-' if r.signed else '+'} {r.prec} {r.w} {r.h}\n".encode()
        if r.signed or r.prec > 16:
            raise ValueError("portable maps hold unsigned samples of up to 16 bits")
        top = (1 << r.prec) - 1
        if comps in (1, 3):
            return f"P{5 if comps == 1 else 6}\n{r.w} {r.h}\n{top}\n".encode()
        kind = {2: "GRAYSCALE_ALPHA", 4: "RGB_ALPHA"}.get(comps)
        return f"P7\nWIDTH {r.w}\nHEIGHT {r.h}\nDEPTH {comps}\nMAXVAL {top}\n{f'TUPLTYPE {kind}' + chr(10) if kind else ''}ENDHDR\n".encode()

    def commit(self, messages) -> None:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{root}/{self.hidden}/{name}", f"{root}/{name.partition('/')[2]}")
        self.abort(messages)

    def abort(self, messages) -> None:
        system, root = _filesystem(self.path)
        if system.get_file_info(f"{root}/{self.hidden}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.hidden}")


class _Raster(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.kind, self.options)

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.kind, self.options)


class Pgx(_Raster):
    kind = "pgx"


class Pnm(_Raster):
    kind = "pnm"


class RawPlane(_Raster):
    kind = "rawplane"


def register(spark: SparkSession) -> None:
    for source in (Pgx, Pnm, RawPlane):
        spark.dataSource.register(source)


def save_rasters(lines: DataFrame, path: str, kind: str, **options) -> None:
    """Write lines (file, comp, w, h, prec, signed, y, samples) as files below `path`: one task writes a file (pgx: a
    component), in the order of its lines."""
    register(lines.sparkSession)
    keys = ["file", "comp"] if kind == "pgx" else ["file"]
    order = ["file", "y", "comp"] if kind == "pnm" else ["file", "comp", "y"]
    dealt = lines.select("file", "comp", "w", "h", "prec", "signed", "y", "samples", F.lit(None).cast("string").alias("error")).repartition(*keys)
    dealt.sortWithinPartitions(*order).write.format(kind).options(**options).mode("append").save(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that the whole cluster shares; a local one only where the session sets none and is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix=f"{label}-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
