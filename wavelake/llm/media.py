"""Media columns for ISO base media files (the box format of MP4).

describe_media() walks the nested boxes of each file, decodes the sample tables of every track, and gives codec,
duration and the byte range and time of each keyframe; payload bytes are never decoded. write_media() stores a payload
as the constant-size samples of one track. Both run as Arrow batches over the rows of a table; each file is one row.

Null content gives null columns; an empty, cut, damaged or hostile file gives a row with `error` set and what was read
before the damage, without keyframes. Boxes of size 0 reach to the end, size 1 has 64 bits; unknown boxes are skipped,
and boxes that nest over DEPTH deep are an error. Counts are checked against the length of the file before anything is
made of them, and keyframes are given in runs, so that a row stays smaller than its file. Movie fragments and edit lists are not read. Rows are independent, so repeats and ties give equal rows; a
file (or text) of any length is one row, held whole by one task; an empty table gives an empty result; further columns of
the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import blocks, materialise, quoted, table, text_bytes

SAMPLE = 64
SAMPLES_A_CHUNK = 256
KEYFRAME_EVERY = 32
TIMESCALE = 8000
CODEC = b"raw "
DEPTH = 32

#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}

TRACKS = "array<struct<track_id:long,handler:string,codec:string,timescale:long,duration:long,samples:long,bytes:long,keyframes:array<struct<offset:long,length:long,time:long,count:long,step:long,ticks:long>>>>"
#: Samples that are placed at once.
LOT = 1 << 18


# --- reading ------------------------------------------------------------------------------------------------------


def walk(buf: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of each box body between at and end, parents before children; DEPTH levels at most."""
    open_ = [end]
    while open_:
        if at == open_[-1]:
            open_.pop()
            continue
        if at + 8 > open_[-1]:
            raise ValueError("bytes after the last box")
        size, kind = struct.unpack_from(">I4s", buf, at)
        head = 8
        if size == 1:
            if at + 16 > open_[-1]:
                raise ValueError("cut box header")
            size, head = struct.unpack_from(">Q", buf, at + 8)[0], 16
        size = size or open_[-1] - at
        if size < head or at + size > open_[-1]:
            raise ValueError(f"box {kind.decode('latin-1')} of {size} bytes does not fit")
        yield kind, at + head, at + size
        if kind in CONTAINERS:
            if len(open_) == DEPTH:
                raise ValueError(f"boxes nest over {DEPTH} deep")
            open_.append(at + size)
            at += head
        else:
            at += size


def _u32(buf: memoryview, at: int, n: int, end: int, kind: str = ">u4") -> np.ndarray:
    """n numbers; they must lie in the box, so that no count makes a table larger than the file."""
    if n < 0 or at + np.dtype(kind).itemsize * n > end:
        raise ValueError("cut table")
    return np.frombuffer(buf, kind, n, at).astype(np.int64)


class Track:
    """The tables of one track as they are met, and what follows from them. Tables stay as runs: a constant sample size is
    one number, sample times and chunks are worked out only where they are asked for."""

    def __init__(self):
        self.id, self.handler, self.codec, self.timescale, self.duration = None, None, None, 0, 0
        self.stts = self.stsc = np.zeros((0, 2), np.int64)
        self.samples, self.same, self.sizes = 0, 0, np.zeros(0, np.int64)
        self.chunks, self.sync = np.zeros(0, np.int64), None

    def take(self, kind: bytes, buf: memoryview, a: int, z: int) -> None:
        count = lambda: struct.unpack_from(">I", buf[:z], a + 4)[0]
        if kind == b"tkhd":
            self.id = struct.unpack_from(">I", buf[:z], a + (20 if buf[a] else 12))[0]
        elif kind == b"mdhd":
            self.timescale, self.duration = struct.unpack_from(">IQ", buf[:z], a + 20) if buf[a] else struct.unpack_from(">II", buf[:z], a + 12)
            if self.duration >> 63:
                raise ValueError("duration over 63 bits")
        elif kind == b"hdlr" and self.handler is None:
            self.handler = bytes(buf[a + 8 : min(a + 12, z)]).decode("latin-1")
        elif kind == b"stsd":
            self.codec = bytes(buf[a + 12 : min(a + 16, z)]).decode("latin-1")
        elif kind == b"stts":
            self.stts = _u32(buf, a + 8, 2 * count(), z).reshape(-1, 2)
        elif kind == b"stsc":
            self.stsc = _u32(buf, a + 8, 3 * count(), z).reshape(-1, 3)[:, :2]
        elif kind == b"stsz":
            self.same, self.samples = struct.unpack_from(">II", buf[:z], a + 4)
            self.sizes = np.zeros(0, np.int64) if self.same else _u32(buf, a + 12, self.samples, z)
        elif kind == b"stz2":
            bits, self.samples = buf[a + 7], struct.unpack_from(">I", buf[:z], a + 8)[0]
            if bits not in (4, 8, 16):
                raise ValueError(f"sample sizes of {bits} bits")
            raw = _u32(buf, a + 12, -(-self.samples * bits // 8) if bits < 16 else self.samples, z, ">u2" if bits == 16 else ">u1")
            self.same, self.sizes = 0, (np.stack([raw >> 4, raw & 15], 1).ravel() if bits == 4 else raw)[: self.samples]
        elif kind == b"stco":
            self.chunks = _u32(buf, a + 8, count(), z)
        elif kind == b"co64":
            self.chunks = _u32(buf, a + 8, count(), z, ">u8")
            if (self.chunks < 0).any():
                raise ValueError("chunk offset over 63 bits")
        elif kind == b"stss":
            self.sync = _u32(buf, a + 8, count(), z) - 1

    @cached_property
    def ends(self) -> np.ndarray:
        return np.append(0, np.cumsum(self.sizes))

    def before(self, k: np.ndarray) -> np.ndarray:
        """Bytes of all samples before each of k."""
        return k * self.same if self.same else self.ends[k]

    @property
    def bytes(self) -> int:
        return self.same * self.samples if self.same else int(self.sizes.sum())

    def chunk_firsts(self) -> np.ndarray:
        """The first sample of each chunk; the chunks must hold all samples."""
        k = len(self.chunks)
        if not self.samples:
            return np.zeros(k, np.int64)
        first = self.stsc[:, 0] - 1
        runs = np.diff(np.append(first, k))
        if not k or not len(first) or first[0] != 0 or (runs < 0).any():
            raise ValueError("sample-to-chunk table does not fit")
        per = np.repeat(self.stsc[:, 1], runs)  # a number for each chunk of the file's table
        if sum(int(p) * int(r) for p, r in zip(self.stsc[:, 1], runs, strict=True)) < self.samples:
            raise ValueError("more samples than the chunks hold")
        if int(per.max(initial=0)) * k >> 62:
            raise ValueError("sample-to-chunk table does not fit")
        return np.cumsum(per) - per

    @cached_property
    def firsts(self) -> np.ndarray:
        return self.chunk_firsts()

    def place(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset, length) of samples k: the chunk's offset, plus the sizes before it in the chunk."""
        first = self.firsts
        chunk = np.searchsorted(first, k, side="right") - 1
        size = np.full(len(k), self.same) if self.same else self.sizes[k]
        return self.chunks[chunk] + self.before(k) - self.before(first[chunk]), size

    def times(self, k: np.ndarray) -> np.ndarray:
        ends = [int(n) for n in self.stts[:, 0]]
        if sum(ends) < self.samples:
            raise ValueError("time table is too short")
        if sum(int(n) * int(d) for n, d in self.stts) >> 63:
            raise ValueError("times over 63 bits")
        upto = np.cumsum(self.stts[:, 0])
        run = np.searchsorted(upto, k, side="right")
        start = np.cumsum(self.stts[:, 0] * self.stts[:, 1]) - self.stts[:, 0] * self.stts[:, 1]
        return start[run] + (k - (upto - self.stts[:, 0])[run]) * self.stts[run, 1]

    def keyframes(self) -> np.ndarray:
        """The sync samples as rows (offset, length, time, count, step, ticks): runs of `count` samples of one length, whose
        offsets and times go up by `step` and `ticks`. Without a table of them every sample is one, and a track of constant
        samples is a run for each chunk that does not follow the one before."""
        sync = None if self.sync is None else self.sync[(self.sync >= 0) & (self.sync < self.samples)]
        total = self.samples if sync is None else len(sync)
        out = [np.zeros((0, 6), np.int64)]
        for lot in range(0, total, LOT):
            k = np.arange(lot, min(lot + LOT, total)) if sync is None else sync[lot : lot + LOT]
            out.append(_runs(*self.place(k), self.times(k)))
        r = np.concatenate(out)
        if len(r) > 1:  # runs that were cut between lots
            a, z = r[:-1], r[1:]
            on = (a[:, 1] == z[:, 1]) & (a[:, 4:] == z[:, 4:]).all(1) & (a[:, 0] + a[:, 3] * a[:, 4] == z[:, 0]) & (a[:, 2] + a[:, 3] * a[:, 5] == z[:, 2])
            cut = np.flatnonzero(np.append(True, ~on))
            count = np.add.reduceat(r[:, 3], cut)
            r = r[cut]
            r[:, 3] = count
        return r

    def check(self, length: int) -> None:
        """Whether the tables fit each other and a file of that length."""
        if self.samples and self.bytes > length:
            raise ValueError("samples of more bytes than the file")
        if self.same == 0 and len(self.sizes) < self.samples:
            raise ValueError("cut table")
        if self.same and self.samples > length:  # each has a byte at least
            raise ValueError("more samples than bytes")
        self.chunk_firsts(), self.times(np.zeros(0, np.int64))


def _runs(offset: np.ndarray, length: np.ndarray, time: np.ndarray) -> np.ndarray:
    """Rows (offset, length, time, count, step, ticks) of samples in their order."""
    n = len(offset)
    step, ticks = np.diff(offset), np.diff(time)
    other = np.append(True, length[1:] != length[:-1])  # starts a run
    turn = np.zeros(n, bool)
    turn[2:] = (step[1:] != step[:-1]) | (ticks[1:] != ticks[:-1])
    # the first step of a run is free: of turns side by side every other one starts a run
    side = other | turn & ~np.append(False, (other | turn)[:-1])
    at = np.arange(n)
    nth = at - np.maximum.accumulate(np.where(side, at, 0))
    cut = np.flatnonzero(other | turn & (nth % 2 == 0))
    count = np.diff(np.append(cut, n))
    of = np.where(count > 1, cut, 0)[: len(cut)]
    by = (lambda d: np.where(count > 1, np.append(d, 0)[of], 0))
    return np.stack([offset[cut], length[cut], time[cut], count, by(step), by(ticks)], 1)


def read_tracks(content: bytes) -> tuple[list[Track], str | None, str | None]:
    """(tracks, brand, error) of a file."""
    buf, tracks, brand = memoryview(content), [], None
    try:
        for kind, a, z in walk(buf, 0, len(buf)):
            if kind == b"ftyp":
                brand = bytes(buf[a : min(a + 4, z)]).decode("latin-1")
            elif kind == b"trak":
                tracks.append(Track())
            elif tracks and z > a:
                tracks[-1].take(kind, buf, a, z)
        if not len(buf):
            raise ValueError("empty file")
        for t in tracks:
            t.check(len(buf))
    except (ValueError, struct.error, IndexError) as e:
        return tracks, brand, str(e)
    return tracks, brand, None


def describe_media(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, brand, tracks, error) for each row of `files`; tracks as in TRACKS, with every keyframe's byte range, in runs."""
    kind = dict(files.dtypes)[key]
    schema = f"key {kind}, brand string, tracks {TRACKS}, error string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    track = arrow.field("tracks").type.value_type
    frame = track.field("keyframes").type.value_type

    def rows(batches):
        for block in blocks(batches, "content"):
            brands, errors, plain = [], [], []
            frames, known, many = [np.zeros((0, 6), np.int64)], [], []
            for c in block.column("content"):
                tracks, brand, error = read_tracks(c.as_py()) if c.is_valid else ([], None, None)
                brands.append(brand), errors.append(error), many.append(len(tracks) if c.is_valid else None)
                for t in tracks:
                    # of a damaged file only the tables' plain numbers
                    frames.append(frames[0] if error else t.keyframes())
                    known.append(len(frames[-1]))
                    plain.append((t.id, t.handler, t.codec, t.timescale, t.duration, t.samples, None if t.bytes >> 63 else t.bytes))
            runs = pa.StructArray.from_arrays([pa.array(c) for c in np.concatenate(frames).T], fields=list(frame))
            fields = [pa.array([p[i] for p in plain], track.field(i).type) for i in range(7)]
            fields.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(known)).astype(np.int32)), runs, type=track.field("keyframes").type))
            at = np.append(0, np.cumsum([m or 0 for m in many])).astype(np.int32)
            at = pa.array(at, mask=np.append([m is None for m in many], False))
            tracks = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(fields, fields=list(track)), type=arrow.field("tracks").type)
            yield pa.RecordBatch.from_arrays([block.column("key").combine_chunks().cast(arrow.field(0).type), pa.array(brands, pa.string()), tracks, pa.array(errors, pa.string())], schema=arrow)

    return files.select(F.col(quoted(key)).alias("key"), F.col(quoted(content)).alias("content")).mapInArrow(rows, schema).withColumnRenamed("key", key)


# --- writing ------------------------------------------------------------------------------------------------------


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"iso2")


def write_media(payload: bytes) -> bytes:
    """One audio track of 8-bit samples: units of SAMPLE bytes, the last padded with zeros to a positive multiple."""
    n = max(1, -(-len(payload) // SAMPLE))
    pad = n * SAMPLE - len(payload)
    chunks = -(-n // SAMPLES_A_CHUNK)
    last = n - (chunks - 1) * SAMPLES_A_CHUNK
    sync = np.arange(1, n + 1, KEYFRAME_EVERY)
    per = [(1, SAMPLES_A_CHUNK, 1), (chunks, last, 1)] if chunks > 1 and last != SAMPLES_A_CHUNK else [(1, min(n, SAMPLES_A_CHUNK), 1)]
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    tables = [
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
        full(b"stss", struct.pack(">I", len(sync)), sync.astype(">u4").tobytes()),
        full(b"stsc", struct.pack(">I", len(per)), b"".join(struct.pack(">III", *p) for p in per)),
        full(b"stsz", struct.pack(">II", SAMPLE, n)),
    ]
    spread = SAMPLE * SAMPLES_A_CHUNK
    wide = n * SAMPLE > 2**32 - 2**20
    moov = lambda first: box(
        b"moov",
        full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, n * SAMPLE), struct.pack(">IHHQ", 0x10000, 0x100, 0, 0), _MATRIX, bytes(24), struct.pack(">I", 2)),
        box(
            b"trak",
            full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * SAMPLE), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=7),
            box(
                b"mdia",
                full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n * SAMPLE, 0x55C4, 0)),
                full(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0"),
                box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), box(b"stbl", *tables, full(b"co64" if wide else b"stco", struct.pack(">I", chunks), (first + spread * np.arange(chunks)).astype(">u8" if wide else ">u4").tobytes()))),
            ),
        ),
    )
    head = len(_FTYP) + len(moov(0)) + (16 if wide else 8)
    start = struct.pack(">I4sQ", 1, b"mdat", 16 + n * SAMPLE) if wide else struct.pack(">I4s", 8 + n * SAMPLE, b"mdat")
    return b"".join((_FTYP, moov(head), start, payload, bytes(pad)))


def read_payload(content: bytes) -> tuple[bytes, Track]:
    """The samples of the first track, by its tables."""
    tracks, _, error = read_tracks(content)
    if error:
        raise ValueError(error)
    t = tracks[0]
    first = t.chunk_firsts()
    last = np.minimum(np.append(first[1:], t.samples), t.samples)
    size = t.before(last) - t.before(np.minimum(first, t.samples))  # of each chunk
    cuts = np.flatnonzero(np.append(True, t.chunks[1:] != t.chunks[:-1] + size[:-1])) if len(size) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(size)) - 1
    return b"".join(content[t.chunks[i] : t.chunks[j] + size[j]] for i, j in zip(cuts, ends, strict=True) if size[i : j + 1].any()), t


# --- the query ----------------------------------------------------------------------------------------------------


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, content): each text's bytes as a media file; a null text is empty."""

    def rows(batches):
        for block in blocks(batches):
            data, o = text_bytes(block)
            raw = data.tobytes()
            for lo in range(0, block.num_rows, 512):
                hi = min(lo + 512, block.num_rows)
                files = [write_media(raw[o[i] : o[i + 1]]) for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([block.column("doc_id").slice(lo, hi - lo).combine_chunks(), pa.array(np.diff(o[lo : hi + 1])), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "content"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_bytes long, content binary")


def digest(files: DataFrame) -> DataFrame:
    """Reads stored files back: hashes of payload and file, and a summary of the track's tables."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<offset:long,length:long,time:long,count:long,step:long,ticks:long>>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def rows(batches):
        for block in blocks(batches, "content"):
            out: list[list] = [[] for _ in range(9)]
            for c in block.column("content"):
                c = c.as_py()
                payload, t = read_payload(c)
                runs = t.keyframes()
                (at, size, *_), (to, last, when, n, step, ticks) = runs[0].tolist(), runs[-1].tolist()
                seconds = t.duration / t.timescale
                feature = f"{t.codec.strip()}/{t.timescale} {t.duration} ticks, {t.samples} samples, {runs[:, 3].sum()} keyframes, first {at}+{size}, last {to + (n - 1) * step}+{last} at {when + (n - 1) * ticks}"
                for col, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(c), hashlib.sha256(c).hexdigest(), feature, t.codec, seconds, runs.tolist()), strict=True):
                    col.append(v)
            found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in out[-1]])).astype(np.int32)), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in np.array([x for r in out[-1] for x in r], np.int64).reshape(-1, 6).T], fields=list(arrow.field("keyframes").type.value_type)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id").combine_chunks(), block.column("n_bytes").combine_chunks(), *(pa.array(c, f.type) for c, f in zip(out[:-1], list(arrow)[2:], strict=False)), found.cast(arrow.field("keyframes").type)], schema=arrow)

    return files.mapInArrow(rows, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(materialise(store_texts(table(spark, sf_dir, "documents")), "media"))

