"""The raster data source: files of other writers, stripes, hostile content, and what a failed write leaves."""

import struct

import pytest
from pyspark.sql import functions as F

from wavelake.sources import raster_source

FILES = {
    "low.pgx": b"PG LM -12 2 1\n" + struct.pack("<hh", -5, 300),
    "high.pgx": b"PG ML + 12 1 2\n" + struct.pack(">HH", 4000, 1),
    "wide.pgx": b"PG ML +32 1 1\n" + b"\xff\xff\xff\xff",
    "none.pgx": b"PG ML + 8 0 0\n",
    "cut.pgx": b"PG ML + 8 3 3\n12345",
    "bomb.pgx": b"PG ML + 8 999999999 999999999\n1",
    "odd.pgx": b"PG ML + 99 1 1\n1",
    "not.pgx": b"P5 1 1 1\n1",
    "empty.pgx": b"",
}
MAPS = {
    "a.ppm": b"P6 #c\n1 2 255\n" + bytes([1, 2, 3, 4, 5, 6]),
    "b.ppm": b"P3\n2 1\n#x\n9\n1 2 3\n4 5 6\n",
    "c.pgm": b"P5 2 1 65535\n" + struct.pack(">HH", 7, 60000),
    "d.pgm": b"P2 1 2 9 8\t7",
    "e.pam": b"P7\nWIDTH 1\nHEIGHT 1\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n" + bytes([9, 8, 7, 6]),
    "f.pgm": b"P2 2 2 9 1 2 3",
    "g.pgm": b"P2 1 1 9 x",
    "h.pam": b"P7\nWIDTH 1\nENDHDR\n1",
    "i.pgm": b"P5 1 1 70000\n11",
    "_hidden.pgm": b"P2 1 1 9 3",
}


def _folder(tmp_path, files) -> str:
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def _read(spark, path, kind, **options):
    raster_source.register(spark)
    return spark.read.format(kind).options(**options).load(path)


def test_pgx_of_other_writers(spark, tmp_path):
    rows = _read(spark, _folder(tmp_path, FILES), "pgx").orderBy("file", "y").collect()
    assert [(r.file, r.y, r.samples, r.signed) for r in rows if not r.error] == [("high.pgx", 0, [4000], False), ("high.pgx", 1, [1], False), ("low.pgx", 0, [-5, 300], True), ("wide.pgx", 0, [2**32 - 1], False)]
    assert {r.file for r in rows if r.error and r.samples is None} == {"none.pgx", "cut.pgx", "bomb.pgx", "odd.pgx", "not.pgx", "empty.pgx"}
    assert [(r.w, r.h) for r in rows if r.file == "cut.pgx"] == [(3, 3)]


def test_maps_of_every_kind(spark, tmp_path):
    rows = _read(spark, _folder(tmp_path, MAPS), "pnm").orderBy("file", "comp", "y").collect()
    good = [(r.file[0], r.comp, r.y, r.samples) for r in rows if not r.error]
    assert good == [("a", c, y, [3 * y + c + 1]) for c in range(3) for y in range(2)] + [("b", c, 0, [c + 1, c + 4]) for c in range(3)] + [("c", 0, 0, [7, 60000]), ("d", 0, 0, [8]), ("d", 0, 1, [7])] + [("e", c, 0, [9 - c]) for c in range(4)]
    assert [r.file[0] for r in rows if r.error] == ["f", "g", "h", "i"]
    one = _read(spark, str(tmp_path / "c.pgm"), "pnm").first()
    assert one.file == "c.pgm" and one.samples == [7, 60000]


def test_stripes_of_a_large_file(spark, tmp_path):
    """A file of many stripes is read by many tasks, and is what it is in one."""
    w, h = 300, 200
    content = b"PG ML -16 %d %d\n" % (w, h) + b"".join(struct.pack(">h", (7 * i) % 30011 - 15000) for i in range(w * h))
    path = _folder(tmp_path, {"big.pgx": content})
    many, one = _read(spark, path, "pgx", stripe=5000), _read(spark, path, "pgx")
    assert many.rdd.getNumPartitions() == 25 and one.rdd.getNumPartitions() == 1
    flat = lambda d: [(r.y, r.samples) for r in d.orderBy("y").collect()]
    assert flat(many) == flat(one) == [(y, [(7 * (y * w + x)) % 30011 - 15000 for x in range(w)]) for y in range(h)]


def test_empty_folders_and_options(spark, tmp_path):
    assert _read(spark, str(tmp_path), "pgx").count() == 0
    with pytest.raises(Exception, match="width"):
        _read(spark, str(tmp_path), "rawplane").count()
    path = _folder(tmp_path, {"x.raw": bytes(5), "y.raw": bytes([255, 1, 2, 3])})
    rows = _read(spark, path, "rawplane", width=2, height=2, signed=True).orderBy("file", "y").collect()
    assert [(r.file, r.samples, bool(r.error)) for r in rows] == [("x.raw", [0, 0], False), ("x.raw", [0, 0], False), ("y.raw", [-1, 1], False), ("y.raw", [2, 3], False)]
    assert _read(spark, path, "rawplane", width=9, height=9).where("error is not null").count() == 2


def test_alpha_and_failed_writes(spark, tmp_path):
    line = lambda c, y, v, f="p": (f, c, 2, 2, 8, False, y, v)
    schema = "file string, comp int, w int, h int, prec int, signed boolean, y int, samples array<bigint>"
    rows = [line(c, y, [10 * c + y, 300]) for c in range(4) for y in range(2)]
    raster_source.save_rasters(spark.createDataFrame(rows, schema), f"{tmp_path}/a", "pnm", components=4)
    assert (tmp_path / "a" / "p.pnm").read_bytes() == b"P7\nWIDTH 2\nHEIGHT 2\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n" + bytes([0, 10, 20, 30, 255, 255, 255, 255, 1, 11, 21, 31, 255, 255, 255, 255])
    back = _read(spark, f"{tmp_path}/a", "pnm").groupBy("comp").agg(F.count("*").alias("n")).orderBy("comp").collect()
    assert [(r.comp, r.n) for r in back] == [(c, 2) for c in range(4)]
    with pytest.raises(Exception, match="missing|out of order"):
        raster_source.save_rasters(spark.createDataFrame(rows[:-1], schema), f"{tmp_path}/b", "pnm", components=4)
    assert not list((tmp_path / "b").rglob("*.pnm"))
