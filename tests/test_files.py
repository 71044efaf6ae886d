"""Marker segments, boxes and raster files that the relations do not give: long walks, damage, other byte orders."""

import struct

from pyspark.sql import functions as F

from wavelake.sources import headers, markers, rasters


def _one(spark, content: bytes):
    return spark.createDataFrame([(1, content)], "id long, c binary")


def test_walks_have_no_cap(spark):
    segments = b"".join(b"\xff\x64" + struct.pack(">H", 4 + i % 9) + bytes(2 + i % 9) for i in range(300))
    got = _one(spark, b"\xff\x4f" + segments + b"\xff\x90").select(headers.segments(F.col("c")).alias("s")).first().s
    assert len(got) == 300 and sum(s.len + 2 for s in got) == len(segments)
    boxes = b"".join(struct.pack(">I4s", 8 + i % 5, b"free") + bytes(i % 5) for i in range(200)) + struct.pack(">I4sQ", 1, b"big ", 20) + bytes(4) + struct.pack(">I4s", 0, b"last") + b"xyz"
    got = _one(spark, boxes).select(headers.boxes(F.col("c"), F.lit(0), F.octet_length("c")).alias("b")).first().b
    assert len(got) == 202 and got[200].type == "big " and got[200].len == 20 and got[201].len == 11


def test_damaged_content_ends_a_walk(spark):
    cases = [b"", b"\xff\x4f", b"\xff\x4f\xff\x64\x00\x01", b"\xff\x4f\xff\x64", struct.pack(">I4s", 4, b"abcd"), struct.pack(">I4s", 99, b"abcd")]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)] + [(9, None)], "id long, c binary")
    got = df.select("id", headers.segments(F.col("c")).alias("s"), headers.boxes(F.col("c"), F.lit(0), F.octet_length("c")).alias("b"), headers.tile_parts(F.col("c")).alias("t")).collect()
    assert [r for r in got if r.s or r.b or r.t] == []


def test_a_part_of_length_zero_reaches_to_the_end(spark):
    part = lambda n, i, length, data: b"\xff\x90\x00\x0a" + struct.pack(">HIBB", n, length, i, 2) + b"\xff\x93" + data
    got = _one(spark, b"\xff\x4f" + part(3, 0, 17, b"abc") + part(3, 1, 0, b"defgh")).select(F.explode(headers.tile_parts(F.col("c"))).alias("p")).select("p.*").collect()
    assert [(p.tileno, p.part, p.parts, p.len) for p in got] == [(3, 0, 2, 17), (3, 1, 2, 19)]


def test_packet_lengths(spark):
    df = spark.createDataFrame([(0,), (127,), (128,), (16383,), (16384,), (300000000,)], "v long")
    assert [r.h for r in df.select(markers.varint(F.col("v")).alias("h")).collect()] == ["00", "7F", "8100", "FF7F", "818000", "818F86C600"]


def test_pgx_of_either_byte_order(spark):
    low = b"PG LM -12 2 1\n" + struct.pack("<hh", -5, 300)
    high = b"PG ML + 12 1 2\n" + struct.pack(">HH", 4000, 1)
    df = spark.createDataFrame([(1, low), (2, high), (3, b"PG XX + 8 1 1\n\x00")], "id long, c binary")
    got = {r.id: r.s for r in df.select("id", rasters.read_pgx(F.col("c")).alias("s")).collect()}
    assert [(s.y, s.x, s.v) for s in got[1]] == [(0, 0, -5), (0, 1, 300)] and [s.v for s in got[2]] == [4000, 1] and got[3] is None


def test_pixmaps_of_every_kind(spark):
    files = [b"P6 #c\n1 2 255\n" + bytes([1, 2, 3, 4, 5, 6]), b"P3\n2 1\n#x\n9\n1 2 3\n4 5 6\n", b"P5 2 1 65535\n" + struct.pack(">HH", 7, 60000), b"P2 1 2 9 8\t7", b"P9"]
    got = [r.s for r in spark.createDataFrame([(i, f) for i, f in enumerate(files)], "id long, c binary").orderBy("id").select(rasters.read_pixmap(F.col("c")).alias("s")).collect()]
    assert [(s.c, s.y, s.x, s.v) for s in got[0]] == [(c, y, 0, 3 * y + c + 1) for y in range(2) for c in range(3)]
    assert [s.v for s in got[1]] == [1, 2, 3, 4, 5, 6] and [s.v for s in got[2]] == [7, 60000] and [s.v for s in got[3]] == [8, 7] and got[4] is None


def test_ten_thousand_tile_parts_in_a_large_file(spark):
    """Walks cost their elements: 10,000 parts in 100 MB, as an array and by a lateral join."""
    import time

    from wavelake.sources import walks

    data = bytes(10_000)
    part = lambda i: b"\xff\x90\x00\x0a" + struct.pack(">HIBB", i % 5000, 14 + len(data), i // 5000, 2) + b"\xff\x93" + data
    df = _one(spark, b"\xff\x4f\xff\x64\x00\x04ab" + b"".join(map(part, range(10_000))))
    began = time.time()
    rows = df.lateralJoin(walks.TilePartRows(F.col("c").outer())).select("id", "off", "tileno", "part", "len").collect()
    assert [(r.off, r.tileno, r.part, r.len) for r in rows] == [(8 + i * 10_014, i % 5000, i // 5000, 10_014) for i in range(10_000)]
    assert df.select(F.size(headers.tile_parts(F.col("c"))).alias("n")).first().n == 10_000
    assert time.time() - began < 30


def test_table_functions_and_arrays_agree(spark):
    from wavelake.sources import walks

    segments = b"".join(b"\xff\x64" + struct.pack(">H", 4) + b"ab" for _ in range(5))
    df = spark.createDataFrame([(1, b"\xff\x4f" + segments + b"\xff\x90"), (2, None), (3, b"")], "id long, c binary")
    assert df.lateralJoin(walks.SegmentRows(F.col("c").outer())).groupBy("id").count().collect() == [(1, 5)]
    boxes = struct.pack(">I4s", 11, b"abcd") + b"xyz" + struct.pack(">I4sQ", 1, b"wide", 1 << 63)
    got = _one(spark, boxes).lateralJoin(walks.BoxRows(F.col("c").outer(), F.lit(0), F.octet_length("c").outer())).select("off", "len", "type").collect()
    assert [tuple(r) for r in got] == [(0, 11, "abcd")]


def test_tile_numbers_of_two_bytes(spark):
    p = lambda n: F.array(*(F.struct(F.lit(i).cast("long").alias("tileno"), F.lit(20).cast("long").alias("len")) for i in n))
    r = spark.range(1).select(F.hex(markers.tlm(p([1, 255]))).alias("a"), F.hex(markers.tlm(p([1, 256]))).alias("b")).first()
    assert r.a == "FF55000E00500100000014FF00000014" and r.b == "FF55001000600001000000140100" + "00000014"


def test_collections_of_any_width(spark):
    from wavelake.sources import transforms

    rows = [([0, 300], [300, 0], 7, 9, True), ([5], [6], 1, 0, False)]
    df = spark.createDataFrame([(1, [dict(zip(("inputs", "outputs", "matrix", "offsets", "reversible"), r, strict=True)) for r in rows])], "id long, r array<struct<inputs:array<bigint>,outputs:array<bigint>,matrix:bigint,offsets:bigint,reversible:boolean>>")
    made = df.select(F.concat(headers.raw("FF4F"), transforms.collections(F.lit(3), F.col("r")), headers.raw("FF90")).alias("c")).first().c
    read = lambda c: _one(spark, bytes(c)).select(transforms.collections_of(F.col("c"), F.get(headers.segments(F.col("c")), F.lit(0))).alias("g")).first().g
    assert [tuple(g) for g in read(made)] == rows
    assert read(made[:20]) is None and read(b"\xff\x4f\xff\x75\x00\x09\0\0\1\0\1\0\0\xff\x90") is None


def test_elements_at_their_limits(spark):
    from wavelake.sources import transforms

    values = {0: [-32768.0, 32767.0], 1: [-(2.0**31), 2.0**31 - 1], 2: [1.401298464324817e-45, -3.4028234663852886e38], 3: [5e-324, 1.7976931348623157e308, float("-inf")]}
    for element, v in values.items():
        df = spark.createDataFrame([(v,)], "v array<double>").select(F.concat(headers.raw("FF4F"), transforms.record(F.lit(2), 1, F.lit(element), F.col("v")), headers.raw("FF90")).alias("c"))
        got = df.select(transforms.record_of(F.col("c"), F.get(headers.segments(F.col("c")), F.lit(0))).alias("m")).first().m
        assert (got["index"], got["kind"], got["element"], got["values"]) == (2, 1, element, v)


def test_rasters_without_samples(spark):
    files = [b"P5 0 3 255\n", b"P5 2 2 255\nabc", b"P2 2 1 9 1", b"PG ML + 8 0 0\n", b"PG ML + 8 2 2\nabc", b""]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "id long, c binary")
    eight, no = F.lit(8).cast("long"), F.lit(False)
    got = df.select(rasters.read_pixmap(F.col("c")).alias("a"), rasters.read_pgx(F.col("c")).alias("b"), headers.read_graymap(F.col("c")).alias("g")).collect()
    assert [(r.a, r.b, r.g) for r in got] == [(None, None, None)] * len(files)
    r = _one(spark, b"").select(rasters.read_raw_samples(F.col("c"), eight, eight, no, False).alias("a"), headers.read_raw(F.col("c"), 8, 8, False).alias("b")).first()
    assert r.a is None and r.b is None


def test_a_header_is_read_in_one_step(spark):
    from wavelake.sources import transforms

    df = spark.range(1).select(F.array(F.lit(1.5), F.lit(-2.0)).alias("v"), F.expr("array(named_struct('inputs', array(2L, 0L), 'outputs', array(0L, 2L), 'matrix', 7L, 'offsets', 0L, 'reversible', true))").alias("r"))
    record = lambda i: transforms.record(F.lit(i), 1, F.lit(3), F.col("v"))
    c = df.select(F.concat(headers.raw("FF4F"), record(7), transforms.collections(F.lit(1), F.col("r")), record(9), headers.raw("FF90")).alias("c")).first().c
    read = lambda c: _one(spark, c).select(transforms.header_of(F.col("c")).alias("h")).first().h
    h = read(bytes(c))
    assert [(m["index"], m["kind"], m["element"], m["values"]) for m in h.records] == [(7, 1, 3, [1.5, -2.0]), (9, 1, 3, [1.5, -2.0])]
    assert [(g.inputs, g.outputs, g.matrix, g.offsets, g.reversible) for g in h.groups] == [([2, 0], [0, 2], 7, 0, True)]
    cut = read(bytes(c[:-10]))
    assert cut.records[0]["index"] == 7 and cut.records[1] is None and len(cut.groups) == 1
    for none in (b"\xff\x4f\xff\x90", b""):
        assert read(none).records == [] and read(none).groups is None
