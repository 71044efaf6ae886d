"""Tile-part divisions, budgets, packed headers, sparse blocks and quality thresholds on made cases."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.operators import packets, rate, sparse
from wavelake.sources import headers, packed


def _seg(code: int, z: int, data: bytes) -> bytes:
    return struct.pack(">HHB", code, 3 + len(data), z) + data


@pytest.mark.parametrize("pieces,error,runs", [
    ([(0, b"\0\0\0\3ab"), (1, b"c\0\0\0\1d")], None, [b"abc", b"d"]),
    ([(1, b"c\0\0\0\1d"), (0, b"\0\0\0\3ab")], None, [b"abc", b"d"]),
    ([(0, b"\0\0\0\5a"), (3, b"b"), (7, b"cde\0\0\0\0\0\0\0\1z")], None, [b"abcde", b"", b"z"]),
    ([(0, b"\0\0\0\1a\0\0"), (1, b"\0\1b")], "length cut", None),
    ([(0, b"\0\0\0\7ab")], "bytes missing", None),
    ([(2, b"\0\0\0\1a"), (2, b"\0\0\0\1b")], "number twice", None),
])
def test_runs_of_packed_headers(spark, pieces, error, runs):
    content = b"\xff\x4f" + b"".join(_seg(0xFF60, z, d) for z, d in pieces) + b"\xff\x90"
    df = spark.createDataFrame([(1, content)], "id long, content binary").withColumn("s", F.explode(headers.segments(F.col("content"))))
    f = packed.fragments(df, ["id"], packed.PPM).withColumn("r", packed.runs(F.col("parts"))).first()
    assert (f.error or (f.r and f.r.error)) == error
    assert (f.r and f.r.runs and [bytes(x.data) for x in f.r.runs]) == runs


def test_fragments_of_a_tile(spark):
    content = b"\xff\x4f" + _seg(0xFF61, 9, b"xyz") + _seg(0xFF61, 0, b"ab") + b"\xff\x90"
    df = spark.createDataFrame([(1, content)], "id long, content binary").withColumn("s", F.explode(headers.segments(F.col("content"))))
    assert bytes(packed.fragments(df, ["id"], packed.PPT).select(packed.whole(F.col("parts")).alias("d")).first().d) == b"abxyz"


def test_sparse_blocks(spark):
    """Random writes and reads against a plain array, windows outside among them."""
    rng = random.Random(2)
    w, h, bw, bh = 23, 17, 5, 4
    plain, writes, reads, want = np.zeros((h, w), int), [], [], {}
    for seq in range(12):
        x0, y0 = rng.randrange(w), rng.randrange(h)
        x1, y1 = rng.randrange(x0 + 1, w + 1), rng.randrange(y0 + 1, h + 1)
        v = np.arange((y1 - y0) * (x1 - x0)).reshape(y1 - y0, -1) + 1000 * (seq + 1)
        plain[y0:y1, x0:x1] = v
        writes.append((1, seq, x0, y0, x1, y1, 1, x1 - x0, v.ravel().tolist()))
    for k, (x0, y0, x1, y1) in enumerate([(0, 0, w, h), (3, 2, 4, 3), (4, 3, 11, 9), (0, 0, w + 1, 1), (5, 5, 5, 6), (w, 0, w + 1, 1), (-1, 0, 2, 2)]):
        reads.append((k, 1, x0, y0, x1, y1, 3, 100))
        if k < 3:
            want |= {(k, (y - y0) * 100 + (x - x0) * 3): plain[y, x] for y in range(y0, y1) for x in range(x0, x1)}
    size = {n: F.lit(v).cast("long") for n, v in (("width", w), ("height", h), ("bw", bw), ("bh", bh))}
    blocks = sparse.stored(spark.createDataFrame(writes, "array_id long, seq long, x0 long, y0 long, x1 long, y1 long, col_stride long, line_stride long, src array<long>").withColumns(size))
    view = spark.createDataFrame(reads, "window_id long, array_id long, x0 long, y0 long, x1 long, y1 long, col_stride long, line_stride long").withColumns(size)
    assert {(r.window_id, r["at"]): r.v for r in sparse.read(blocks, view).collect()} == want
    assert {r.v for r in sparse.read(blocks.limit(0), view).collect()} == {0}


def test_divisions_and_budgets(spark):
    rows = [(1, 0, c, r, 0, n, 10 * c + r) for n in range(2) for r in range(2) for c in range(2)]
    p = spark.createDataFrame([(*k, i) for i, k in enumerate(rows)], "image_id long, tileno long, compno long, resno long, precno long, layno long, length long, seq long")
    of = lambda d: [(r.part, r["first"], r.packets, r.bytes, r.off) for r in packets.tile_part_runs(p, "lrcp", d).orderBy("part").collect()]
    assert of("L") == [(0, 0, 4, 36, 0), (1, 4, 4, 36, 36)]
    assert of("R") == [(0, 0, 2, 24, 0), (1, 2, 2, 26, 24), (2, 4, 2, 24, 50), (3, 6, 2, 26, 74)]
    fits = lambda a, b: [r.fits for r in packets.within_budgets(p, F.lit(a), F.lit(b)).orderBy("seq").collect()]
    assert fits(1000, 1000) == [True] * 8 and fits(10, 1000) == [True] * 2 + [False] * 6 and fits(1000, 20) == [True] * 3 + [False] * 5


def test_thresholds_settle(spark):
    """Each layer's threshold is the least that stays short of its share, to within the search's precision."""
    rng = random.Random(7)
    rows = []
    for c in range(20):
        r = d = 0
        for p in range(6):
            r, d = r + rng.randrange(1, 50), d + rng.randrange(1, 5000)
            rows.append((c // 10, c, p, r, d))
    df = spark.createDataFrame(rows, "tile long, cblk long, passno long, rate long, dist long")
    for r in rate.quality_layers(df, [0.4, 0.8]).collect():
        everything = sum(max(x[4] for x in rows if x[1] == c) for c in range(20) if c // 10 == r.tile)
        assert r.dist < (0.4, 0.8)[r.layno] * everything
        if r.layno == 0:
            lower = rate.greedy(df.where(F.col("tile") == r.tile), r.threshold * 0.9999).agg(F.sum("dist")).first()[0]
            assert r.dist == rate.greedy(df.where(F.col("tile") == r.tile), r.threshold).agg(F.sum("dist")).first()[0] and lower >= 0.4 * everything
    assert rate.quality_layers(df.limit(0), [0.5]).count() == 0
